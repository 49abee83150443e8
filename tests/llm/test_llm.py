"""The text operators against brute force, on small tables with nulls, empties, ties, repeats and clashing extra columns."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, id long, set string, a long, _id long, value string"


def corpus():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, passage, out = make(60), make(40), []
    for i in range(14):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [" ".join(make(25) + passage + make(i * 7)) for i in range(6)]
    out += [None, "", " \n\t ", "one", "one", "a b c d", "A b  C d", "mit license and MIT License", "x " * 500, "Released under the MIT License. cc by nc é", " ".join(make(4000))]
    out += ["Licensed under the Apache License, Version 2.0", "word word word word word word word word word word word word word word"]
    return [(i * 3, t, "en", "s", len(t or ""), 1, 2, "x", 3, 4, "v") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bodies():
    return {r[0]: r[1] or "" for r in corpus()}


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact(docs, bodies):
    from snapgrain.llm.exact_dedup import deduplicate, exact_groups

    got = rows(exact_groups(docs))
    for i, t in bodies.items():
        same = [j for j, u in bodies.items() if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert sorted(rows(deduplicate(docs, keep="min"))) == sorted({min(j for j, u in bodies.items() if u == t) for t in bodies.values()})


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_without_and_with_repeated_ids(spark, keep):
    """One row stays for each text, rows without an id and ids that repeat with other texts among them."""
    from snapgrain.llm.exact_dedup import deduplicate

    data = [(None, "lone", 1), (None, "lone", 2), (None, "shared", 3), (4, "shared", 4), (5, "shared", 5), (4, "other", 6), (3, "other", 7), (5, "other", 8), (9, "twice", 9), (9, "twice", 10), (None, None, 11), (None, "", 12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, _sha int").repartition(4)
    got = deduplicate(docs, keep=keep)
    assert got.schema == docs.schema
    best = {"min": ("shared", 4, "other", 3), "max": ("shared", 5, "other", 5)}[keep]
    want = [("", None), ("lone", None), (best[0], best[1]), (best[2], best[3]), ("twice", 9)]
    kept = got.collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in kept) == sorted((t, i or 0) for t, i in want)
    assert {(r.doc_id, r.text, r._sha) for r in kept} <= set(data)


@pytest.mark.parametrize("how", [{}, {"small": 1, "levels": 2, "pivots": 2, "divide": 2}, {"small": 2, "levels": 0}])
def test_jaccard(docs, bodies, how):
    from snapgrain.llm.jaccard_join import link_components

    got, sets = rows(link_components(docs, **how)), {}
    for i, t in bodies.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        return x if top[x] == x else find(top[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_substring(docs, bodies):
    from snapgrain.llm.substring_dedup import kept_digests, remove_repeats

    got, first, text = rows(kept_digests(docs)), {}, rows(remove_repeats(docs))
    words = {i: t.encode().split() for i, t in bodies.items()}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    for i, w in words.items():
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert (text[i].text or "") == (kept.decode() if gone else bodies[i])


def test_substring_of_texts_that_repeat_themselves(spark):
    """A window that a document holds several times goes at all its places, in whichever task a smaller document has it."""
    from snapgrain.llm.substring_dedup import kept_digests, remove_repeats

    line, other = " ".join(f"l{i}" for i in range(20)), " ".join(f"o{i}" for i in range(15))
    twice = f"{line} a b c {line} d {other} e f {line}"
    bodies = {1: line, 2: "z " * 14 + "q", 3: None, 5: twice, 6: "y " * 40 + other, 7: twice + " g", 8: "z " * 60, 9: "r " + "z " * 30 + "s " + "z " * 20, 11: line + "\t" + line}
    data = spark.sparkContext.parallelize(sorted(bodies.items()), len(bodies))  # each in a task of its own
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got, text, first = rows(kept_digests(docs)), rows(remove_repeats(docs)), {}
    words = {i: (t or "").split() for i, t in bodies.items()}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    for i, w in words.items():
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (i, got[i].n_removed, got[i].kept_sha256) == (i, len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert text[i].text == (kept if gone else bodies[i])


def test_licenses(docs, bodies):
    from snapgrain.llm.license_scan import PHRASES, scan

    got = rows(scan(docs))
    for i, t in bodies.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        hit = [(k, lab) for p, lab in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].base_labels) == (len(w), len(hit), ",".join(sorted({x for _, x in hit})))
        assert (got[i].first_word, got[i].last_word) == ((min(hit)[0], max(hit)[0]) if hit else (None, None))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(",")) | {""} and 0 <= got[i].score <= 1


def test_license_base_columns_follow_the_contract(spark, tmp_path):
    """The query's exact columns against a plain loop over the contract's own phrases; a bare name is the method's label only."""
    from snapgrain.llm.queries import op5_license_scan

    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    rng = random.Random(9)
    vocab = sorted({w for p, _ in phrases for w in p.split()}) + ["\u0130", "\u212a", "x\u00e9", "7", "\x00"]
    bodies = [None, "", "the MIT License", "Mit license, mit LICENSE", "Under the MIT License", "under\x00the mit-license under the m\u0130t license", "\U0001f600 UNDER the MIT license\u212a", "cc by nc cc by cc by nc under the mit license apache license version 2.0"]
    for _ in range(60):
        w = [x for _ in range(rng.randrange(12)) for x in (rng.choice(phrases)[0].split() if rng.random() < 0.3 else [rng.choice(vocab)])]
        bodies.append(" ".join(x.upper() if rng.random() < 0.2 else x for x in w))
    spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(op5_license_scan(spark, str(tmp_path)))
    for i, t in enumerate(bodies):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hit = [(k, lab) for p, lab in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in hit]
        base = ",".join(sorted({x for _, x in hit}))
        assert (i, *(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))) == (i, len(w), len(hit), min(places, default=None), max(places, default=None), base)
        assert set(base.split(",")) <= set(got[i].labels.split(",")) | {""}
    assert [(got[i].base_labels, got[i].labels, got[i].score) for i in (2, 4)] == [("", "mit", 1.0), ("mit", "mit", 1.0)]


def test_licenses_count_a_template_pair_once_in_a_span(spark):
    from snapgrain.llm.license_scan import scan

    bodies = ["under the x under the y under the", "it is released under the very mit license", "released under the mit license under the mit license"]
    got = rows(scan(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")))
    assert [(got[i].labels, got[i].score) for i in range(3)] == [("", 0.0), ("mit", 1.0), ("mit", 1.0)]


def test_fingerprints(docs, bodies):
    from snapgrain.llm.fingerprints import neighbours_and_edits, similar_pairs

    got, ids = rows(neighbours_and_edits(docs, parts=5)), sorted(bodies, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        k = len(bodies[a]) // 3
        edited = bodies[a][: len(bodies[a]) - k] + bodies[b][:k]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(bodies[a]), hashlib.sha256(edited.encode()).hexdigest())
        if bodies[a] == bodies[b]:
            assert got[a].fingerprint == got[b].fingerprint
    assert all(r.similarity >= 0.75 for r in similar_pairs(docs).collect())


@pytest.mark.parametrize("how", [{}, {"block": 4}])
def test_similar_pairs_whatever_heads_a_band(spark, how):
    """Links between members of bands whose smallest ids are others are found, as brute force has them."""
    from snapgrain.llm.fingerprints import sets_of, similar_pairs

    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    bodies = {}
    for i in range(80):  # the smaller ids: each shares about 0.7 of the text, so together they head the bands
        at = rng.randrange(140)
        bodies[i] = " ".join(base[:at] + base[at + 58 :])
    bodies |= {200: " ".join(base), 201: " ".join(base[:-2]), 202: " ".join(base[2:]), 203: " ".join(base), 204: "", 205: None, 206: " ".join(base)}
    docs = spark.createDataFrame(list(bodies.items()), "doc_id long, text string").repartition(3)
    got = {(r.other, r.doc_id): r.similarity for r in similar_pairs(docs, **how).collect()}
    sets = {i: set(s.tolist()) for i, s in zip(bodies, sets_of([t or "" for t in bodies.values()]), strict=True)}
    head = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    true = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j and sets[i] and sets[j] and (head[i] == i and head[j] == j or head[j] == i)}
    assert {p for p, s in true.items() if s >= 0.9} <= set(got)
    assert all(abs(true[p] - s) < 1e-12 and s >= 0.75 for p, s in got.items())
    assert {(200, 201), (200, 202), (201, 202), (200, 203), (200, 206)} <= set(got) and (203, 206) not in got


def test_bpe(docs, bodies):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from snapgrain.llm.tokens import encode, word_bpe

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = rows(encode(docs, P.path("word_bpe_49k.json")))
    for i, x in bodies.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False)
    for x in ["", "Σας ΟΔΟΣ", "a<|endoftext|>b <|startoftext|>", "a" * 90, "İ K é \x85 x it's I'LL !!!'s 12³ ½ 日本語 👩‍👧"]:
        ids = t.encode(x, add_special_tokens=False).ids
        raw, decoded = word_bpe(P.path("word_bpe_49k.json")).encode([x])[0]
        assert np.frombuffer(raw, "<u4").tolist() == ids and decoded == t.decode(ids, skip_special_tokens=False)


def test_packing(docs, bodies):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from snapgrain.llm.packing import best_fit, byte_bpe, dual_feasible, pack_documents

    encoder = byte_bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = pack_documents(docs, encoder, per_task=5).toPandas()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in bodies.items()}
    assert got.groupby("doc_id").length.sum().to_dict() == total
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and list(g.offset) == [0, *g.length.cumsum()[:-1]]
    assert got.sequence_id.nunique() <= dual_feasible(got.length.to_numpy(), 2048) + 1
    sizes = np.array([6, 6, 6, 5, 5, 5, 4, 4])
    where, room = best_fit(sizes, 10)
    assert (np.bincount(where, sizes) + room == 10).all() and dual_feasible(sizes, 10) <= len(room)


def test_warc(spark):
    from snapgrain.llm.warc import round_trip

    nested = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n" + "z" * 99
    data = [(1, "u x\n", nested), (2, None, None), (3, "a", "q" * 100), (4, "a", "q" * 100), (5, "a", "q" * 99), (6, "a", "q" * 99), (7, "é", "é" * 60), (8, "é", "é" * 60)]
    got = rows(round_trip(spark.createDataFrame(data, "page_id long, url string, html string")), "page_id")
    for i, _, h in data:
        b = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {4: 3, 8: 7}
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html():
    from snapgrain.llm.html_main import extract_pages, model, training

    x, y = training(99, 60)
    assert ((model().score(x) > 0) == (y > 0.5)).mean() > 0.97  # held-out pages
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T &amp; x</h1><p>One  two.<p>Three<script>var a='</p>'</script></article><footer>&copy; me</footer></body></html>"
    assert extract_pages([page, "", "<"], model()) == ["T & x\nOne two.\nThree", "", ""]


def test_html_drops_only_closed_elements():
    from snapgrain.llm.html_main import tree

    text = lambda page: "".join(p[0] for x in tree(page) for p in x.parts if type(p) is tuple)
    assert text("<p>a<svg class='x'/>b<svg><text>no</text></svg>c") == "abc"
    assert text("<select name=s><p>a<select><option>no</select>b<SVG>c<svg>no<svg>no</svg>no</svg>d") == "abcd"
    assert text("a<template>no<template>no</template>no</template>b<noscript>c") == "abc"
    assert text("<svg>a<!-- </svg> -->b<script>'</svg>'</script>c<iframe>no") == "abc"
    assert text("a<svg><title/><style>no</style></svg>b") == "ab"


def test_quality(spark):
    from snapgrain.llm.quality import graded

    rng = random.Random(9)
    text = lambda g: " ".join("junk!!" if g == 0 else rng.choice(["nasty", "good", "fine"] if g == 1 else ["good", "fine", "kind"]) for _ in range(60))
    data = [(i, text(i % 3), "en") for i in range(300)] + [(900, None, "en"), (901, "", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(150)] + [(77777, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = graded(docs, labels).collect()
    held = [r for r in got if 150 <= r.doc_id < 300]
    assert sum(r.kept == (r.doc_id % 3 == 2) for r in held) / len(held) > 0.95
    assert all(r.kept and r.tail is None for r in graded(docs, labels.limit(0)).collect())


def test_quality_finds_rare_words_of_long_texts(spark):
    """Two bad words among 2000 are enough, and clean texts of any length stay."""
    from snapgrain.llm.quality import graded

    rng = random.Random(4)

    def text(g, n):
        words = [f"w{rng.randrange(3000)}" for _ in range(n)] if g else ["junk!!"] * n
        for _ in range(2 if g == 1 else 0):
            words[rng.randrange(n)] = rng.choice(["nasty", "awful"])
        return " ".join(words)

    docs = spark.createDataFrame([(i, text(i % 3, 2000 if i >= 300 else rng.randrange(40, 400))) for i in range(360)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(300)], "doc_id long, quality int, toxic int")
    held = [r for r in graded(docs, labels).collect() if r.doc_id >= 300]
    assert sum(r.kept == (r.doc_id % 3 == 2) for r in held) / len(held) > 0.95


def test_empty_tables(spark):
    import public_tokenizers as P

    from snapgrain.llm import exact_dedup, fingerprints, html_main, jaccard_join, license_scan, packing, substring_dedup, tokens

    none = spark.createDataFrame([], "doc_id long, text string")
    encoder = packing.byte_bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for f in (exact_dedup.exact_groups, jaccard_join.link_components, substring_dedup.kept_digests, license_scan.scan, fingerprints.neighbours_and_edits, lambda d: packing.pack_documents(d, encoder), lambda d: tokens.encode(d, P.path("word_bpe_49k.json"))):
        assert f(none).count() == 0
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_and_sql(spark):
    import os

    import corpus_pipeline
    from snapgrain.llm.queries import ORACLE, QUERIES

    d = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, d)
    n = packed.select("doc_id").distinct().count()
    assert 0 < n < spark.read.parquet(f"{d}/documents.parquet").count()
    c = duckdb.connect()
    for t in os.listdir(d):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{d}/{t}'")
    for name, sql in ORACLE.items():
        df, rel = QUERIES[name](spark, d), c.execute(sql)
        names = [x[0] for x in rel.description]
        assert sorted(map(str, df.select(*names).collect())) == sorted(str(df.select(*names).collect()[0].__class__(**dict(zip(names, r, strict=True)))) for r in rel.fetchall())
