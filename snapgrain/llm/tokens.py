"""BPE encoding and decoding by batched numpy merge rounds.

``Merger`` takes the words of a batch that it has not met before as one flat array of symbols.  Each round looks every
neighbouring pair up by binary search over the sorted pair keys, finds the lowest rank in each word, and merges that
pair's occurrences in all words at once, until no word has a pair left.  Words of more than LONG symbols merge together,
one rank a round from the lowest up, and each round looks only at the places that the one before changed: a merge makes
pairs of higher ranks only, so a rank is done once and the cost does not grow with the square of a word's length.  Results
are kept in a cache of bounded size.

``WordBpe`` adds what the vocabulary file asks for around it: special tokens are found first and cut the text; then NFC,
white space, lower case and the word pattern; the last symbol of a word carries its end mark.  Decoding joins the tokens
by one space, as the file names no decoder.  A null text counts as empty; an empty text has no ids and decodes to "".
Rows that repeat a doc_id, or have none, each get their result; an empty table gives an empty result; other columns of the
input are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import small_batches, texts

#: Words kept with their ids in each Python worker.
CACHE = 400_000
#: Symbols of a word from which it merges rank by rank.
LONG = 256


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def second(follows: np.ndarray) -> np.ndarray:
    """Of runs of places that each follow the one before: every second one."""
    n = np.arange(len(follows))
    return (n - np.maximum.accumulate(np.where(follows, 0, n))) % 2 == 1


class Merger:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.base = max(vocab.values(), default=0) + 1
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        self.to = np.array([vocab[a + b] for a, b in merges], np.int64)
        # whether every merge takes only symbols that merges of lower ranks made
        made = np.full(self.base, -1, np.int64)
        np.maximum.at(made, self.to, np.arange(len(merges)))
        self.rising = bool((np.maximum(made[left], made[right]) < np.arange(len(merges))).all())

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; one past the last where there is none."""
        if not len(self.key):
            return np.zeros(len(a), np.int64)
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.key))

    def by_rank(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, a rank a round; only for merges that are ``rising``."""
        n, none = len(symbols), len(self.key)
        sym, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        cut = np.flatnonzero(owner[1:] != owner[:-1])
        after[cut], after[-1:], before[cut + 1] = -1, -1, -1
        rank, live = np.full(n, none, np.int64), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at):
            """Rank the pairs that start at these places and put them on the list of their rank."""
            pair = at[after[at] >= 0]
            rank[at] = none
            found = self.lookup(sym[pair], sym[after[pair]])
            rank[pair] = found
            order = np.argsort(found, kind="stable")
            pair, found = pair[order], found[order]
            heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else []
            for a, b in zip(heads, [*heads[1:], len(found)], strict=True):
                r = int(found[a])
                if r != none:
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(pair[a:b])

        look(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at] & (rank[at] == r)]
            if not len(at):
                continue
            at = at[~second(np.concatenate([[False], after[at[:-1]] == at[1:]]))]
            gone = after[at]
            sym[at] = self.to[r]
            live[gone], rank[gone] = False, none
            after[at] = after[gone]
            has = at[after[at] >= 0]
            before[after[has]] = has
            left = before[at]
            look(np.unique(np.concatenate([at, left[left >= 0]])))
        return sym[live], owner[live]

    def merge(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols and their words, for symbols in word order."""
        size = np.bincount(owner) if len(owner) else np.zeros(0, np.int64)
        long = self.rising & (size[owner] > LONG)
        if not long.any():
            return self.in_words(symbols, owner)
        a, b = self.by_rank(symbols[long], owner[long]), self.in_words(symbols[~long], owner[~long])
        symbols, owner = (np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def in_words(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, the lowest rank of every word a round."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.key)
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            if len(symbols) > 1:
                rank[:-1] = np.where(owner[1:] == owner[:-1], self.lookup(symbols[:-1], symbols[1:]), none)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(first, len(symbols)))
            least = np.minimum.reduceat(rank, first)
            each = np.repeat(least, count)
            ended = each == none
            if ended.any():
                done.append((symbols[ended], owner[ended]))
                keep = ~ended
                symbols, owner, rank, each = symbols[keep], owner[keep], rank[keep], each[keep]
                if not len(symbols):
                    break
            hit = rank == each
            # of a run of overlapping occurrences (a a a), every second one merges, from the left
            at = np.flatnonzero(hit)
            at = at[~second(np.concatenate([[False], np.diff(at) == 1]))]
            symbols = symbols.copy()
            symbols[at] = self.to[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]


class WordBpe:
    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.merger = Merger(self.vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.chars = byte_chars()
        self.plain = np.array([self.vocab[c] for c in self.chars], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in self.chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # Fixed value: the word pattern of the vocabulary file, white space written as the Unicode property.
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.limit = cache
        self.known: dict[str, tuple[bytes, str]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens.  Each character is lower-cased by itself, so a final sigma is an ordinary one."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def learn(self, words: list[str]) -> None:
        """Encode words and keep the result."""
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            raw = [w.encode() for w in part]
            size = np.array([len(b) for b in raw])
            flat = np.frombuffer(b"".join(raw), np.uint8)
            symbols = self.plain[flat]
            ends = np.cumsum(size) - 1
            symbols[ends] = self.last[flat[ends]]
            symbols, owner = self.merger.merge(symbols, np.repeat(np.arange(len(part)), size))
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            ids = symbols.astype("<u4")
            names = [self.names[i] for i in symbols.tolist()]
            for i, w in enumerate(part):
                a, b = bounds[i], bounds[i + 1]
                self.known[w] = (ids[a:b].tobytes(), " ".join(names[a:b]))

    def encode(self, bodies: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of every text."""
        cut = [self.cut.split(b) if "<|" in b else [b] for b in bodies]
        listed = [[(p,) if p in self.special else self.words(p) for p in parts] for parts in cut]
        fresh = {w for parts in listed for p in parts if type(p) is list for w in p}
        missing = fresh - self.known.keys()
        if len(self.known) + len(missing) > self.limit:
            missing = fresh
            self.known.clear()
        if missing:
            self.learn(list(missing))
        out, known = [], self.known
        for parts in listed:
            found = []
            for p in parts:
                if type(p) is tuple:
                    found.append((np.uint32(self.special[p[0]]).astype("<u4").tobytes(), p[0]))
                else:
                    found += [known[w] for w in p]
            out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found])))
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(self.names[i] for i in np.frombuffer(ids, "<u4").tolist() if i in self.names)


_held: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One tokenizer for each file and Python worker."""
    if path not in _held:
        _held[path] = WordBpe(path)
    return _held[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids array<long>, decoded) of every row; with digests (id, n_tokens, ids_sha256, decoded_sha256) instead, which travel lighter."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            found = bpe.encode(texts(batch.column(1)))
            if digests:
                columns = [
                    pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in found], pa.string()),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns = [pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i, _ in found], pa.list_(pa.int64())), pa.array([d for _, d in found], pa.string())]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string"
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {tail}")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, decoded) of rows of ids; null ids count as none, unknown ones are skipped."""

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            found = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[id_col, "decoded"])

    return rows.select(id_col, ids).mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, decoded string")
