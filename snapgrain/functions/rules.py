"""Path rules, keyword rules and signature flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Our own keyword groups, as regular expressions that Java and RE2 read alike.
KEYWORDS = {
    "guard": r"\b(if|check|assert|valid)\b",
    "alloc": r"\b(new|alloc|create)\b",
    "license": r"(?i)\blicensed?\b",
    "markup": r"[*#$%&|]{2,}|!!",
}
# Folders whose files do not count as code.
DOC_PREFIXES = ("docs/", "tests/", ".github/", "scripts/", "packages/", "plan/")


def keyword_counts(df: DataFrame, text: str, rules: dict[str, str] = KEYWORDS) -> DataFrame:
    return df.withColumns({f"k_{k}": F.regexp_count(F.col(text), F.lit(p)) for k, p in rules.items()})


def path_class(path: Column, prefixes=DOC_PREFIXES, extensions=(".c", ".h", ".py", ".rs", ".go", ".java", ".js")) -> Column:
    """excluded_prefix, then excluded_extension, then kept."""
    prefixed = F.lit(False)
    for p in prefixes:
        prefixed = prefixed | path.startswith(p)
    known = F.lit(False)
    for e in extensions:
        known = known | path.endswith(e)
    return F.when(prefixed, "excluded_prefix").when(~known, "excluded_extension").otherwise("kept")


def era(year: Column, width: int = 5) -> Column:
    return F.floor(year / width) * width
