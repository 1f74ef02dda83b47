"""Text column expressions with the reference's (Python) string semantics.

Python's ``str.strip``, ``\\s`` and ``\\w`` are Unicode-aware; Java regex
and DuckDB's RE2 are ASCII by default. The classes below spell the
Unicode sets out so that Spark and the DuckDB oracle agree.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters Python's str.isspace() accepts.
WS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NON_WS = WS.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character for which Python's str.isspace() is true.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace.

    ``trim(str, chars)`` scans inward from both ends only, instead of
    running a regex over every character of long texts."""
    return F.trim(_c(c), F.lit(PY_WHITESPACE))


def norm_key(c) -> Column:
    """Normalised text key: strip then lower."""
    return F.lower(py_strip(c))


def collapse_ws(c) -> Column:
    """``re.sub(r"\\s+", " ", s).strip()``."""
    return py_strip(F.regexp_replace(_c(c), f"{WS}+", " "))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(c) -> Column:
    """All named and numeric HTML references, decoded in a single pass. Only texts
    with an ampersand are handed to Python (one Arrow batch at a time)."""
    col = _c(c)
    return F.coalesce(_unescape(F.when(col.contains("&"), col)), col)


def clean_for_embedding(c) -> Column:
    """null -> "", unescape, drop URLs, drop @handles, collapse whitespace."""
    s = html_unescape(F.coalesce(_c(c), F.lit("")))
    s = F.regexp_replace(s, rf"https?://{NON_WS}+", "")
    s = F.regexp_replace(s, rf"@{WORD}+", "")
    return collapse_ws(s)


def truncate(c, n: int, ellipsis: bool = True) -> Column:
    """Keep ``n`` characters; with ``ellipsis`` longer text becomes n-3 chars + '...'."""
    col = _c(c)
    if not ellipsis:
        return F.substring(col, 1, n)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n - 3), F.lit("..."))).otherwise(col)


def py_words(c) -> Column:
    """``s.split()``: whitespace-separated tokens, empty tokens dropped."""
    return F.filter(F.split(_c(c), f"{WS}+"), lambda t: t != "")


def word_count(c) -> Column:
    return F.size(py_words(c)).cast("long")


def words_min_len(c, n: int) -> Column:
    """Distinct ``re.findall(r"\\w{n,}", s)`` over Unicode word characters."""
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(f"({WORD}{{{n},}})"), 1))


def whole_word_pattern(phrase_regex: str) -> str:
    """Regex for a whole-word match with Unicode ``\\b`` semantics (Java regex)."""
    return rf"(?<!{WORD}){phrase_regex}(?!{WORD})"
