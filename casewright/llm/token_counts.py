"""Token counts by section: offset-mapped attribution of one encoding of the whole text.

Every whole text is encoded once. The byte lengths of its tokens give each
token a character span (a token that holds part of a character spans that
character). The spans are interval-joined to the text's sections by binary
search on the sections' bounds, both sides lying in the same row, so nothing is
shuffled and a task holds one Arrow batch. A token inside one section counts
there; a token over a boundary is allocated by an explicit rule:

* ``majority`` (default): the section with most of its characters, the earlier of equals;
* ``start``: the first section that it touches;
* ``split``: to each section that it touches, its share of the token's characters that lie in sections.

Sections are a column of sorted, disjoint [start, end) character spans, or by
default the text's lines, each with its line feed. Tokens in no section are
counted as ``outside``; the sections' counts plus outside are the text's tokens.

Edge cases: a null or empty text has no section and no token; null sections
count everything as outside; empty sections get 0; a section beyond the text gets
0. Overlapping or unsorted sections raise. Repeated rows are counted alike. Extra
columns pass through; a column that has the name of the added one is replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import kernels as K
from casewright.llm import registry
from casewright.llm.session import prepare, read

RULES = ("majority", "start", "split")
COUNTED = "struct<tokens:long,outside:double,sections:array<struct<start:int,end:int,tokens:double,crossing:int>>>"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the byte length of each of its tokens; read once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(start: np.ndarray, end: np.ndarray, s: np.ndarray, e: np.ndarray, rule: str) -> tuple[np.ndarray, float, np.ndarray]:
    """(tokens of each section, tokens outside, boundary-crossing tokens that touch each section)."""
    full = np.flatnonzero(e > s)  # empty sections hold no character
    s, e, n = s[full], e[full], len(s)
    first, last = np.searchsorted(e, start, side="right"), np.searchsorted(s, end, side="left") - 1
    inside, over = first == last, np.flatnonzero(first < last)
    tokens = np.bincount(first[inside], minlength=len(s)).astype(float)
    crossing = np.zeros(len(s), np.int64)
    for t in over:
        k = np.arange(first[t], last[t] + 1)
        chars = np.minimum(e[k], end[t]) - np.maximum(s[k], start[t])
        crossing[k] += 1
        if rule == "split":
            tokens[k] += chars / chars.sum()
        else:
            tokens[k[np.argmax(chars)] if rule == "majority" else k[0]] += 1
    wide, wide_crossing = np.zeros(n), np.zeros(n, np.int64)
    wide[full], wide_crossing[full] = tokens, crossing
    return wide, float(len(start) - inside.sum() - len(over)), wide_crossing


def line_bounds(data: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) in characters of every line with its line feed."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = chars[np.flatnonzero(data == 10)] + 1
    length = chars[-1] + 1
    if not len(ends) or ends[-1] < length:
        ends = np.append(ends, length)
    return np.append(0, ends[:-1]), ends


def _counted(texts: pa.Array, sections: pa.Array | None, path: str, pattern: str, rule: str) -> pa.Array:
    encoding, lengths = encoder(path, pattern)
    data, off = K.text_bytes(texts)
    n_tokens, outside, bounds, parts = [], [], [0], []
    for i in range(len(texts)):
        raw = data[off[i]:off[i + 1]]
        chars = np.cumsum((raw & 0xC0) != 0x80) - 1  # character of each byte
        if sections is None:
            s, e = line_bounds(raw, chars)
        elif sections[i].is_valid:
            given = sections[i].values
            s, e = (given.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
            if (e < s).any() or (s[1:] < e[:-1]).any():
                raise ValueError("sections must be sorted and disjoint")
        else:
            s = e = np.zeros(0, np.int64)
        ids = encoding.encode_to_numpy(raw.tobytes().decode(), disallowed_special=()) if len(raw) else np.zeros(0, np.uint32)
        stop = np.cumsum(lengths[ids])
        start = chars[stop - lengths[ids]] if len(ids) else stop
        tokens, rest, crossing = allocate(start, chars[stop - 1] + 1 if len(ids) else stop, s, e, rule)
        n_tokens.append(len(ids))
        outside.append(rest)
        bounds.append(bounds[-1] + len(s))
        parts.append((s, e, tokens, crossing))
    flat = [np.concatenate(x) if parts else np.zeros(0) for x in zip(*parts, strict=True)] or [np.zeros(0)] * 4
    items = pa.StructArray.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.float64()), pa.array(flat[3], pa.int32())],
                                       ["start", "end", "tokens", "crossing"])
    return pa.StructArray.from_arrays([pa.array(n_tokens, pa.int64()), pa.array(outside, pa.float64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)],
                                      ["tokens", "outside", "sections"])


def attribute(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text",
              sections: str | None = None, rule: str = "majority", into: str = "counted") -> DataFrame:
    """``docs`` with the tokens of each text and of each of its sections."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    if sections is None:
        @F.arrow_udf(COUNTED)
        def of_lines(texts: pa.Array) -> pa.Array:
            return _counted(texts, None, path, pattern, rule)
        return docs.withColumn(into, of_lines(F.col(text).cast("string")))

    @F.arrow_udf(COUNTED)
    def of_sections(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return _counted(texts, spans, path, pattern, rule)
    return docs.withColumn(into, of_sections(F.col(text).cast("string"), F.col(sections)))


@registry.query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of each document, and one (section null) for documents without any."""
    docs = attribute(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = docs.select("doc_id", F.col("counted.tokens").alias("doc_tokens"), F.posexplode_outer("counted.sections").alias("section", "s"))
    return rows.select("doc_id", F.col("section").cast("long"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"),
                       F.coalesce(F.col("s.tokens").cast("long"), F.lit(0)).alias("n_tokens"), F.coalesce(F.col("s.crossing").cast("long"), F.lit(0)).alias("n_crossing"), "doc_tokens")
