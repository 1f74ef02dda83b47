"""License scan: winnowed template fingerprints pick candidates, banded alignment measures them.

Words are runs of letters and digits, A-Z lower-cased. Templates are cut into
``Settings.gram`` consecutive words; of every ``Settings.window`` neighbouring
grams the one with the smallest hash is kept (winnowing; statements of a few words
have shorter windows) and goes into an inverted index from hash to (template, position). Every gram of every whole
text is looked up, so a text that shares ``window + gram - 1`` words in a row with
a template always becomes a candidate. Hits of a template on nearby diagonals
(text position minus template position) are one candidate region. There the template is
aligned with the text inside a band around the diagonals (most matching words,
order kept). Coverage is the matching words as a share of the template or of the span, whichever
has more words, so added words count like missing ones. An alignment of ``Settings.coverage`` or more is reported
with its coverage and character span if the span has exactly the template's telling words (names, versions and conditions
that part neighbouring licenses) and does not follow a negation.

The template table is small and checked against ``MAX_WORDS``, so the index is
broadcast; texts are scanned once without a shuffle and a text is aligned where it is
read, so a statement that every text has makes no hot key. A task holds one
Arrow batch of texts; the alignment table is (template words x band).

Edge cases: null and empty texts have no finding. Templates without a word are
left out; one with fewer words than a gram is looked up by all its words. Of equal
alignments the first in the text is reported; overlapping findings of one template
keep the one of most coverage, then the first; different templates are reported
side by side, except one whose span lies in that of a better covered one. Repeated rows are reported each. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import kernels as K
from casewright.llm import registry
from casewright.llm.license_templates import TEMPLATES
from casewright.llm.session import prepare, read

#: Letters and digits make words; all other ASCII ends them.
SEPARATORS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Words of all templates together, at most: bounds the broadcast index.
MAX_WORDS = 2_000_000
#: Words that tell one license from its neighbours (versions by their digits, a 0 aside).
TELLING = ["apache", "bsd", "mit", "isc", "mozilla", "mpl", "gnu", "gpl", "lgpl", "agpl", "lesser", "library", "affero", "eclipse", "nc", "nd", "sa",
           "noncommercial", "noderivatives", "noderivs", "sharealike", *"123456789"]
#: A span after one of these is no grant.
NEGATIONS = ["not", "never"]
FINDING = "doc_id long, license string, template_words int, matched_words int, coverage double, start int, end int"


@dataclass(frozen=True)
class Settings:
    gram: int = 3
    window: int = 4
    coverage: float = 0.8
    #: Words that may be missing or added on either side of a diagonal, as a share of the template and at least.
    band_share: float = 0.1
    band_least: int = 3


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return K.ngram_hashes(words, doc, n) if n > 1 else (K.mix(words + np.uint64(31)), doc)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (the last of equals) of every window."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, axis=1))


def _hashes(words: list[str]) -> np.ndarray:
    return K.word_hashes(*K.text_bytes(pa.array([" ".join(words)], pa.string())))[0]


class Index:
    """Inverted index of the templates: sorted fingerprints with (template, position), by gram length."""

    def __init__(self, templates: list[tuple[str, str]], s: Settings):
        column = pa.array([t for _, t in templates], pa.string())
        data, off = K.text_bytes(column)
        words, doc = K.word_hashes(data, off, SEPARATORS)
        if len(words) > MAX_WORDS:
            raise ValueError(f"templates have more than {MAX_WORDS} words")
        self.names = [n for n, _ in templates]
        self.words = [words[doc == i] for i in range(len(templates))]
        self.telling, self.negations = _hashes(TELLING), _hashes(NEGATIONS)
        self.tells = [self.told(w) for w in self.words]
        self.settings = s
        rows = defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w):
                n = min(s.gram, len(w))
                h, _ = grams(w, np.zeros(len(w), np.int64), n)
                rows[n] += [(h[p], i, p) for p in winnow(h, min(s.window, max(1, len(h) // 4)))]
        self.prints = {}
        for n, found in rows.items():
            found.sort()
            self.prints[n] = tuple(np.array(x) for x in zip(*found, strict=True))

    def told(self, words: np.ndarray) -> frozenset[int]:
        """The words among ``words`` that tell licenses apart."""
        return frozenset(words[np.isin(words, self.telling)].tolist())

    def coverage(self, template: int, score: int, first: int, last: int) -> float:
        """Matching words as a share of the template or of the span, whichever is longer: added words count like missing ones."""
        return score / max(len(self.words[template]), last - first + 1)

    def names_it(self, template: int, words: np.ndarray, first: int, last: int) -> bool:
        """Whether the span has the template's telling words and no other, and no negation before it."""
        return self.told(words[first:last + 1]) == self.tells[template] and (first == 0 or words[first - 1] not in self.negations)

    def anchors(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text word position, template, template position) of every hit."""
        for n, (prints, template, position) in self.prints.items():
            h, _ = grams(words, doc, n)
            where = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:]) if len(doc) >= n else np.zeros(0, int)
            lo, hi = np.searchsorted(prints, h, side="left"), np.searchsorted(prints, h, side="right")
            for k in np.flatnonzero(hi > lo):
                for j in range(lo[k], hi[k]):
                    yield int(where[k]), int(template[j]), int(position[j])


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matching words, first, last text position) of the best alignment of the whole template with
    ``text`` on diagonals low..high. Rows are template words; gaps cost nothing, so a row is
    filled by a running maximum."""
    m, width = len(template), high - low + 1
    best = np.zeros((m + 1, width + 1), dtype=np.int32)  # column b: text position row + low + b
    for i in range(m):
        at = i + low + np.arange(width)
        same = np.zeros(width, dtype=bool)
        inside = (at >= 0) & (at < len(text))
        same[inside] = text[at[inside]] == template[i]
        # best[i + 1, b + 1]: from the same diagonal with a match, the row above, or the left.
        above = best[i, 1:].copy()
        above[:-1] = np.maximum(above[:-1], best[i, 2:])
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(above, best[i, 1:] + same))
    # Walk back from the earliest column with the best score.
    i, b = m, int(np.argmax(best[m, 1:])) + 1
    score, first, last = int(best[m].max()), -1, -1
    while i > 0 and b > 0 and best[i, b] > 0:
        if best[i, b - 1] == best[i, b]:
            b -= 1
        elif b < width and best[i - 1, b + 1] == best[i, b]:
            i, b = i - 1, b + 1
        elif best[i - 1, b] == best[i, b]:
            i -= 1
        else:
            first = i - 1 + low + b - 1
            last = first if last < 0 else last
            i -= 1
    return score, first, last


def find(index: Index, words: np.ndarray, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(template, matching words, first, last word) of the findings in one text."""
    s, diagonals = index.settings, defaultdict(set)
    for at, template, position in anchors:
        diagonals[template].add(at - position)
    out = []
    for template, found in diagonals.items():
        own = index.words[template]
        m, band = len(own), max(s.band_least, int(len(index.words[template]) * s.band_share))
        found, kept = sorted(found), []
        # Neighbouring diagonals are one region; a long run of them is cut so that a band stays narrow.
        regions = [[found[0], found[0]]]
        for d in found[1:]:
            if d - regions[-1][1] <= band and d - regions[-1][0] <= 2 * band + m:
                regions[-1][1] = d
            else:
                regions.append([d, d])
        for low, high in regions:
            origin = max(0, low - band)
            part = words[origin:high + band + m]
            score, first, last = align(own, part, low - band - origin, high + band - origin)
            first, last, found_words = origin + first, origin + last, first >= 0
            if found_words and index.coverage(template, score, first, last) >= s.coverage and index.names_it(template, words, first, last):
                kept.append((score, first, last))
        taken: list[tuple[int, int, int]] = []
        for score, first, last in sorted(kept, key=lambda x: (-x[0], x[1])):
            if all(last < a or first > b for _, a, b in taken):
                taken.append((score, first, last))
        out += [(template, score, first, last) for score, first, last in taken]
    cover = lambda x: index.coverage(*x)
    inside = lambda x, y: y[2] <= x[2] and x[3] <= y[3]
    out = [x for x in out if not any(inside(x, y) and cover(y) > cover(x) for y in out)]
    return sorted(out, key=lambda x: (x[2], x[0]))


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column("doc_id"), []
        for lo, _, data, off in K.chunks(batch.column("text")):
            start, end, doc = K.word_spans(data, off, SEPARATORS)
            if not len(start):
                continue
            words = K.span_hash(K.prefix_hash(data), start, end)
            begin = np.searchsorted(doc, np.arange(len(off)))
            of_doc = defaultdict(list)
            for at, template, position in index.anchors(words, doc):
                d = int(doc[at])
                of_doc[d].append((at - int(begin[d]), template, position))
            for d, anchors in of_doc.items():
                raw = data[off[d]:off[d + 1]]
                chars = np.cumsum((raw & 0xC0) != 0x80)
                for template, score, first, last in find(index, words[begin[d]:begin[d + 1]], anchors):
                    m = len(index.words[template])
                    a, b = start[begin[d] + first] - off[d], end[begin[d] + last] - off[d]
                    rows.append((ids[lo + d].as_py(), index.names[template], m, score, index.coverage(template, score, first, last), int(chars[a]) - 1, int(chars[b - 1])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)],
                                             names=["doc_id", "license", "template_words", "matched_words", "coverage", "start", "end"])


_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, s: Settings = Settings()) -> DataFrame:
    """One row for each finding: doc_id, license, words of the template and matching ones, coverage,
    and the [start, end) character span in the text."""
    spark = prepare(docs.sparkSession)
    index = spark.sparkContext.broadcast(Index(templates, s))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda b: _scan(b, index.value), FINDING)


@registry.query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents", "doc_id", "text"))
