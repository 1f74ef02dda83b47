"""Collocations, hard negatives and line dedup against brute force on small awkward tables."""
import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import collocations as C
from casewright.llm import hard_negatives as H
from casewright.llm import line_dedup as L

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- collocations --------------------------------------------------------------------------

def brute_collocations(rows, s):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < s.threshold:
            continue
        score, cut, l, r = min((s.scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        around = max((b for (other, q), b in f.items() if other == lang and len(q) > len(p) and b >= s.threshold
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))), default=0)
        if 100 * around < s.covered * a:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -score)
                  for lang, x in found.items() for i, (score, a, p, l, r) in enumerate(sorted(x)[:s.best]))


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "é", "x-y", "mat", "Ärger", "of", "no"]
    sep = [" ", " ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "!", "\x0b"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randrange(30)))) for _ in range(n)]
    return rows + [("en", None), ("de", ""), (None, "   "), ("en", "the cat sat of " * 200), ("en", "no")] + [("fr", "a b c d e")] * 40


@pytest.mark.parametrize("shards,threshold,best", [(2, 30, 2000), (4, 5, 7), (1, 12, 2000)])
def test_collocations_equal_brute_force(spark, shards, threshold, best):
    s = C.Settings(shards=shards, threshold=threshold, best=best)
    rows = some_texts(shards, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit("clash"), "phrase": F.lit(1)}).repartition(5)
    out = C.collocations(docs, s)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == brute_collocations(rows, s)


def test_collocations_without_rows_and_without_frequent_phrases(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "one two three")], "lang string, text string")).count() == 0


def test_collisions_of_bits_change_no_count(spark):
    rows, s = some_texts(9, 60), C.Settings(threshold=4, shards=2, least_bits=3, most_bits=3)  # many phrases share a bit
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in C.collocations(docs, s).collect()) == brute_collocations(rows, s)


def test_score_is_exact_beyond_64_bits(spark):
    a, big = 9 * 10 ** 15 + 7, 9 * 10 ** 16 + 11
    rows = [("en", 1, "x", big), ("en", 1, "y", big + 2), ("en", 2, "x y", a)]
    got = C.scored(spark.createDataFrame(rows, "lang string, n int, phrase string, c long")).first()
    assert got.score == 2_000_000 * a // (2 * big + 2)


def test_phrases_that_ended_below_the_threshold_are_not_written(spark, monkeypatch):
    folders, shared = [], C.shared_folder
    monkeypatch.setattr(C, "shared_folder", lambda *a: folders.append(shared(*a)) or folders[-1])
    docs = spark.createDataFrame([("en", f"a b a w{i % 4}") for i in range(24)], "lang string, text string")
    frequent, words = C.phrase_counts(docs, C.Settings(threshold=12, shards=2))
    found = {(r.n, r.phrase): r.c for r in frequent.collect()}
    assert found == {(1, "a"): 48, (1, "b"): 24, (2, "a b"): 24, (2, "b a"): 24, (3, "a b a"): 24}
    assert words.first().n_words == 96
    # Pairs of "a" and a word below the threshold are not admitted, but with every bit set they are counted, and end.
    monkeypatch.setattr(C, "bit_table", lambda rows, size: np.full(size // 8, 255, np.uint8))
    frequent, _ = C.phrase_counts(docs, C.Settings(threshold=12, shards=2))
    assert {(r.n, r.phrase): r.c for r in frequent.collect()} == found
    rows = [r for u in range(3) for r in spark.read.parquet(f"{folders[-1]}/step-{u}").where("done AND n > 1").collect()]
    assert rows and min(r.c for r in rows) >= 12


def test_longer_phrases_are_activated_while_shorter_ones_are_still_counted(spark, monkeypatch):
    steps = []
    own = C.step_counts

    def spy(docs, shipped, singles):
        out = own(docs, shipped, singles).cache()
        steps.append((singles, sorted({r.n for r in out.select("n").distinct().collect()})))
        return out

    monkeypatch.setattr(C, "step_counts", spy)
    docs = spark.createDataFrame([("en", "a b c d ")] * 400, "lang string, text string")
    assert [r.phrase for r in C.collocations(docs, C.Settings(shards=4)).collect()] == ["a b c d"]
    assert steps[:4] == [(True, [1]), (True, [1, 2]), (True, [1, 2, 3]), (True, [1, 2, 3, 4])]
    assert steps[4:] == [(False, [2, 3, 4]), (False, [3, 4]), (False, [4])][:len(steps) - 4] + [(False, [])] * max(0, len(steps) - 7)


# --- hard negatives ------------------------------------------------------------------------

def brute_negatives(rows, anchor, s):
    usable = []
    for i, (vec_id, label, vec) in enumerate(rows):
        if vec_id is None or label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        usable.append((i, vec_id, label, [int(np.floor(s.scale * x)) for x in vec]))
    out = []
    for i, a, label, v in usable:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, j, other) for j, b, other, w in usable if j != i)
        for p, b, _, _ in [x for x in scored if x[3] == label][:s.positives]:
            hits = [x for x in scored if x[3] != label and s.low * -p <= 100 * -x[0] <= s.high * -p][:s.negatives]
            out += [(a, b, k + 1, x[1], -p, -x[0]) for k, x in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("settings", [H.Settings(), H.Settings(positives=3, negatives=2, low=20, high=100, anchor_block=3, row_block=7, slab=16)])
def test_hard_negatives_equal_brute_force(spark, settings):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8)) * 0.4
    rows = [(int(i), int(rng.integers(4)), [float(np.float32(x)) for x in base[i % 6] + rng.normal(size=8) * 0.2]) for i in range(160)]
    rows += [(500 + i, i % 3, [0.5] * 8) for i in range(30)]  # ties
    rows += [(7, 1, [0.25] * 8), (600, None, [0.1] * 8), (601, 1, None), (602, 2, [0.1, None] + [0.3] * 6), (603, 2, [float("nan")] * 8),
             (604, 1, [float("inf")] + [0.0] * 7), (None, 1, [0.2] * 8), (605, 1, [0.5, 0.25]), (606, 2, []), (607, 9, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"row": F.lit("x"), "score": F.lit(0)}).repartition(3)
    got = sorted(tuple(r) for r in H.mine(vectors, F.col("id") % 5 == 0, settings).collect())
    assert got == brute_negatives(rows, lambda i: i % 5 == 0, settings) and got


def test_hard_negatives_without_rows_anchors_or_other_labels(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert H.mine(empty, F.col("id") % 5 == 0).count() == 0
    same = spark.createDataFrame([(i, 1, [1.0, 0.5]) for i in range(1, 20)], "vec_id long, label int, embedding array<float>")
    assert H.mine(same, F.col("id") % 5 == 0).count() == 0 and H.mine(same, F.lit(False)).count() == 0


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2.0 ** 30, 1.0]]), np.array([[2.0 ** 30, 1.0], [2.0 ** 30, 2.0]])
    assert H._products(a, b).tolist() == [[2 ** 60 + 1, 2 ** 60 + 2]]


# --- line dedup ----------------------------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"


def brute_lines(rows, s=L.Settings()):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    holds = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            if i is not None and len(key(x)) >= s.min_chars:
                holds.setdefault(key(x), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(holds.get(key(x), ())) < s.min_docs or i == max(holds[key(x)])]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def some_lines():
    rng = random.Random(3)
    lines = [f"A passage number {k} that many share, with é and ß" for k in range(12)] + ["short", "", "  ", "exactly twenty chars", "exactly 19 chars ab"]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str, str.upper, str.lower])(rng.choice(lines)) + rng.choice(["", "\r", "  "])
                          for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, lines[0]), (None, lines[0]), (103, (lines[0] + "\n") * 50 + "x" * 200_000)]
    return rows + [(104, lines[1]), (104, lines[1] + "\n" + lines[2]), (105, "the same words in a third of all rows"), *[(200 + i, "The same words in a third of all rows ") for i in range(40)]]


def cleaned(docs, store):
    return sorted((tuple(r) for r in L.clean(docs, store).collect()), key=repr)


def test_lines_equal_brute_force(spark):
    rows = some_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "n_lines": F.lit("y")}).repartition(4)
    assert cleaned(docs, L.ingest(docs)) == brute_lines(rows)
    tight = L.Settings(shard_keys=4, buckets=1)  # many shards, filters that overflow and are made anew
    assert cleaned(docs, L.ingest(docs, 3, tight)) == brute_lines(rows)


def test_joins_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "REPEATED_MAX", 0)
    rows = some_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cleaned(docs, L.ingest(docs)) == brute_lines(rows)


def state(spark, store):
    cells = sorted((r.shard, tuple(sorted(np.frombuffer(r.cells, np.uint16)[np.frombuffer(r.cells, np.uint16) > 0].tolist())))
                   for r in L._table(spark, L._FILTERS, store.filters).collect())
    return (sorted(tuple(r) for r in L.refs(spark, store).collect()), sorted(tuple(r) for r in L.counts(spark, store).collect()),
            [x for x in cells if x[1]])


def test_deleting_undoes_inserting(spark, tmp_path):
    s = L.Settings(shard_keys=1000, buckets=64)
    rows = [r for r in some_lines() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    one = L.insert(spark, L.empty(str(tmp_path / "s"), s), L.references(a, s))
    both = L.insert(spark, one, L.references(b, s))
    assert cleaned(docs, both) == brute_lines(rows)
    with pytest.raises(ValueError):
        L.insert(spark, both, L.references(b.limit(1), s))
    back = L.delete(spark, both, b.select("doc_id").union(spark.createDataFrame([(10 ** 6,), (None,)], "doc_id long")))
    assert state(spark, back) == state(spark, one) and state(spark, both) != state(spark, one)
    left = [r for r in rows if r[0] % 3]
    assert cleaned(a, L.reopen(spark, str(tmp_path / "s"), s)) == brute_lines(left)
    none = L.delete(spark, back, a.select("doc_id"))
    assert state(spark, none) == ([], [], [])
    assert cleaned(docs, L.insert(spark, none, L.references(docs, s))) == brute_lines(rows)


def test_line_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.clean(docs, L.ingest(docs)).count() == 0


def test_cuckoo_filter_holds_all_keys_and_forgets_removed_ones():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3300)]
    f = L.Filter(1024)
    assert f.insert(keys[:2000]) and f.insert(keys[2000:]) and f.contains(keys).all()
    assert (f.table > 0).sum() == len(keys)
    others = [hashlib.sha256(f"o{i}".encode()).digest() for i in range(5000)]
    assert f.contains(others).mean() < 0.01
    f.remove(keys[::2])
    assert f.contains(keys[1::2]).all() and f.contains(keys[::2]).mean() < 0.01 and (f.table > 0).sum() == len(keys) // 2
    assert not L.Filter(16).insert(keys[:80])
    twice = L.Filter(16)
    assert twice.insert(keys[:1] * 5)
    twice.remove(keys[:1] * 5)
    assert not (twice.table > 0).any()
    with pytest.raises(ValueError):
        twice.remove(keys[:1])


def test_lines_of_chunks():
    for texts in product(["", "\n", "a\nb", "x\n", "\n\ny "], repeat=2):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.append(0, np.cumsum([len(t) for t in texts]))
        start, end, doc = L.line_spans(data, off)
        got = [[data[a:b].tobytes().decode() for a, b, d in zip(start, end, doc) if d == k] for k in range(2)]
        assert got == [t.split("\n") for t in texts]
