"""Exact and near deduplication against brute force, with awkward rows."""
import hashlib
import itertools
import random

import numpy as np
import pytest

from casewright.llm import exact_dedup as X
from casewright.llm import near_dedup as N
from tests.llm.test_kernels import words_of

SCHEMA = "doc_id long, text string, kept string, row int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(parts)


def test_exact_groups_ties_and_repeated_rows(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a\tb"), (1, None), (2, " "), (7, "c"), (7, "c"), (None, "ab "), (4, "a  b")]
    got = X.mark(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.group_size): r for r in got}
    assert by[5, 5].keep_id == 4 and by[None, 5].keep_id == 4 and not by[None, 5].kept  # "a  b" is the longest
    assert by[1, 2].keep_id == 2 and by[2, 2].kept                              # null is empty, " " is longer
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]       # one of repeated rows
    assert by[3, 5].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert X.mark(frame(spark, [])).count() == 0


def test_exact_many_runs(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(300)]
    got = {r.doc_id: r for r in X.mark(frame(spark, rows, parts=20)).collect()}
    for k in range(7):
        group = [(-len(t), i) for i, t in rows if t.split()[1] == str(k)]
        assert {got[i].keep_id for _, i in group} == {min(group)[1]} and got[min(group)[1]].group_size == len(group)


def test_exact_keep_returns_the_columns_of_its_input(spark, tmp_path):
    frame(spark, [(1, "a"), (2, "a "), (3, "b")]).write.parquet(str(tmp_path / "t"))
    kept = X.keep(spark.read.parquet(str(tmp_path / "t")))
    assert kept.columns == ["doc_id", "text", "kept", "row"] and {r.doc_id for r in kept.collect()} == {2, 3}


def test_exact_keep_does_not_rest_on_how_the_input_is_split(spark, tmp_path):
    rows = [(i, f"text {i // 2}" + " " * (i % 2)) for i in range(40)]
    frame(spark, rows, parts=8).write.parquet(str(tmp_path / "t"))
    kept = X.keep(spark.read.parquet(str(tmp_path / "t")))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    try:
        for name in names:
            spark.conf.set(name, "1k")  # as when executors come or go between two scans
        assert sorted(r.doc_id for r in kept.collect()) == list(range(1, 40, 2))
    finally:
        for name in names:
            spark.conf.unset(name)


def shingles(text, w):
    words = words_of(text)
    return {tuple(words[i:i + w]) for i in range(len(words) - w + 1)} if len(words) >= w else {tuple(words)} if words else set()


def brute(rows, w):
    sets = {i: shingles(t, w) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {i: new if v == old else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def corpus(seed=3, n=160):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(80)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two three")]
    for _ in range(n):
        if len(rows) > 20 and rnd.random() < 0.6:
            words = words_of(rnd.choice(rows[7:])[1])
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 30, 120]))]
        rows.append((len(rows) * 3, " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [2, 32])
def test_near_components_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)  # 2 sends nearly all mixed buckets through the tiles
    monkeypatch.setattr(N, "TILE", 4)
    monkeypatch.setattr(N, "PARTNERS", 2)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.link(frame(spark, rows), N.Settings(width=2)).collect()}
    assert got == brute(rows, 2)


def test_near_edge_rows(spark):
    rows = [(None, "a b c d e f"), (8, "a b c d e f"), (8, "other words here at last now"), (9, "A b  c d e f"), (2, None), (3, None)]
    got = N.link(frame(spark, rows)).collect()
    assert len(got) == 6
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in got if r.n_shingles == 0} == {2, 3}
    assert N.link(frame(spark, [])).count() == 0
    assert {r.doc_id for r in N.keep(frame(spark, rows)).collect()} == {None, 8, 2, 3}


def test_registers_estimate_the_similarity_without_bias():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[100:], rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        x, y = (N.registers(v, np.zeros(len(v), int), 1) for v in (a, b))
        n = np.array([len(a)])
        estimate, ok = N.passes(x, y, n, np.array([len(b)]), N.Settings())
        errors.append(estimate[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert ok[0]
    assert abs(np.mean(errors)) < 0.012
    far = N.registers(np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)), np.zeros(900, int), 1)
    assert not N.passes(x, far, n, n, N.Settings())[1][0]


def test_near_a_repeated_id_links_what_its_texts_link(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, b), (5, a), (5, b), (9, a + " more"), (12, "something else entirely"), (20, a), (20, "something else entirely")]
    got = N.link(frame(spark, rows), N.Settings(width=2)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id, r.kept) for r in got} == {
        (1, 1, True), (5, 1, False), (9, 1, False), (12, 1, False), (20, 1, False)}
    rows = [(3, "p q r"), (7, "x y z"), (7, "u v w"), (8, "u v w")]
    got = N.link(frame(spark, rows), N.Settings(width=2)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 3, True), (7, 7, True), (8, 7, False)}
    assert sorted(r.text for r in N.keep(frame(spark, rows), N.Settings(width=2)).collect()) == ["p q r", "u v w", "x y z"]
