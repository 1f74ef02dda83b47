"""Trained classifiers: held-out accuracy on a small table, exact solvers, awkward rows."""
import random
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa

from casewright.llm import labelled as L
from casewright.llm import language, quality, toxicity


def clean(rnd):
    return " ".join(rnd.choice(["river", "stone", "walks", "green", "under", "music", "late", "window"]) + str(rnd.randrange(30)) for _ in range(rnd.randint(5, 40)))


def awkward(spark, n=240):
    """(docs, labels): every third document has a marked word and is labelled 1; odd rows at the end."""
    rnd, docs, labels = random.Random(3), [], []
    for i in range(n):
        bad = i % 3 == 0
        docs.append((i, clean(rnd) + (" ugh!! " + clean(rnd) if bad else ""), "c", 1.0))
        labels.append((i, int(not bad), int(bad)))
    docs += [(9001, None, "c", 1.0), (9002, "", "c", 1.0), (9003, "  \n", "c", 1.0), (None, "ugh", "c", 1.0), (5, docs[5][1], "c", 1.0), (9004, "ugh " * 30000, "c", 1.0)]
    labels += [(None, 1, 1), (7, None, None), (9001, 1, 0), (3, 0, 1), (3, 0, 1), (888888, 0, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string, held_out double").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_fold_is_crc32_of_the_id(spark):
    rows = spark.range(50).select("id", L.fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def check(spark, module, target):
    docs, labels = awkward(spark)
    out = module.classify(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and set(out.columns) == {"doc_id", "text", "score", "held_out", "predicted"}
    truth = {r["doc_id"]: r[target] for r in labels.where("doc_id < 240").collect() if r[target] is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 25 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    empty = {r.score for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    one = module.classify(docs, labels.where(f"{target} = 1")).select("predicted", "score").distinct().collect()
    assert len(one) == 1 and one[0].predicted == 1
    none = module.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and none[0].score == 0.5
    assert module.classify(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    check(spark, toxicity, "toxic")


def test_quality(spark):
    check(spark, quality, "quality")


def test_ftrl_weights_are_sparse_and_signed():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(400):
        y.append(float(i % 4 == 0))
        rows.append(np.unique(np.append(rng.integers(1, 200, 12), 0 if y[-1] else 199)))
    w, _ = toxicity.ftrl(rows, np.array(y), 200, replace(toxicity.Settings(), sample_rows=400, l1=8.0))
    assert w[0] > 1 and w[0] == w.max() and (w == 0).mean() > 0.5


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(120)]
    y = np.where([3 in r or 7 in r for r in rows], 1.0, -1.0)
    ratio = rng.normal(size=30) + 2
    s = replace(quality.Settings(), epochs=300)
    w, b = quality.dual_coordinate_descent(rows, y, ratio, s)
    cost = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    x = np.zeros((120, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = quality._unit(r, ratio), 1.0

    def primal(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = np.append(w, b)
    tries = [primal(best + rng.normal(size=31) * k) for k in (1e-3, 1e-2, 0.1) for _ in range(200)]
    assert primal(best) <= min(tries) + 1e-6


def test_repeats_are_typed():
    data = pa.array(["zz zz zz zz", "zz yy zz yy"])
    _, _, raw, off = next(quality.K.chunks(data))
    found = quality.indicators(raw, off, 1 << 16)
    assert found[0, [2, 3, 4]].all() and not found[0, 5] and not found[1, [2, 3, 4]].any()


# ------------------------------------------------------------------ language

WORDS = {"aa": "ka lo mi tu ne".split(), "bb": "sch ung ier ach tz".split(), "cc": "éau ç où è ment".split()}


def spoken(rnd, lang):
    return " ".join("".join(rnd.choice(WORDS[lang]) for _ in range(3)) for _ in range(rnd.randint(4, 30)))


def test_language(spark):
    rnd, rows = random.Random(4), []
    for i in range(300):
        lang = "abc"[i % 3] * 2
        rows.append((i, spoken(rnd, lang), None if i % 50 == 0 else lang))
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (None, "kalo mitu", None), (1003, "zq" * 60000, None)]
    docs = spark.createDataFrame([(*r, "old") for r in rows + odd], "doc_id long, text string, lang string, score string").repartition(3)
    model = language.fit(docs.where(L.fold("doc_id", 3) != 1))
    assert set(model.languages) == {"aa", "bb", "cc"} and len(model.languages) <= 12
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(out) == docs.count()
    assert all(out[i].lang_pred == "abc"[i % 3] * 2 and 0 < out[i].score <= 1 for i in range(300))
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (1000, 1001, 1002))
    assert out[1003].lang_pred in WORDS and out[1003].rejected  # far from every centroid
    assert language.identify(docs, None).select("lang_pred").distinct().first()[0] == "und"
    assert language.fit(docs.limit(0)) is None


def test_long_and_short_texts_count_alike_in_any_chunk():
    column = pa.array(["Ab c!! d", "", "é" * 50, "x" * 3])
    whole = [language.counts(d, o, 256) for _, _, d, o in language.K.chunks(column)][0]
    single = np.concatenate([language.counts(d, o, 256) for _, _, d, o in language.K.chunks(column, 1)])
    assert (whole == single).all()
