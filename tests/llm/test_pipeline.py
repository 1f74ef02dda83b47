"""The pipeline's stages one by one against brute force, and the registered queries."""
import hashlib
import zlib

import public_tokenizers
import tiktoken  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from casewright.llm import registry
from tests.llm.test_exact_and_near import shingles
from tests.llm.test_text_operators import tik

SF = "/root/testdata/sf0.001"


def test_every_dealt_operator_and_the_pipeline_are_registered():
    queries = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in queries) for n in range(1, 14)] == [1] * 13 and "pipeline" in queries
    assert set(registry.ORACLE) == {"op1_decontaminate", "op3_near_dedup", "op7_exact_dedup", "op8_warc", "op11_collocations", "op12_hard_negatives", "op13_line_dedup"}
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "byte_bpe"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (None, "no id here at all", "en", "s", 1)], docs.schema)
    before = docs.union(odd)
    kept = []
    for name, stage in P.STAGES:
        path = str(tmp_path / name)
        before.write.parquet(path + "-in")
        before = stage(spark, spark.read.parquet(path + "-in"), SF)
        kept.append((spark.read.parquet(path + "-in").collect(), before.collect()))
        if name != "byte_bpe":
            assert before.columns == P.COLUMNS
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in kept[0][0]} - {r.doc_id for r in kept[0][1]}
    train = [i for i in gone if i in labels and zlib.crc32(str(i).encode()) % 5]
    assert gone and all(labels[i] == 1 for i in train) and not gone & {None, 90_001, 90_002}

    bare = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    best = {}
    for r in kept[1][0]:
        k, v = bare(r.text), (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best[k] = min(best.get(k, v), v)
    assert len(kept[1][1]) == len(best) and {(-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in kept[1][1]} == set(best.values())

    rows = [(r.doc_id, shingles(r.text, 5)) for r in kept[2][0] if r.doc_id is not None]
    label = {i: i for i, _ in rows}
    for k, (a, x) in enumerate(rows):
        for b, y in rows[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if v == old else v for i, v in label.items()}
    assert {r.doc_id for r in kept[2][1]} == {i for i, v in label.items() if i == v} | {None}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in kept[3][0] if any(t in (r.text or "") for t in items)}
    assert {r.doc_id for r in kept[3][0]} - {r.doc_id for r in kept[3][1]} == holds

    for r in kept[4][1]:
        text = next(x.text for x in kept[4][0] if x.doc_id == r.doc_id) or ""
        ids = tik().encode_ordinary(text)
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_run_applies_all_stages(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.count() < n and out.where(F.col("doc_id").isNull()).count() == 0
