"""Property tests: Python string semantics and partitioning invariance."""
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from casewright.functions.text import norm_key, py_strip, word_count, words_min_len
from casewright.operators import corpus as C
from casewright.operators import policy as P
from conftest import SF_SMALL
from casewright.sources import fixtures as FX

ALPHABET = st.sampled_from(list("aZé_9 \t\n\x0b\x85\xa0 　-!?.'\"ß中") + [" "])
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=25)


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_strip_norm_words_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = df.select("i", py_strip("t").alias("s"), norm_key("t").alias("k"), word_count("t").alias("w"),
                     words_min_len("t", 4).alias("w4")).orderBy("i").collect()
    for t, r in zip(texts, rows):
        assert r["s"] == t.strip()
        assert r["k"] == t.strip().lower()
        assert r["w"] == len(t.split())
        assert sorted(r["w4"]) == sorted(set(re.findall(r"\w{4,}", t)))


def _sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_results_do_not_depend_on_partitioning(spark):
    cases = FX.docs_cases(spark, SF_SMALL)
    a = _sorted_rows(C.dedup_longest_reply(cases))
    b = _sorted_rows(C.dedup_longest_reply(cases.repartition(7, "customer_text")))
    assert a == b
    sig = FX.signals(spark, SF_SMALL)
    cols = ["msg_id", "decision", "primary_rule", "rules_triggered", "reason"]
    assert _sorted_rows(P.decide(sig).select(cols)) == _sorted_rows(P.decide(sig.repartition(5)).select(cols))
    from casewright.operators.knn import knn_topk
    v = FX.vectors(spark, SF_SMALL)
    q, c = v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "case_id")
    one = _sorted_rows(knn_topk(q, c, 3, exclude_self=True).select("query_id", "rank", "case_id"))
    many = _sorted_rows(knn_topk(q, c.repartition(6), 3, exclude_self=True).select("query_id", "rank", "case_id"))
    assert one == many
