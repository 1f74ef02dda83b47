"""Driver contract, oracle spot checks, and stream result == batch result."""
import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as E
from casewright.sources.tables import TABLES
from conftest import SF_SMALL

SPOT = ["case_corpus", "conversation_roots", "policy_decisions", "knn_topk", "judge_scores", "rater_agreement",
        "threshold_grid", "draft_reply"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["case_id", "customer_tweet_id", "support_tweet_id", "customer_text", "support_text",
                          "created_at", "intent", "conversation_id", "customer_author_id"]
    rows = df.collect()
    assert len(rows) > 0
    assert [r["case_id"] for r in sorted(rows, key=lambda r: r["customer_tweet_id"])] == \
        [f"case_{i:05d}" for i in range(1, len(rows) + 1)]


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def test_oracle_spot_checks(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    for name in SPOT:
        sdf = qs[name](spark, SF_SMALL)
        cols = sdf.columns
        srows = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
        cur = con.execute(sql[name])
        dcols = [d[0] for d in cur.description]
        idx = [dcols.index(c) for c in cols]
        drows = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
        assert srows == drows, name


def test_stream_equals_batch(spark):
    qs = E.queries()
    stream = qs["stream_assist"](spark, SF_SMALL)
    batch = qs["assist_batch"](spark, SF_SMALL)
    admitted = qs["admission_filter"](spark, SF_SMALL).filter("accepted").select("msg_id")
    expected = batch.join(admitted, "msg_id", "left_semi")
    assert stream.count() == expected.count()
    assert stream.exceptAll(expected.select(*stream.columns)).count() == 0
    from casewright.sources import fixtures as FX
    stats = qs["stream_stats"](spark, SF_SMALL).first()
    assert stats["analysed"] == FX.signals(spark, SF_SMALL).count()


def test_corpus_contract_and_no_leakage(spark):
    import pytest
    from casewright.operators import corpus as C
    from casewright.operators.quality import check_case_contract
    from casewright.sources import fixtures as FX
    cases = E.entry(spark)
    check_case_contract(cases)
    C.assert_no_leakage(cases, FX.tweet_golden(spark, SF_SMALL))
    golden = FX.tweet_golden(spark, SF_SMALL)
    with pytest.raises(ValueError):
        C.assert_no_leakage(FX.docs_cases(spark, SF_SMALL),
                            FX.docs_golden(spark, SF_SMALL))
    assert golden.count() > 0
