"""Physical-plan checks: no cartesian products or nested-loop joins anywhere,
and the scans read only the columns they need."""
import __spark_entry__ as E
from casewright.plans import catalog
from conftest import SF_SMALL

SLOW = {"intent_models", "intent_model_metrics", "intent_model_confusion", "retrieved_intent_metrics", "stream_assist", "stream_stats"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    bad = {}
    catalog.load_all()
    for name, fn in catalog.QUERIES.items():
        if name in SLOW:
            continue
        plan = _plan(fn(spark, SF_SMALL))
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_scan_prunes_columns(spark):
    plan = _plan(E.queries()["clean_text"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan or "struct<doc_id:bigint,text:string>" in plan
    assert "lang" not in plan.split("ReadSchema")[-1].split("\n")[0]
