"""Rule policy: one case per rule, priority and threshold boundaries."""
import pytest
from pyspark.sql import functions as F

from casewright.operators import policy as P

COLS = ("text string, predicted_intent string, intent_confidence double, top_retrieval_similarity double, "
        "evidence_count int, grounding_status string, reply_text string")
GOOD = "We can help, DM us"

CASES = [
    # message, intent, conf, sim, count, status, reply -> decision, risk, primary
    ("", "billing_and_payment", 0.9, 0.9, 3, "grounded", GOOD, "escalate", "high", "E0"),
    ("x", "billing_and_payment", 0.9, 0.9, 3, "grounded", GOOD, "escalate", "high", "E0"),
    ("my app crashes", "playback_and_app_issues", 0.9, 0.9, 3, "generation_failed", GOOD, "escalate", "high", "E3"),
    ("my app crashes", "playback_and_app_issues", 0.9, 0.9, 3, "grounded", "   ", "escalate", "high", "E3"),
    ("my app crashes", "playback_and_app_issues", 0.9, 0.9, 3, "insufficient_evidence", GOOD, "escalate", "medium", "E4"),
    ("my app crashes", "playback_and_app_issues", 0.9, 0.30, 3, "grounded", GOOD, "escalate", "medium", "E2"),
    ("my app crashes", "playback_and_app_issues", 0.9, 0.9, 0, "grounded", GOOD, "escalate", "medium", "E2"),
    ("my app crashes", "playback_and_app_issues", 0.10, 0.9, 3, "grounded", GOOD, "escalate", "medium", "E1"),
    ("my account was hacked", "account_and_login", 0.9, 0.9, 3, "grounded", GOOD, "escalate", "high", "E5"),
    ("please refund me", "billing_and_payment", 0.9, 0.9, 3, "grounded", GOOD, "escalate", "high", "E6"),
    ("please refund me", "playback_and_app_issues", 0.9, 0.9, 3, "grounded", GOOD, "auto_handle", "low", "A1"),
    ("what is this even", "other_non_actionable", 0.9, 0.9, 3, "grounded", GOOD, "escalate", "medium", "E7"),
    ("Thanks a lot!", "other_non_actionable", 0.9, 0.9, 3, "grounded", GOOD, "auto_handle", "low", "E7_GREETING"),
    ("hey there how are you all doing today friends", "other_non_actionable", 0.9, 0.9, 3, "grounded", GOOD,
     "escalate", "medium", "E7"),
    ("add a sleep timer", "feature_requests", 0.9, 0.9, 3, "grounded", GOOD, "auto_handle", "low", "E8"),
    ("my app crashes", "playback_and_app_issues", 0.9, 0.9, 3, "grounded", GOOD, "auto_handle", "low", "A1"),
    # boundaries: equal to the threshold passes, just below fails
    ("my app crashes", "playback_and_app_issues", 0.20, 0.45, 1, "grounded", GOOD, "auto_handle", "low", "A1"),
    ("my app crashes", "playback_and_app_issues", 0.1999, 0.9, 3, "grounded", GOOD, "escalate", "medium", "E1"),
    ("my app crashes", "playback_and_app_issues", 0.9, 0.4499, 3, "grounded", GOOD, "escalate", "medium", "E2"),
    # priority: E0 beats everything, E2 beats E1, E1 beats E5
    ("", "account_and_login", 0.1, 0.1, 0, "generation_failed", "", "escalate", "high", "E0"),
    ("hacked", "account_and_login", 0.1, 0.1, 3, "grounded", GOOD, "escalate", "medium", "E2"),
    ("hacked account", "account_and_login", 0.1, 0.9, 3, "grounded", GOOD, "escalate", "medium", "E1"),
]


@pytest.fixture(scope="module")
def decided(spark):
    rows = [c[:7] for c in CASES]
    df = spark.createDataFrame(rows, COLS).withColumn("i", F.monotonically_increasing_id())
    return {r["i"]: r for r in P.decide(df).collect()}


def test_each_case(decided):
    got = [decided[i] for i in sorted(decided)]
    for case, row in zip(CASES, got):
        assert (row["decision"], row["risk_level"], row["primary_rule"]) == case[7:], case


def test_triggers_and_reason(decided):
    got = [decided[i] for i in sorted(decided)]
    e5 = got[8]
    assert e5["rules_triggered"] == "E5" and "('hacked')" in e5["reason"]
    a1 = got[15]
    assert a1["rules_triggered"] == "A1"
    assert "@ 0.90" in a1["reason"] and "top similarity 0.90" in a1["reason"]
    e2 = got[5]
    assert "0.30, below the configured threshold of 0.45 (usable cases: 3)" in e2["reason"]
    prio = got[19]
    assert prio["rules_triggered"].split(",")[:3] == ["E0", "E3", "E2"]


def test_keyword_order_longest_first(spark):
    df = spark.createDataFrame([("I got locked out and my bank statement shows a refund",)], "text string")
    r = df.select(P.first_keyword(F.col("text"), P.SENSITIVE_ACCOUNT_KEYWORDS).alias("a"),
                  P.first_keyword(F.col("text"), P.BILLING_ACTION_KEYWORDS).alias("b")).first()
    assert r["a"] == "locked out" and r["b"] == "bank statement"


def test_whole_word_and_unicode(spark):
    df = spark.createDataFrame([("unhackable passwordless",), ("éhack",), ("hack!",)], "text string")
    got = [r[0] for r in df.select(P.first_keyword(F.col("text"), P.SENSITIVE_ACCOUNT_KEYWORDS)).collect()]
    assert got == [None, None, "hack"]


def test_config_validation():
    with pytest.raises(ValueError):
        P.PolicyConfig(min_intent_confidence=1.5)
    with pytest.raises(ValueError):
        P.PolicyConfig(min_evidence_count=0)


def test_safety_metrics_hand_case(spark):
    rows = [("auto_handle", "auto_handle"), ("auto_handle", "escalate"), ("escalate", "escalate"),
            ("escalate", " Auto_Handle"), ("auto_handle", "auto_handle")]
    df = spark.createDataFrame(rows, "decision string, human_decision string")
    r = P.safety_metrics(df).first()
    assert (r["auto_handle_rate"], r["escalation_rate"]) == (0.6, 0.4)
    assert (r["unsafe_auto_handle_rate"], r["missed_auto_handle_rate"]) == (0.2, 0.2)
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 2)
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    assert r["status"] == "OK"


def test_safety_gate(spark):
    df = spark.createDataFrame([("escalate", "")] * 3 + [("auto_handle", "escalate")], "decision string, human_decision string")
    r = P.safety_metrics(df).first()
    assert r["status"] == "HUMAN_REVIEW_REQUIRED" and r["precision"] is None


def test_grid_monotone_in_confidence(spark):
    df = spark.createDataFrame([
        ("my app crashes", "playback_and_app_issues", 0.22, 0.48, "grounded"),
        ("give refund", "billing_and_payment", 0.18, 0.42, "grounded")],
        "text string, predicted_intent string, intent_confidence double, top_retrieval_similarity double, "
        "grounding_status string")
    g = P.threshold_grid(df, conf_values=[0.15, 0.30], sim_values=[0.35, 0.55]).collect()
    assert len(g) == 4
    lax = [r["auto_handle_rate"] for r in g if r["min_intent_confidence"] == 0.15]
    strict = [r["auto_handle_rate"] for r in g if r["min_intent_confidence"] == 0.30]
    assert sum(lax) >= sum(strict)
