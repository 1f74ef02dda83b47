"""Rule-computed failure taxonomy, intent display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.sources.tables import require_columns
from casewright.operators.policy import BILLING_ACTION_KEYWORDS, SENSITIVE_ACCOUNT_KEYWORDS, first_keyword

# Bucket names of the failure taxonomy, in report order.
FAILURE_BUCKETS = [
    "wrong_intent", "low_retrieval_similarity", "irrelevant_retrieved_evidence", "unsupported_generation",
    "hallucinated_claim", "missing_required_clarification", "unsafe_auto_handle", "unnecessary_escalation",
    "low_quality_response", "ambiguous_customer_message",
]
LOW_SIM = 0.45
# Tokens that count as the customer naming a device/platform.
DEVICE_TOKENS = ["iphone", "android", "ios", "windows", "mac", "desktop", "web", "ps4", "xbox", "tv", "phone"]
CLARIFY_TOKENS = ["device", "version", "system"]

# Display names of the intent taxonomy.
INTENT_DISPLAY_NAMES = {
    "playback_and_app_issues": "Playback & App Issues",
    "billing_and_payment": "Billing & Payment",
    "premium_and_subscription": "Premium & Subscription",
    "account_and_login": "Account & Login",
    "music_availability": "Music Availability",
    "playlist_and_library": "Playlist & Library",
    "content_metadata": "Content & Metadata",
    "feature_requests": "Feature Requests",
    "search_and_discovery": "Search & Discovery",
    "ads_and_privacy": "Ads & Privacy",
    "other_non_actionable": "Other / General Support",
}


def display_name(c) -> Column:
    """Mapped name, else each '_'-separated word with its first letter upper-cased."""
    col = F.col(c) if isinstance(c, str) else c
    mapping = F.create_map(*[F.lit(x) for kv in INTENT_DISPLAY_NAMES.items() for x in kv])
    words = F.transform(F.split(col, "_", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.coalesce(F.element_at(mapping, col), F.array_join(words, " "))


def clamp01(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col.cast("double")))


def _contains_any(col: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return out


def failure_buckets(df: DataFrame, text: str = "text", truth: str = "true_intent", pred: str = "predicted_intent",
                    sim: str = "top_retrieval_similarity", top1_intent: str = "top1_intent", reply: str = "reply",
                    n_cited: str = "evidence_count", decision: str = "decision", human: str = "human_decision",
                    primary: str = "primary_rule", halluc: str = "hallucination_flag",
                    verdict: str = "pass_fail") -> DataFrame:
    """one row per (row, bucket) it falls in; all ten buckets are evaluated, so
    every named column must be there."""
    require_columns(df, [text, truth, pred, sim, top1_intent, reply, n_cited, decision, human, primary, halluc, verdict],
                    "failure buckets")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rl = F.lower(F.coalesce(F.col(reply), F.lit("")))
    s = F.col(sim)
    # keyword matches computed by the policy are reused when present
    acc = F.col("account_keyword") if "account_keyword" in df.columns else \
        first_keyword(F.col(text), SENSITIVE_ACCOUNT_KEYWORDS)
    bill = F.col("billing_keyword") if "billing_keyword" in df.columns else \
        first_keyword(F.col(text), BILLING_ACTION_KEYWORDS)
    b = {
        "low_retrieval_similarity": s < LOW_SIM,
        "unsupported_generation": (s < LOW_SIM) & (F.trim(F.coalesce(F.col(reply), F.lit(""))) != "")
                                  & (F.coalesce(F.col(n_cited), F.lit(0)) <= 0),
        "hallucinated_claim": F.coalesce(F.col(halluc), F.lit(False)),
        "missing_required_clarification": (F.col(pred) == "playback_and_app_issues") & ~_contains_any(low, DEVICE_TOKENS)
                                          & ~_contains_any(rl, CLARIFY_TOKENS),
        "unsafe_auto_handle": (F.col(decision) == "auto_handle") & (acc.isNotNull() | bill.isNotNull()),
        "unnecessary_escalation": (F.col(decision) == "escalate")
                                  & (F.lower(F.trim(F.coalesce(F.col(human), F.lit("")))) == "auto_handle"),
        "low_quality_response": F.col(verdict) == "FAIL",
        "ambiguous_customer_message": F.col(primary) == "E7",
    }
    b["wrong_intent"] = F.col(pred) != F.col(truth)
    b["irrelevant_retrieved_evidence"] = (s >= LOW_SIM) & (F.col(top1_intent) != F.col(truth))
    arr = F.array_compact(F.array(*[F.when(F.coalesce(b[k], F.lit(False)), F.lit(k))
                                    for k in FAILURE_BUCKETS]))
    return df.select("*", F.explode(arr).alias("bucket"))


def failure_summary(rows: DataFrame, id_col: str) -> DataFrame:
    """Count per bucket and the smallest example id (one example per bucket)."""
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("example_id"))
