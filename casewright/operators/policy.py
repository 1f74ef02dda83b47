"""The auto-handle / escalate rule policy as column expressions.

Everything is Catalyst expressions (literal regex patterns compiled once
per task, one CASE cascade for the decision), so the policy, its safety
metrics and the whole threshold grid run inside whole-stage codegen with
no Python per row. The 20-cell sensitivity grid is evaluated as 20 column
expressions over a single scan and unpivoted afterwards, instead of
multiplying the input by a config table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import WORD, WS, py_strip, py_words, whole_word_pattern

# Sensitive account / security keywords.
SENSITIVE_ACCOUNT_KEYWORDS = [
    "hack", "hacked", "hacking", "compromise", "compromised", "password", "passwords",
    "stolen", "hijack", "hijacked", "unauthorized", "unauthorised", "locked out", "lockout", "locked",
    "breach", "breached", "credentials", "credential", "recover", "recovery", "stolen account",
    "reset password", "cant log in", "can't log in", "cannot log in", "disabled account", "suspended",
]
# Billing actions that need a human.
BILLING_ACTION_KEYWORDS = [
    "refund", "refunds", "refunding", "double charge", "charged twice", "charge twice", "two charges",
    "dispute", "disputed", "disputing", "overcharge", "overcharged", "bank", "bank statement",
    "unauthorized charge", "fraudulent", "money back", "billing error", "charged again",
    "cancel subscription", "deducted twice", "deducted",
]
# Greeting / thanks / acknowledgement openers.
GREETING_OPENERS = [
    ["hi", "hello", "hey", "hey there", "good morning", "good afternoon", "good evening", "greetings"],
    ["thanks", "thank you", "thx", "ty", "appreciate it", "cheers"],
    ["ok", "okay", "got it", "cool", "sounds good", "understood"],
]
GREETING_MAX_WORDS = 8

# Decision reasons.
REASONS = {
    "E0": "Escalated because the customer message is empty, whitespace, or invalid.",
    "E3": "Escalated because response generation failed or could not produce a valid reply.",
    "E4": "Escalated because the response lacks sufficient grounding in retrieved historical cases.",
    "E2": "Escalated because historical evidence is insufficient: top retrieval similarity is "
          "%.2f, below the configured threshold of %.2f (usable cases: %d).",
    "E1": "Escalated because intent confidence is below the configured threshold (%.2f < %.2f), "
          "so the system cannot reliably determine the customer's issue.",
    "E5": "Escalated because sensitive account or security credentials/access issue%s "
          "requires secure human verification.",
    "E6": "Escalated because financial transactions, refund requests, or disputed charges%s "
          "require authorized human account investigation.",
    "E7": "Escalated because the request is ambiguous, non-actionable, or lacks sufficient issue "
          "details to resolve safely.",
    "E7_GREETING": "Auto-handled because the message is a polite greeting or acknowledgment that does not "
                   "require customer support intervention.",
    "E8": "Auto-handled because the customer is submitting a straightforward feature suggestion "
          "and received a grounded informational response.",
    "A1": "Auto-handled because the intent is confident ('%s' @ %.2f), relevant historical cases were "
          "retrieved (top similarity %.2f), and the generated reply is grounded in the retrieved evidence.",
}


@dataclass(frozen=True)
class PolicyConfig:
    """Thresholds and switches, validated like the reference's model."""
    min_intent_confidence: float = 0.20
    min_retrieval_similarity: float = 0.45
    min_evidence_count: int = 1
    strict_account_security: bool = True
    strict_billing_actions: bool = True
    auto_handle_greetings: bool = True
    auto_handle_feature_requests: bool = True

    def __post_init__(self):
        if not 0.0 <= self.min_intent_confidence <= 1.0:
            raise ValueError("min_intent_confidence must be in [0, 1]")
        if not 0.0 <= self.min_retrieval_similarity <= 1.0:
            raise ValueError("min_retrieval_similarity must be in [0, 1]")
        if self.min_evidence_count < 1:
            raise ValueError("min_evidence_count must be >= 1")

    def with_thresholds(self, conf: float, sim: float) -> "PolicyConfig":
        return replace(self, min_intent_confidence=conf, min_retrieval_similarity=sim)


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in s)


def trie_pattern(words: list[str]) -> str:
    """An alternation of ``words`` factored by common prefixes (Java regex
    does not build a trie itself), so each text position tries only the
    branch that matches its first character."""
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        end = "" in node
        branches = [_regex_escape(ch) + emit(child) for ch, child in sorted(node.items()) if ch != ""]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if end else body

    return "(?:" + emit(tree) + ")"


def ordered_keywords(keywords: list[str]) -> list[str]:
    """Longest first; equal lengths alphabetical (a stable, documented order)."""
    return sorted(set(keywords), key=lambda k: (-len(k), k))


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """First keyword (in ``ordered_keywords`` order) present as a whole word.

    One alternation test gates the per-keyword cascade, so rows without
    any keyword cost a single regex scan.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    kws = ordered_keywords(keywords)
    any_pat = whole_word_pattern(trie_pattern(kws))
    chain = F.coalesce(*[F.when(low.rlike(whole_word_pattern(_regex_escape(k))), F.lit(k)) for k in kws])
    return F.when(low.rlike(any_pat), chain)


def greeting_flag(text: Column) -> Column:
    """R2: a short (<= 8 words) message opening with a greeting/thanks/ack phrase."""
    inner = WS[1:-1]
    cleaned = F.regexp_replace(F.lower(py_strip(F.coalesce(text, F.lit("")))), f"[^\\p{{L}}\\p{{N}}_{inner}]", "")
    starts = F.lit(False)
    for group in GREETING_OPENERS:
        starts = starts | cleaned.rlike("^(?:" + "|".join(_regex_escape(g) for g in group) + f")(?!{WORD})")
    # anchored opener test first; words are only counted for rows that open with one
    return F.when(starts, F.size(py_words(cleaned)) <= GREETING_MAX_WORDS).otherwise(F.lit(False))


def _signals(df: DataFrame, cfg: PolicyConfig, text: str, intent: str, conf: str, sim: str, count: str,
             status: str, reply: str) -> DataFrame:
    msg = py_strip(F.coalesce(F.col(text), F.lit("")))
    rep = py_strip(F.coalesce(F.col(reply), F.lit("")))
    acc_kw = first_keyword(F.col(text), SENSITIVE_ACCOUNT_KEYWORDS)
    bill_kw = first_keyword(F.col(text), BILLING_ACTION_KEYWORDS)
    return df.withColumns({
        "_msg": msg,
        "_e0": (msg == "") | (F.length(msg) < 2),
        "_e3": (F.col(status) == "generation_failed") | (rep == ""),
        "_e4": F.col(status) == "insufficient_evidence",
        "_acc_kw": acc_kw, "_bill_kw": bill_kw,
        "_e5": (F.col(intent) == "account_and_login") & acc_kw.isNotNull() & F.lit(cfg.strict_account_security),
        "_e6": (F.col(intent) == "billing_and_payment") & bill_kw.isNotNull() & F.lit(cfg.strict_billing_actions),
        "_greet": (F.col(intent) == "other_non_actionable") & F.lit(cfg.auto_handle_greetings) & greeting_flag(msg),
        "_other": F.col(intent) == "other_non_actionable",
        "_e8": (F.col(intent) == "feature_requests") & F.lit(cfg.auto_handle_feature_requests),
    })


def decide(df: DataFrame, cfg: PolicyConfig = PolicyConfig(), text: str = "text", intent: str = "predicted_intent",
           conf: str = "intent_confidence", sim: str = "top_retrieval_similarity", count: str = "evidence_count",
           status: str = "grounding_status", reply: str = "reply_text") -> DataFrame:
    """Adds decision, risk_level, primary_rule, rules_triggered, reason."""
    s = _signals(df, cfg, text, intent, conf, sim, count, status, reply)
    e2 = (F.col(sim) < cfg.min_retrieval_similarity) | (F.col(count) < cfg.min_evidence_count)
    e1 = F.col(conf) < cfg.min_intent_confidence
    e7a = F.col("_other") & ~F.col("_greet")
    triggers = F.array_compact(F.array(
        F.when(F.col("_e0"), "E0"), F.when(F.col("_e3"), "E3"), F.when(F.col("_e4"), "E4"),
        F.when(e2, "E2"), F.when(e1, "E1"), F.when(F.col("_e5"), "E5"), F.when(F.col("_e6"), "E6"),
        F.when(F.col("_greet"), "E7_GREETING").when(e7a, "E7_AMBIGUOUS"), F.when(F.col("_e8"), "E8_FEATURE_REQUEST")))
    primary = (F.when(F.col("_e0"), "E0").when(F.col("_e3"), "E3").when(F.col("_e4"), "E4").when(e2, "E2")
                .when(e1, "E1").when(F.col("_e5"), "E5").when(F.col("_e6"), "E6").when(e7a, "E7")
                .when(F.col("_greet"), "E7_GREETING").when(F.col("_e8"), "E8").otherwise("A1"))
    p = F.col("primary_rule")
    risk = F.when(p.isin("E0", "E3", "E5", "E6"), "high").when(p.isin("E4", "E2", "E1", "E7"), "medium").otherwise("low")
    decision = F.when(p.isin("E7_GREETING", "E8", "A1"), "auto_handle").otherwise("escalate")
    kw_note = lambda c: F.when(F.col(c).isNotNull(), F.format_string(" ('%s')", F.col(c))).otherwise(F.lit(""))
    reason = (F.when(p == "E2", F.format_string(REASONS["E2"], F.col(sim).cast("double"),
                                                F.lit(cfg.min_retrieval_similarity), F.col(count).cast("int")))
               .when(p == "E1", F.format_string(REASONS["E1"], F.col(conf).cast("double"),
                                                F.lit(cfg.min_intent_confidence)))
               .when(p == "E5", F.format_string(REASONS["E5"], kw_note("_acc_kw")))
               .when(p == "E6", F.format_string(REASONS["E6"], kw_note("_bill_kw")))
               .when(p == "A1", F.format_string(REASONS["A1"], F.col(intent), F.col(conf).cast("double"),
                                                F.col(sim).cast("double"))))
    for rule in ("E0", "E3", "E4", "E7", "E7_GREETING", "E8"):
        reason = reason.when(p == rule, F.lit(REASONS[rule]))
    out = s.withColumn("primary_rule", primary).withColumns({
        "decision": decision, "risk_level": risk,
        "rules_triggered": F.array_join(F.when(p == "A1", F.concat(triggers, F.array(F.lit("A1"))))
                                         .otherwise(triggers), ","),
        "matched_keyword": F.when(p == "E5", F.col("_acc_kw")).when(p == "E6", F.col("_bill_kw")),
        "account_keyword": F.col("_acc_kw"), "billing_keyword": F.col("_bill_kw"),
        "reason": reason})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def decision_violations(decisions: DataFrame, conf: str = "intent_confidence",
                        sim: str = "top_retrieval_similarity", count: str = "evidence_count") -> DataFrame:
    """Per contract rule, how many decisions violate it (zero-filled)."""
    checks = {
        "decision_enum": ~F.coalesce(F.col("decision").isin("auto_handle", "escalate"), F.lit(False)),
        "risk_enum": ~F.coalesce(F.col("risk_level").isin("low", "medium", "high"), F.lit(False)),
        "confidence_range": ~F.coalesce(F.col(conf).between(0.0, 1.0), F.lit(False)),
        "similarity_range": ~F.coalesce(F.col(sim).between(-1.0, 1.0), F.lit(False)),
        "evidence_count_nonneg": ~F.coalesce(F.col(count) >= 0, F.lit(False)),
        "reason_nonblank": F.col("reason").isNull() | (py_strip("reason") == ""),
    }
    agg = decisions.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    stack = ", ".join(f"'{k}', {k}" for k in checks)
    return agg.selectExpr(f"stack({len(checks)}, {stack}) AS (rule, violations)")


def rule_distribution(decisions: DataFrame) -> DataFrame:
    """Count and share per (primary_rule, decision)."""
    from pyspark.sql import Window
    g = decisions.groupBy("primary_rule", "decision").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


HUMAN_LABELS = ("auto_handle", "escalate")
MIN_LABELS = 5


def safety_metrics(decisions: DataFrame, human_col: str = "human_decision") -> DataFrame:
    """Escalation treated as the positive class; gated below 5 labels."""
    h = F.lower(py_strip(F.coalesce(F.col(human_col), F.lit(""))))
    labelled = h.isin(*HUMAN_LABELS)
    pe, pa = F.col("decision") == "escalate", F.col("decision") == "auto_handle"
    he, ha = labelled & (h == "escalate"), labelled & (h == "auto_handle")
    a = decisions.agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(labelled).alias("labeled_samples"),
        F.count_if(pa).alias("_auto"), F.count_if(pe).alias("_esc"),
        F.count_if(pe & he).alias("tp"), F.count_if(pe & ha).alias("fp"),
        F.count_if(pa & he).alias("fn"), F.count_if(pa & ha).alias("tn"))
    ok = F.col("labeled_samples") >= MIN_LABELS
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    gate = lambda c: F.when(ok, c)
    n = F.col("total_samples")
    lab = F.col("labeled_samples")
    return a.select(
        "total_samples", "labeled_samples",
        F.round(F.col("_auto") / n, 4).alias("auto_handle_rate"), F.round(F.col("_esc") / n, 4).alias("escalation_rate"),
        gate(F.round(F.col("fn") / lab, 4)).alias("unsafe_auto_handle_rate"),
        gate(F.round(F.col("fp") / lab, 4)).alias("missed_auto_handle_rate"),
        gate(F.col("tp")).alias("tp"), gate(F.col("fp")).alias("fp"), gate(F.col("fn")).alias("fn"),
        gate(F.col("tn")).alias("tn"),
        gate(F.round(prec, 4)).alias("precision"), gate(F.round(rec, 4)).alias("recall"),
        gate(F.round(f1, 4)).alias("f1"),
        F.when(ok, "OK").otherwise("HUMAN_REVIEW_REQUIRED").alias("status"))


# The sensitivity grid axes and the default cell.
GRID_CONFIDENCE = [0.15, 0.20, 0.25, 0.30]
GRID_SIMILARITY = [0.35, 0.40, 0.45, 0.50, 0.55]
GRID_EVIDENCE_COUNT = 3
GRID_REPLY = "Mock grounded reply for sensitivity test."


def threshold_grid(df: DataFrame, cfg: PolicyConfig = PolicyConfig(), conf_values=GRID_CONFIDENCE,
                   sim_values=GRID_SIMILARITY, text: str = "text", intent: str = "predicted_intent",
                   conf: str = "intent_confidence", sim: str = "top_retrieval_similarity",
                   status: str = "grounding_status") -> DataFrame:
    """A19 + J9: every (confidence, similarity) cell in one scan.

    Threshold-free rules are evaluated once; each cell adds only its two
    comparisons. Counts for all cells come from a single aggregate, which
    ``stack`` turns into one row per cell.
    """
    base = df.withColumn("_count", F.lit(GRID_EVIDENCE_COUNT)).withColumn("_reply", F.lit(GRID_REPLY))
    s = _signals(base, cfg, text, intent, conf, sim, "_count", status, "_reply")
    pre = F.col("_e0") | F.col("_e3") | F.col("_e4")
    post = F.col("_e5") | F.col("_e6") | (F.col("_other") & ~F.col("_greet"))
    count_ok = F.lit(GRID_EVIDENCE_COUNT >= cfg.min_evidence_count)
    aggs, cells = [], []
    for i, c in enumerate(conf_values):
        for j, v in enumerate(sim_values):
            e2 = (F.col(sim) < v) | ~count_ok
            e1 = F.col(conf) < c
            esc = pre | e2 | e1 | post
            k = f"c{i}_{j}"
            aggs += [F.count_if(~esc).alias(f"{k}_auto"), F.count_if(esc).alias(f"{k}_esc"),
                     F.count_if(~pre & e2).alias(f"{k}_e2"), F.count_if(~pre & ~e2 & e1).alias(f"{k}_e1")]
            cells.append((c, v, k))
    a = s.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    stack = ", ".join(f"CAST({c} AS DOUBLE), CAST({v} AS DOUBLE), {k}_auto, {k}_esc, {k}_e1, {k}_e2"
                      for c, v, k in cells)
    g = a.selectExpr("_n", f"stack({len(cells)}, {stack}) AS (min_intent_confidence, min_retrieval_similarity, "
                           "auto_handle_count, escalate_count, e1_count, e2_count)")
    rate = F.round(F.col("auto_handle_count") / F.col("_n"), 4)
    return g.select("min_intent_confidence", "min_retrieval_similarity", "auto_handle_count", "escalate_count",
                    rate.alias("auto_handle_rate"), F.round(1.0 - F.col("auto_handle_count") / F.col("_n"), 4)
                    .alias("escalation_rate"), "e1_count", "e2_count",
                    ((F.col("min_intent_confidence") == cfg.min_intent_confidence) &
                     (F.col("min_retrieval_similarity") == cfg.min_retrieval_similarity)).alias("is_default"))


def threshold_pivot(grid: DataFrame, sim_values=GRID_SIMILARITY) -> DataFrame:
    """Confidence rows x similarity columns of the auto-handle rate."""
    p = grid.groupBy("min_intent_confidence").pivot("min_retrieval_similarity", [float(v) for v in sim_values]) \
            .agg(F.first("auto_handle_rate"))
    for v in sim_values:
        p = p.withColumnRenamed(str(float(v)), "sim_" + f"{v:.2f}".replace(".", "_"))
    return p
