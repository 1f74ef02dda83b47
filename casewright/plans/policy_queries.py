"""Queries for the rule policy, its contract, distribution, safety metrics and grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions.text import WS
from casewright.operators import policy as P
from casewright.plans.catalog import query
from casewright.plans.oracle_views import strip_sql, with_views, words_sql
from casewright.sources import fixtures as FX

_NW = r"[^\p{L}\p{N}_]"


def _q(s: str) -> str:
    return s.replace("'", "''")


def kw_sql(text: str, keywords: list[str]) -> str:
    low = f"lower(coalesce({text}, ''))"
    whens = " ".join(
        f"WHEN regexp_matches({low}, '(^|{_NW}){_q(P._regex_escape(k))}($|{_NW})') THEN '{_q(k)}'"
        for k in P.ordered_keywords(keywords))
    return f"CASE {whens} END"


def greeting_sql(msg: str) -> str:
    cleaned = f"regexp_replace(lower({msg}), '[^\\p{{L}}\\p{{N}}_{WS[1:-1]}]', '', 'g')"
    n = f"len({words_sql(cleaned)})"
    starts = " OR ".join(
        f"regexp_matches({cleaned}, '^({'|'.join(_q(P._regex_escape(g)) for g in grp)})($|{_NW})')"
        for grp in P.GREETING_OPENERS)
    return f"({n} > 0 AND {n} <= {P.GREETING_MAX_WORDS} AND ({starts}))"


def flags_cte(src: str, cfg: P.PolicyConfig, count: str = "evidence_count", reply: str = "reply_text",
              name: str = "flags") -> str:
    msg = strip_sql("coalesce(text, '')")
    rep = strip_sql(f"coalesce({reply}, '')")
    return f"""{name} AS (SELECT *,
      ({msg} = '' OR length({msg}) < 2) AS e0,
      (grounding_status = 'generation_failed' OR {rep} = '') AS e3,
      (grounding_status = 'insufficient_evidence') AS e4,
      {kw_sql('text', P.SENSITIVE_ACCOUNT_KEYWORDS)} AS acc_kw,
      {kw_sql('text', P.BILLING_ACTION_KEYWORDS)} AS bill_kw,
      (predicted_intent = 'other_non_actionable' AND {str(cfg.auto_handle_greetings).lower()} AND {greeting_sql(msg)}) AS greet,
      (predicted_intent = 'other_non_actionable') AS other_,
      (predicted_intent = 'feature_requests' AND {str(cfg.auto_handle_feature_requests).lower()}) AS e8,
      {count} AS cnt_
    FROM {src})"""


def decisions_cte(cfg: P.PolicyConfig = P.PolicyConfig()) -> list[str]:
    e2 = f"(top_retrieval_similarity < {cfg.min_retrieval_similarity} OR cnt_ < {cfg.min_evidence_count})"
    e1 = f"(intent_confidence < {cfg.min_intent_confidence})"
    e5 = f"(predicted_intent = 'account_and_login' AND acc_kw IS NOT NULL AND {str(cfg.strict_account_security).lower()})"
    e6 = f"(predicted_intent = 'billing_and_payment' AND bill_kw IS NOT NULL AND {str(cfg.strict_billing_actions).lower()})"
    e7a = "(other_ AND NOT greet)"
    prim = f"""(SELECT *, CASE WHEN e0 THEN 'E0' WHEN e3 THEN 'E3' WHEN e4 THEN 'E4' WHEN {e2} THEN 'E2'
        WHEN {e1} THEN 'E1' WHEN {e5} THEN 'E5' WHEN {e6} THEN 'E6' WHEN {e7a} THEN 'E7'
        WHEN greet THEN 'E7_GREETING' WHEN e8 THEN 'E8' ELSE 'A1' END AS primary_rule,
        concat_ws(',', CASE WHEN e0 THEN 'E0' END, CASE WHEN e3 THEN 'E3' END, CASE WHEN e4 THEN 'E4' END,
          CASE WHEN {e2} THEN 'E2' END, CASE WHEN {e1} THEN 'E1' END, CASE WHEN {e5} THEN 'E5' END,
          CASE WHEN {e6} THEN 'E6' END, CASE WHEN greet THEN 'E7_GREETING' WHEN {e7a} THEN 'E7_AMBIGUOUS' END,
          CASE WHEN e8 THEN 'E8_FEATURE_REQUEST' END) AS trig FROM flags)"""
    r = P.REASONS
    note = lambda c: f"CASE WHEN {c} IS NOT NULL THEN printf(' (''%s'')', {c}) ELSE '' END"
    reason = f"""CASE primary_rule
        WHEN 'E2' THEN printf('{_q(r["E2"])}', CAST(top_retrieval_similarity AS DOUBLE), CAST({cfg.min_retrieval_similarity} AS DOUBLE), CAST(cnt_ AS INTEGER))
        WHEN 'E1' THEN printf('{_q(r["E1"])}', CAST(intent_confidence AS DOUBLE), CAST({cfg.min_intent_confidence} AS DOUBLE))
        WHEN 'E5' THEN printf('{_q(r["E5"])}', {note('acc_kw')})
        WHEN 'E6' THEN printf('{_q(r["E6"])}', {note('bill_kw')})
        WHEN 'A1' THEN printf('{_q(r["A1"])}', predicted_intent, CAST(intent_confidence AS DOUBLE), CAST(top_retrieval_similarity AS DOUBLE))
        """ + " ".join(f"WHEN '{k}' THEN '{_q(r[k])}'" for k in ("E0", "E3", "E4", "E7", "E7_GREETING", "E8")) + " END"
    return [f"""decisions AS (SELECT *,
      CASE WHEN primary_rule IN ('E7_GREETING', 'E8', 'A1') THEN 'auto_handle' ELSE 'escalate' END AS decision,
      CASE WHEN primary_rule IN ('E0', 'E3', 'E5', 'E6') THEN 'high'
           WHEN primary_rule IN ('E4', 'E2', 'E1', 'E7') THEN 'medium' ELSE 'low' END AS risk_level,
      CASE WHEN primary_rule = 'A1' THEN concat_ws(',', nullif(trig, ''), 'A1') ELSE trig END AS rules_triggered,
      CASE primary_rule WHEN 'E5' THEN acc_kw WHEN 'E6' THEN bill_kw END AS matched_keyword,
      {reason} AS reason
    FROM {prim} p)"""]


POLICY_CTES = [flags_cte("signals", P.PolicyConfig())] + decisions_cte()


def _decisions(spark, sf_dir):
    return P.decide(FX.signals(spark, sf_dir))


@query("keyword_match", "R1", with_views(["messages"], f"""
SELECT msg_id, {kw_sql('text', P.SENSITIVE_ACCOUNT_KEYWORDS)} AS account_keyword,
       {kw_sql('text', P.BILLING_ACTION_KEYWORDS)} AS billing_keyword
FROM messages"""))
def q_keyword_match(spark, sf_dir):
    m = FX.messages(spark, sf_dir)
    return m.select("msg_id", P.first_keyword(F.col("text"), P.SENSITIVE_ACCOUNT_KEYWORDS).alias("account_keyword"),
                    P.first_keyword(F.col("text"), P.BILLING_ACTION_KEYWORDS).alias("billing_keyword"))


@query("greeting_flag", "R2", with_views(["messages"], f"""
SELECT msg_id, {greeting_sql(strip_sql("coalesce(text, '')"))} AS is_greeting FROM messages"""))
def q_greeting(spark, sf_dir):
    from casewright.functions.text import py_strip
    m = FX.messages(spark, sf_dir)
    return m.select("msg_id", P.greeting_flag(py_strip(F.coalesce(F.col("text"), F.lit("")))).alias("is_greeting"))


@query("policy_decisions", "R3 R4 R5 R6", with_views(["signals"], """
SELECT msg_id, decision, risk_level, primary_rule, rules_triggered, matched_keyword, reason FROM decisions""",
                                                      extra=POLICY_CTES))
def q_policy(spark, sf_dir):
    return _decisions(spark, sf_dir).select("msg_id", "decision", "risk_level", "primary_rule", "rules_triggered",
                                            "matched_keyword", "reason")


@query("decision_violations", "R7", with_views(["signals"], f"""
SELECT rule, violations FROM (
  SELECT count(*) FILTER (WHERE NOT coalesce(decision IN ('auto_handle', 'escalate'), false)) AS decision_enum,
         count(*) FILTER (WHERE NOT coalesce(risk_level IN ('low', 'medium', 'high'), false)) AS risk_enum,
         count(*) FILTER (WHERE NOT coalesce(intent_confidence BETWEEN 0 AND 1, false)) AS confidence_range,
         count(*) FILTER (WHERE NOT coalesce(top_retrieval_similarity BETWEEN -1 AND 1, false)) AS similarity_range,
         count(*) FILTER (WHERE NOT coalesce(evidence_count >= 0, false)) AS evidence_count_nonneg,
         count(*) FILTER (WHERE reason IS NULL OR {strip_sql('reason')} = '') AS reason_nonblank
  FROM decisions) a
UNPIVOT (violations FOR rule IN (decision_enum, risk_enum, confidence_range, similarity_range,
                                 evidence_count_nonneg, reason_nonblank))""", extra=POLICY_CTES))
def q_violations(spark, sf_dir):
    return P.decision_violations(_decisions(spark, sf_dir))


@query("rule_distribution", "A17", with_views(["signals"], """
SELECT primary_rule, decision, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM decisions GROUP BY primary_rule, decision""", extra=POLICY_CTES))
def q_rule_distribution(spark, sf_dir):
    return P.rule_distribution(_decisions(spark, sf_dir))


@query("safety_metrics", "A18", with_views(["signals"], f"""
SELECT total_samples, labeled_samples, round(auto_ / total_samples, 4) AS auto_handle_rate,
       round(esc_ / total_samples, 4) AS escalation_rate,
       CASE WHEN ok THEN round(fn / labeled_samples, 4) END AS unsafe_auto_handle_rate,
       CASE WHEN ok THEN round(fp / labeled_samples, 4) END AS missed_auto_handle_rate,
       CASE WHEN ok THEN tp END AS tp, CASE WHEN ok THEN fp END AS fp, CASE WHEN ok THEN fn END AS fn,
       CASE WHEN ok THEN tn END AS tn,
       CASE WHEN ok THEN round(prec, 4) END AS precision, CASE WHEN ok THEN round(rec, 4) END AS recall,
       CASE WHEN ok THEN round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 4) END AS f1,
       CASE WHEN ok THEN 'OK' ELSE 'HUMAN_REVIEW_REQUIRED' END AS status
FROM (SELECT *, labeled_samples >= 5 AS ok,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS prec,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS rec
      FROM (SELECT count(*) AS total_samples, count(*) FILTER (WHERE h IN ('auto_handle', 'escalate')) AS labeled_samples,
                   count(*) FILTER (WHERE decision = 'auto_handle') AS auto_,
                   count(*) FILTER (WHERE decision = 'escalate') AS esc_,
                   count(*) FILTER (WHERE decision = 'escalate' AND h = 'escalate') AS tp,
                   count(*) FILTER (WHERE decision = 'escalate' AND h = 'auto_handle') AS fp,
                   count(*) FILTER (WHERE decision = 'auto_handle' AND h = 'escalate') AS fn,
                   count(*) FILTER (WHERE decision = 'auto_handle' AND h = 'auto_handle') AS tn
            FROM (SELECT *, lower({strip_sql("coalesce(human_decision, '')")}) AS h FROM decisions) d) a) b""",
                                                   extra=POLICY_CTES))
def q_safety(spark, sf_dir):
    return P.safety_metrics(_decisions(spark, sf_dir))


def _grid_sql() -> str:
    cfg = P.PolicyConfig()
    cells = []
    for c in P.GRID_CONFIDENCE:
        for v in P.GRID_SIMILARITY:
            e2 = f"(top_retrieval_similarity < {v} OR NOT {str(P.GRID_EVIDENCE_COUNT >= cfg.min_evidence_count).lower()})"
            e1 = f"(intent_confidence < {c})"
            pre = "(e0 OR e3 OR e4)"
            post = ("((predicted_intent = 'account_and_login' AND acc_kw IS NOT NULL) OR "
                    "(predicted_intent = 'billing_and_payment' AND bill_kw IS NOT NULL) OR (other_ AND NOT greet))")
            esc = f"({pre} OR {e2} OR {e1} OR {post})"
            cells.append(f"""SELECT CAST({c} AS DOUBLE) AS min_intent_confidence, CAST({v} AS DOUBLE) AS min_retrieval_similarity,
        count(*) FILTER (WHERE NOT {esc}) AS auto_handle_count, count(*) FILTER (WHERE {esc}) AS escalate_count,
        count(*) FILTER (WHERE NOT {pre} AND NOT {e2} AND {e1}) AS e1_count,
        count(*) FILTER (WHERE NOT {pre} AND {e2}) AS e2_count, count(*) AS n_ FROM gflags""")
    return "grid AS (" + "\nUNION ALL\n".join(cells) + ")"


GRID_CTES = [f"gsrc AS (SELECT *, '{P.GRID_REPLY}' AS g_reply FROM signals)",
             flags_cte("gsrc", P.PolicyConfig(), count=str(P.GRID_EVIDENCE_COUNT), reply="g_reply", name="gflags"),
             _grid_sql()]
GRID_SELECT = """SELECT min_intent_confidence, min_retrieval_similarity, auto_handle_count, escalate_count,
       round(auto_handle_count / n_, 4) AS auto_handle_rate, round(1.0 - auto_handle_count / n_, 4) AS escalation_rate,
       e1_count, e2_count, (min_intent_confidence = 0.2 AND min_retrieval_similarity = 0.45) AS is_default FROM grid"""


@query("threshold_grid", "A19 J9", with_views(["signals"], GRID_SELECT, extra=GRID_CTES))
def q_grid(spark, sf_dir):
    return P.threshold_grid(FX.signals(spark, sf_dir))


@query("threshold_pivot", "A20", with_views(["signals"], "SELECT min_intent_confidence, " + ", ".join(
    f"max(CASE WHEN min_retrieval_similarity = {v} THEN auto_handle_rate END) AS sim_{f'{v:.2f}'.replace('.', '_')}"
    for v in P.GRID_SIMILARITY) + " FROM (" + GRID_SELECT + ") g GROUP BY min_intent_confidence",
    extra=GRID_CTES))
def q_pivot(spark, sf_dir):
    return P.threshold_pivot(P.threshold_grid(FX.signals(spark, sf_dir)))
