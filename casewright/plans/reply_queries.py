"""Queries for evidence blocks, drafting, citations, judge, agreement, failures, display, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions.text import WORD, py_strip, truncate
from casewright.operators import agreement as AG
from casewright.operators import failures as FL
from casewright.operators import judge as J
from casewright.operators import policy as P
from casewright.operators import replies as R
from casewright.operators.quantiles import exact_quantiles
from casewright.plans.catalog import query
from casewright.plans.oracle_views import strip_sql, with_views
from casewright.plans.policy_queries import decisions_cte, flags_cte, kw_sql
from casewright.plans.vector_queries import KNN_CTES, knn_result
from casewright.sources import fixtures as FX
from casewright.sources.tables import read_table


def _q(s: str) -> str:
    return s.replace("'", "''")


def _nl(s: str) -> str:
    """A DuckDB string literal for ``s`` with real newlines."""
    return "replace('" + _q(s).replace("\n", "\\n") + "', '\\n', chr(10))"


# ----------------------------------------------------------- evidence fixture

def message_evidence(spark, sf_dir):
    """Retrieved cases per message: the message's own vector's top-5 neighbours, with the part
    of the case texts that an evidence block shows (ordered array, <= 5 per row)."""
    hits = knn_result(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    shown = lambda n: truncate(py_strip(F.coalesce(F.col("text"), F.lit(""))), n)
    h = hits.join(docs.select(F.col("doc_id").alias("case_id"), shown(350).alias("customer"), shown(500).alias("support")), "case_id", "left")
    case = F.struct(F.col("rank"), F.format_string("case_%05d", F.col("case_id")).alias("case_id"),
                    F.col("similarity"), F.col("customer").alias("customer_text"), F.col("support").alias("support_text"))
    g = h.groupBy(F.col("query_id").alias("msg_id")).agg(F.array_sort(F.collect_list(case)).alias("_c"))
    return g.select("msg_id", F.transform("_c", lambda c: c.dropFields("rank")).alias("cases"))


def drafted(spark, sf_dir):
    s = FX.signals(spark, sf_dir).select("msg_id", "text", "predicted_intent", "human_decision")
    return R.draft(s.join(message_evidence(spark, sf_dir), "msg_id", "left"))


EV_CTES = KNN_CTES + ["""ev AS (SELECT k.query_id AS msg_id, k.rank, printf('case_%05d', k.case_id) AS case_id, k.similarity,
        d.text AS customer_text, d.text AS support_text FROM knn k LEFT JOIN documents d ON d.doc_id = k.case_id)""",
                      """evagg AS (SELECT msg_id, count(*) AS n_cases, max(similarity) AS top_sim,
        string_agg(case_id, ',' ORDER BY rank) FILTER (WHERE rank <= 2) AS cited FROM ev GROUP BY msg_id)"""]


def _trunc(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) > {n} THEN substr({e}, 1, {n - 3}) || '...' ELSE {e} END"


_CASE_FMT = ("\n[HISTORICAL CASE %d]\nCase ID: %s\nRetrieval Similarity: %.4f\nHistorical Customer Message:\n\"%s\"\n"
             "Historical " + R.BRAND_LABEL + " Response:\n\"%s\"")


@query("evidence_block", "D1 D2 P10", with_views(["vec_queries", "vec_corpus", "messages"], f"""
SELECT m.msg_id,
       CASE WHEN b.body IS NULL THEN {_nl(R.EVIDENCE_EMPTY)}
            ELSE {_nl(R.EVIDENCE_HEADER + chr(10))} || b.body || {_nl(chr(10) + R.EVIDENCE_FOOTER)} END AS evidence_block
FROM messages m LEFT JOIN (
  SELECT msg_id, string_agg(printf({_nl(_CASE_FMT)}, CAST(rank AS INTEGER), case_id, CAST(similarity AS DOUBLE),
           {_trunc(strip_sql("coalesce(customer_text, '')"), 350)}, {_trunc(strip_sql("coalesce(support_text, '')"), 500)}),
           chr(10) ORDER BY rank) AS body
  FROM ev GROUP BY msg_id) b ON b.msg_id = m.msg_id""", extra=EV_CTES))
def q_evidence_block(spark, sf_dir):
    m = FX.messages(spark, sf_dir).select("msg_id")
    e = m.join(message_evidence(spark, sf_dir), "msg_id", "left")
    return e.select("msg_id", R.evidence_block(F.col("cases")).alias("evidence_block"))


@query("prompt_block", "D2", with_views(["vec_queries", "vec_corpus", "signals"], f"""
SELECT s.msg_id, {_nl('CUSTOMER MESSAGE:' + chr(10) + '"')} || {strip_sql("s.text")} || {_nl('"' + chr(10) + chr(10) + 'PREDICTED INTENT CONTEXT:' + chr(10))}
         || s.predicted_intent || {_nl(chr(10) * 2)} || CASE WHEN b.body IS NULL THEN {_nl(R.EVIDENCE_EMPTY)}
         ELSE {_nl(R.EVIDENCE_HEADER + chr(10))} || b.body || {_nl(chr(10) + R.EVIDENCE_FOOTER)} END || chr(10) AS prompt
FROM signals s LEFT JOIN (
  SELECT msg_id, string_agg(printf({_nl(_CASE_FMT)}, CAST(rank AS INTEGER), case_id, CAST(similarity AS DOUBLE),
           {_trunc(strip_sql("coalesce(customer_text, '')"), 350)}, {_trunc(strip_sql("coalesce(support_text, '')"), 500)}),
           chr(10) ORDER BY rank) AS body
  FROM ev GROUP BY msg_id) b ON b.msg_id = s.msg_id""", extra=EV_CTES))
def q_prompt_block(spark, sf_dir):
    s = FX.signals(spark, sf_dir).select("msg_id", "text", "predicted_intent").join(message_evidence(spark, sf_dir), "msg_id", "left")
    return s.select("msg_id", R.prompt(F.col("text"), F.col("predicted_intent"), R.evidence_block(F.col("cases"))).alias("prompt"))


def _draft_sql_cte() -> str:
    msg = strip_sql("coalesce(s.text, '')")
    m = f"(CASE WHEN starts_with({msg}, '\"') OR {msg} = '' THEN '' ELSE lower(split_part({msg}, '\"', 1)) END)"
    reply, summ = "CASE", "CASE"
    for words, rep, sm in R.TEMPLATES:
        hit = " OR ".join(f"contains({m}, '{_q(w)}')" for w in words)
        reply += f" WHEN {hit} THEN '{_q(rep)}'"
        summ += f" WHEN {hit} THEN '{_q(sm)}'"
    any_hit = " OR ".join(f"contains({m}, '{_q(w)}')" for words, _, _ in R.TEMPLATES for w in words)
    reply += f" WHEN e.cited IS NOT NULL THEN '{_q(R.GENERIC_REPLY)}' ELSE '{_q(R.NO_CITE_REPLY)}' END"
    summ += f" WHEN e.cited IS NOT NULL THEN '{_q(R.GENERIC_SUMMARY)}' ELSE '{_q(R.NO_CITE_SUMMARY)}' END"
    status = f"CASE WHEN ({any_hit}) OR e.cited IS NOT NULL THEN 'grounded' ELSE 'insufficient_evidence' END"
    return f"""drafts AS (SELECT s.msg_id, s.text, s.predicted_intent, s.human_decision, {msg} = '' AS blank_,
        coalesce(e.n_cases, 0) = 0 AS none_, coalesce(e.top_sim, 0) AS top_similarity, e.cited,
        {reply} AS reply0, {summ} AS summary0, {status} AS status0
      FROM signals s LEFT JOIN evagg e ON e.msg_id = s.msg_id)"""


DRAFT_CTES = EV_CTES + [_draft_sql_cte(), f"""final_drafts AS (SELECT msg_id, text, predicted_intent, human_decision, top_similarity,
      CASE WHEN blank_ THEN '{_q(R.BLANK_REPLY)}' WHEN none_ THEN '{_q(R.NO_CASES_REPLY)}' ELSE reply0 END AS reply,
      CASE WHEN blank_ THEN '{_q(R.BLANK_SUMMARY)}' WHEN none_ THEN '{_q(R.NO_CASES_SUMMARY)}'
           WHEN status0 = 'grounded' AND cited IS NOT NULL AND top_similarity < 0.45
             THEN summary0 || printf(' (Note: Highest retrieval similarity was low at %.4f).', top_similarity)
           ELSE summary0 END AS grounding_summary,
      CASE WHEN blank_ OR none_ THEN '' ELSE coalesce(cited, '') END AS evidence_case_ids,
      CASE WHEN blank_ OR none_ THEN 'insufficient_evidence'
           WHEN status0 = 'grounded' AND cited IS NULL THEN 'insufficient_evidence'
           WHEN status0 = 'grounded' AND top_similarity < 0.45 THEN 'insufficient_evidence'
           ELSE status0 END AS grounding_status
    FROM drafts)"""]


@query("draft_reply", "D3 D4 D5 D6", with_views(["vec_queries", "vec_corpus", "signals"], """
SELECT msg_id, reply, grounding_summary, evidence_case_ids, grounding_status FROM final_drafts""", extra=DRAFT_CTES))
def q_draft(spark, sf_dir):
    d = drafted(spark, sf_dir)
    return d.select("msg_id", "reply", "grounding_summary", F.array_join("evidence_case_ids", ",").alias("evidence_case_ids"),
                    "grounding_status")


@query("citation_scrub", "D5 D6 D8", with_views(["vec_queries", "vec_corpus", "signals"], """
SELECT ev.msg_id, CAST(ev.rank AS BIGINT) AS rank, ev.case_id,
       coalesce(contains(',' || f.evidence_case_ids || ',', ',' || ev.case_id || ','), false) AS is_cited
FROM ev JOIN final_drafts f ON f.msg_id = ev.msg_id""", extra=DRAFT_CTES))
def q_citation_scrub(spark, sf_dir):
    d = drafted(spark, sf_dir)
    # a drafting client may cite an id it never saw: it must be scrubbed
    d = d.withColumn("evidence_case_ids", R.scrub_citations(
        F.concat(F.col("evidence_case_ids"), F.array(F.lit("case_999999_fake"))),
        F.transform(F.coalesce(F.col("cases"), F.array()), lambda c: c["case_id"])))
    f = R.citation_flags(d.select("msg_id", "cases", "evidence_case_ids").filter(F.col("cases").isNotNull()))
    return f.select("msg_id", F.col("rank").cast("long"), "case_id", "is_cited")


@query("grounding_breakdown", "A29 A30", with_views(["vec_queries", "vec_corpus", "signals"], """
SELECT grounding_status, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 2) AS share_pct,
       round(sum(count(*)) OVER () * 400 * 0.075 / 1e6 + sum(count(*)) OVER () * 60 * 0.30 / 1e6, 6) AS estimated_cost_usd
FROM final_drafts GROUP BY grounding_status""", extra=DRAFT_CTES))
def q_grounding(spark, sf_dir):
    return R.grounding_breakdown(drafted(spark, sf_dir))


RAW_SHAPES = 8

_RAW_CTES = ["""raw AS (SELECT tweet_id, CASE tweet_id % 8
        WHEN 0 THEN full_ WHEN 1 THEN 'Sure! Here it is: ' || full_ || ' Thanks.'
        WHEN 2 THEN CAST(json_object('reply', generated_reply, 'grounding_summary', 's', 'grounding_status', 'maybe') AS VARCHAR)
        WHEN 3 THEN '' WHEN 4 THEN generated_reply
        WHEN 5 THEN CAST(json_object('reply', generated_reply, 'grounding_summary', 's', 'grounding_status', 'generation_failed') AS VARCHAR)
        WHEN 6 THEN CAST(json_object('reply', generated_reply, 'grounding_status', 'grounded') AS VARCHAR)
        ELSE CAST(json_object('reply', generated_reply, 'grounding_summary', 's', 'evidence_case_ids', 'case_1', 'grounding_status', 'grounded') AS VARCHAR)
      END AS raw
    FROM (SELECT *, CAST(json_object('reply', generated_reply, 'grounding_summary', 'from turn', 'evidence_case_ids', ['case_00001'],
            'grounding_status', 'grounded') AS VARCHAR) AS full_ FROM judge_turns) t)""",
             r"""body AS (SELECT tweet_id, raw, CASE WHEN json_valid(raw) THEN raw
        WHEN json_valid(nullif(regexp_extract(raw, '(?s)(\{.*\})', 1), '')) THEN regexp_extract(raw, '(?s)(\{.*\})', 1) END AS js FROM raw)""",
             """parsed AS (SELECT *, json_extract_string(js, '$.reply') AS reply, json_extract_string(js, '$.grounding_summary') AS summary,
        json_extract_string(js, '$.grounding_status') AS status,
        coalesce(json_type(js, '$.evidence_case_ids'), 'ARRAY') = 'ARRAY' AS list_ok,
        coalesce(array_to_string(json_extract_string(js, '$.evidence_case_ids[*]'), ','), '') AS cited FROM body)""",
             """good AS (SELECT *, coalesce(reply IS NOT NULL AND summary IS NOT NULL AND list_ok
        AND status IN ('grounded', 'insufficient_evidence', 'generation_failed'), false) AS ok FROM parsed)"""]


@query("reply_parse", "D7", with_views(["judge_turns"], f"""
SELECT tweet_id, CASE WHEN ok THEN reply ELSE '{_q(R.FAILED_REPLY)}' END AS reply,
       CASE WHEN ok THEN summary WHEN {strip_sql("raw")} = '' THEN '{R.FAILED_SUMMARY + R.FAILED_REASONS["empty"]}'
            ELSE '{R.FAILED_SUMMARY + R.FAILED_REASONS["invalid"]}' END AS grounding_summary,
       CASE WHEN ok THEN cited ELSE '' END AS evidence_case_ids, CASE WHEN ok THEN status ELSE 'generation_failed' END AS grounding_status
FROM good""", extra=_RAW_CTES))
def q_reply_parse(spark, sf_dir):
    """Raw drafting outputs derived from every judge turn in eight shapes (JSON, JSON inside prose, bad
    status, empty, not JSON, failed status, no summary, citations of another type), then parsed."""
    t = FX.judge_turns(spark, sf_dir)
    js = F.to_json(F.struct(F.col("generated_reply").alias("reply"), F.lit("from turn").alias("grounding_summary"),
                            F.array(F.lit("case_00001")).alias("evidence_case_ids"),
                            F.lit("grounded").alias("grounding_status")))
    k = F.col("tweet_id") % RAW_SHAPES

    def shape(status: str, summary: bool = True, cited: bool = False):
        return F.to_json(F.struct(F.col("generated_reply").alias("reply"), *([F.lit("s").alias("grounding_summary")] if summary else []),
                                  *([F.lit("case_1").alias("evidence_case_ids")] if cited else []), F.lit(status).alias("grounding_status")))
    raw = (F.when(k == 0, js).when(k == 1, F.concat(F.lit("Sure! Here it is: "), js, F.lit(" Thanks.")))
            .when(k == 2, shape("maybe")).when(k == 3, F.lit("")).when(k == 4, F.col("generated_reply"))
            .when(k == 5, shape("generation_failed")).when(k == 6, shape("grounded", summary=False))
            .otherwise(shape("grounded", cited=True)))
    p = t.select("tweet_id", R.parse_reply(raw).alias("r"))
    return p.select("tweet_id", F.col("r.reply").alias("reply"), F.col("r.grounding_summary").alias("grounding_summary"),
                    F.array_join("r.evidence_case_ids", ",").alias("evidence_case_ids"), F.col("r.grounding_status").alias("grounding_status"))


# ----------------------------------------------------------- judge

def _judge_cte(src: str, reply: str, customer: str, intent: str, sim: str, status: str, name: str = "judged") -> list[str]:
    w = f"'({WORD}{{4,}})'"
    promise = " OR ".join(f"contains(r, '{_q(p)}')" for p in J.PROMISE_PHRASES)
    helpful = " OR ".join(f"contains(r, '{_q(p)}')" for p in J.HELPFUL_PHRASES)
    insult = " OR ".join(f"contains(r, '{_q(p)}')" for p in J.INSULTS)
    return [f"""j0 AS (SELECT *, lower({strip_sql(f"coalesce({reply}, '')")}) AS r,
        lower({strip_sql(f"coalesce({customer}, '')")}) AS q, coalesce(CAST({sim} AS DOUBLE), {J.DEFAULT_EVIDENCE_SIM}) AS ts,
        {sim} IS NULL AS imputed FROM {src})""",
            f"""j1 AS (SELECT *, (coalesce({reply}, '') = '' OR {status} = 'generation_failed' OR length(r) < 5) AS failed,
        (contains(r, 'http://') OR (contains(r, 'https://') AND NOT contains(r, '{J.TRUSTED_LINK_WORD}')) OR {promise}) AS hal,
        list_distinct(regexp_extract_all(q, {w}, 1)) AS qw, list_distinct(regexp_extract_all(r, {w}, 1)) AS rw FROM j0)""",
            f"""j2 AS (SELECT *, len(list_intersect(qw, rw)) AS common FROM j1)""",
            f"""j3 AS (SELECT *,
        CAST(CASE WHEN failed THEN 1.0 WHEN ts < 0.40 AND common = 0 THEN 2.0
             WHEN len(qw) > 0 AND common / len(qw) >= 0.4 THEN 5.0 WHEN len(qw) > 0 AND common / len(qw) >= 0.2 THEN 4.0
             ELSE 3.0 END AS DOUBLE) AS relevance_score,
        CAST(CASE WHEN failed THEN 1.0 WHEN hal THEN 1.0
             WHEN {status} = 'insufficient_evidence' THEN CASE WHEN contains(r, 'dm') OR contains(r, 'support') THEN 4.0 ELSE 2.5 END
             WHEN ts >= 0.70 THEN 4.5 WHEN ts >= 0.50 THEN 4.0 WHEN ts >= 0.40 THEN 3.5 ELSE 2.5 END AS DOUBLE) AS groundedness_score,
        CAST(CASE WHEN failed THEN 1.0 WHEN length(r) < 25 THEN 2.0 WHEN {helpful} THEN 4.5 ELSE 3.5 END AS DOUBLE) AS helpfulness_score,
        CAST(CASE WHEN failed THEN 1.0 WHEN contains(r, 'device') OR contains(r, 'version') OR contains(r, 'dm') THEN 4.5
             WHEN contains(q, '?') AND NOT contains(r, '?') AND length(r) < 40 THEN 2.5 ELSE 4.0 END AS DOUBLE) AS completeness_score,
        CAST(CASE WHEN failed THEN 2.0 WHEN {insult} THEN 1.0 WHEN hal THEN 2.0
             WHEN {intent} IN ('account_and_login', 'billing_and_payment') THEN
               CASE WHEN contains(r, 'dm') OR contains(r, 'private') OR contains(r, 'reach out') THEN 5.0 ELSE 3.5 END
             ELSE 5.0 END AS DOUBLE) AS safety_score
      FROM j2)""",
            f"""{name} AS (SELECT *, round((relevance_score + groundedness_score + helpfulness_score + completeness_score
                                    + safety_score) / 5.0, 2) AS overall_score,
        CASE WHEN failed THEN false ELSE hal END AS hallucination_flag,
        CASE WHEN failed THEN false ELSE NOT imputed AND ts >= 0.45 END AS evidence_use_flag
      FROM j3)""",
            f"""{name}_v AS (SELECT *, CASE WHEN overall_score >= 3.5 AND groundedness_score >= 3.0 AND safety_score >= 3.0
        AND NOT hallucination_flag THEN 'PASS' ELSE 'FAIL' END AS pass_fail FROM {name})"""]


JUDGE_CTES = _judge_cte("judge_turns", "generated_reply", "customer_text", "predicted_intent", "top_sim",
                        "grounding_status")
SCORE_COLS = ["relevance_score", "groundedness_score", "helpfulness_score", "completeness_score", "safety_score",
              "overall_score", "pass_fail", "hallucination_flag", "evidence_use_flag"]


@query("judge_scores", "Q1", with_views(["judge_turns"], "SELECT tweet_id, " + ", ".join(SCORE_COLS) + " FROM judged_v",
                                        extra=JUDGE_CTES))
def q_judge(spark, sf_dir):
    return J.judge(FX.judge_turns(spark, sf_dir)).select("tweet_id", *SCORE_COLS)


@query("judge_summary", "A21", with_views(["judge_turns"], "SELECT count(*) AS n, " + ", ".join(
    f"round(avg({c}), 4) AS mean_{c.replace('_score', '')}" for c in SCORE_COLS[:6]) + """,
       round(avg(CAST(pass_fail = 'PASS' AS DOUBLE)) * 100, 2) AS pass_rate_pct,
       count(*) FILTER (WHERE hallucination_flag) AS hallucinations FROM judged_v""", extra=JUDGE_CTES))
def q_judge_summary(spark, sf_dir):
    return J.judge_summary(J.judge(FX.judge_turns(spark, sf_dir)))


REVIEW_SRC = f"""rsrc AS (SELECT tweet_id, customer_text AS text, predicted_intent, CAST(0.5 AS DOUBLE) AS intent_confidence,
    coalesce(top_sim, {J.DEFAULT_EVIDENCE_SIM}) AS top_retrieval_similarity, 1 AS evidence_count,
    CASE WHEN coalesce(top_sim, {J.DEFAULT_EVIDENCE_SIM}) >= 0.45 THEN 'grounded' ELSE 'insufficient_evidence' END
      AS grounding_status, generated_reply AS reply_text FROM judge_turns)"""


@query("review_template", "W10 P9", with_views(["judge_turns"], """
SELECT tweet_id, md5(CAST(tweet_id AS VARCHAR) || ':2026') AS review_order, text AS customer_text, predicted_intent,
       reply_text AS generated_reply, round(top_retrieval_similarity, 4) AS evidence_similarity, decision, risk_level, primary_rule,
       CAST(NULL AS DOUBLE) AS relevance, CAST(NULL AS DOUBLE) AS groundedness, CAST(NULL AS DOUBLE) AS helpfulness,
       CAST(NULL AS DOUBLE) AS completeness, CAST(NULL AS DOUBLE) AS safety, CAST(NULL AS DOUBLE) AS overall,
       CAST(NULL AS VARCHAR) AS hallucination_flag, CAST(NULL AS VARCHAR) AS human_decision, CAST(NULL AS VARCHAR) AS notes FROM decisions""",
    extra=[REVIEW_SRC, flags_cte("rsrc", P.PolicyConfig())] + decisions_cte()))
def q_review_template(spark, sf_dir):
    return J.review_template(FX.judge_turns(spark, sf_dir))


RATED = ["relevance", "groundedness", "helpfulness", "completeness", "safety", "overall"]


@query("review_gate", "A26 W10", with_views(["judge_turns"], "\nUNION ALL\n".join(f"""
SELECT '{d}' AS dimension, CAST(0 AS BIGINT) AS sample_count, CAST(NULL AS DOUBLE) AS human_mean, round(avg({d}_score), 2) AS llm_mean,
       CAST(NULL AS DOUBLE) AS pearson_correlation, CAST(NULL AS DOUBLE) AS spearman_correlation, CAST(NULL AS DOUBLE) AS agreement_rate,
       CAST(NULL AS DOUBLE) AS weighted_kappa, 'HUMAN_REVIEW_REQUIRED' AS status FROM judged_v""" for d in RATED), extra=JUDGE_CTES))
def q_review_gate(spark, sf_dir):
    """The freshly written review template has no human rating yet: judge means only."""
    turns = FX.judge_turns(spark, sf_dir)
    long = lambda df, cols, name: df.select("tweet_id", F.explode(F.map_from_arrays(
        F.array(*[F.lit(d) for d in RATED]), F.array(*[F.col(c).cast("double") for c in cols]))).alias("dimension", name))
    return AG.gated_agreement(long(J.review_template(turns), RATED, "human"), long(J.judge(turns), [f"{d}_score" for d in RATED], "llm"),
                              ["tweet_id", "dimension"])


# ----------------------------------------------------------- agreement

def _pairs(spark, sf_dir):
    r = FX.ratings(spark, sf_dir)
    return AG.pair_ratings(r.select("tweet_id", "dimension", "human"), r.select("tweet_id", "dimension", "llm"),
                           ["tweet_id", "dimension"])


def _clip(e: str) -> str:
    return f"least(5, greatest(1, CAST(round_even({e}, 0) AS INTEGER)))"


def _corr_sql(x: str, y: str) -> str:
    return (f"CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN CASE WHEN avg({x}) = avg({y}) THEN 1.0 ELSE 0.0 END"
            f" ELSE corr({x}, {y}) END")


def _kappa_sql(n: str = "count(*)") -> str:
    swo = f"(sum(CAST((hr - lr) * (hr - lr) AS DOUBLE)) / {n})"
    swe = (f"(({n} * (sum(CAST(hr * hr AS DOUBLE)) + sum(CAST(lr * lr AS DOUBLE))) - 2 * sum(CAST(hr AS DOUBLE)) * "
           f"sum(CAST(lr AS DOUBLE))) / ({n} * {n}))")
    return f"CASE WHEN {swe} = 0 THEN CASE WHEN {swo} = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - {swo} / {swe} END"


PAIR_CTES = ["pairs AS (SELECT h.tweet_id, h.dimension, h.human, l.llm FROM ratings h JOIN ratings l "
             "ON l.tweet_id = h.tweet_id AND l.dimension = h.dimension WHERE h.human IS NOT NULL AND l.llm IS NOT NULL)",
             f"""rk AS (SELECT *,
        rank() OVER (PARTITION BY dimension ORDER BY human) + (count(*) OVER (PARTITION BY dimension, human) - 1) / CAST(2 AS DOUBLE) AS rh,
        rank() OVER (PARTITION BY dimension ORDER BY llm) + (count(*) OVER (PARTITION BY dimension, llm) - 1) / CAST(2 AS DOUBLE) AS rl,
        {_clip('human')} AS hr, {_clip('llm')} AS lr FROM pairs)"""]


@query("rater_agreement", "A22 A23 A24 A26 J5", with_views(["ratings"], f"""
SELECT dimension, count(*) AS sample_count, round(avg(human), 2) AS human_mean, round(avg(llm), 2) AS llm_mean,
       CASE WHEN count(*) >= 3 THEN round({_corr_sql('human', 'llm')}, 4) ELSE 0.0 END AS pearson_correlation,
       CASE WHEN count(*) >= 3 THEN round({_corr_sql('rh', 'rl')}, 4) ELSE 0.0 END AS spearman_correlation,
       CASE WHEN count(*) >= 3 THEN round(avg(CAST((human >= 3.5) = (llm >= 3.5) AS DOUBLE)), 4) ELSE 0.0 END AS agreement_rate,
       CASE WHEN count(*) >= 3 THEN round({_kappa_sql()}, 4) ELSE 0.0 END AS weighted_kappa,
       CASE WHEN count(*) >= 3 THEN 'COMPUTED' ELSE 'INSUFFICIENT_SAMPLES' END AS status
FROM rk GROUP BY dimension""", extra=PAIR_CTES))
def q_rater_agreement(spark, sf_dir):
    return AG.agreement_table(_pairs(spark, sf_dir))


@query("weighted_kappa", "A25", with_views(["ratings"], f"""
SELECT q.dimension, q.n, q.quadratic_kappa, round(lk.lk, 4) AS linear_kappa FROM
  (SELECT dimension, count(*) AS n, round({_kappa_sql()}, 4) AS quadratic_kappa FROM rk GROUP BY dimension) q
JOIN (SELECT c.dimension,
        CASE WHEN sum(abs(rr.hr - cc.lr) / 4.0 * rr.r * cc.k) = 0 THEN 1.0 ELSE
          1.0 - (max(o.wo) / max(o.n)) / (sum(abs(rr.hr - cc.lr) / 4.0 * rr.r * cc.k) / (max(o.n) * max(o.n))) END AS lk
      FROM (SELECT DISTINCT dimension FROM rk) c
      JOIN (SELECT dimension, hr, count(*) AS r FROM rk GROUP BY 1, 2) rr ON rr.dimension = c.dimension
      JOIN (SELECT dimension, lr, count(*) AS k FROM rk GROUP BY 1, 2) cc ON cc.dimension = c.dimension
      JOIN (SELECT dimension, sum(abs(hr - lr) / 4.0) AS wo, count(*) AS n FROM rk GROUP BY 1) o ON o.dimension = c.dimension
      GROUP BY c.dimension) lk ON lk.dimension = q.dimension""", extra=PAIR_CTES))
def q_weighted_kappa(spark, sf_dir):
    return AG.weighted_kappa(_pairs(spark, sf_dir))


@query("average_ranks", "W4", with_views(["ratings"], "SELECT tweet_id, dimension, rh AS human_rank, rl AS llm_rank FROM rk",
                                         extra=PAIR_CTES))
def q_average_ranks(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    r = AG.average_ranks(AG.average_ranks(p, "dimension", "human", "human_rank"), "dimension", "llm", "llm_rank")
    return r.select("tweet_id", "dimension", "human_rank", "llm_rank")


# ----------------------------------------------------------- failures, display, latency

def _policy_judged(spark, sf_dir):
    s = FX.signals(spark, sf_dir)
    d = P.decide(s)
    j = J.judge(d, reply="reply_text", customer="text", intent="predicted_intent",
                sim="top_retrieval_similarity", status="grounding_status")
    truth = FX.true_intents(spark, sf_dir)
    top1 = (knn_result(spark, sf_dir).filter(F.col("rank") == 1)
            .join(truth.select(F.col("msg_id").alias("case_id"), F.col("true_intent").alias("top1_intent")), "case_id")
            .select(F.col("query_id").alias("msg_id"), "top1_intent"))
    return j.join(truth, "msg_id", "left").join(top1, "msg_id", "left")


FAIL_CTES = [flags_cte("signals", P.PolicyConfig())] + decisions_cte() + _judge_cte(
    "decisions", "reply_text", "text", "predicted_intent", "top_retrieval_similarity", "grounding_status") + KNN_CTES + [
    """failsrc AS (SELECT j.*, t.true_intent, c.true_intent AS top1_intent FROM judged_v j LEFT JOIN true_intents t ON t.msg_id = j.msg_id
    LEFT JOIN (SELECT query_id, case_id FROM knn WHERE rank = 1) k ON k.query_id = j.msg_id
    LEFT JOIN true_intents c ON c.msg_id = k.case_id)"""]


def _failure_sql() -> str:
    low = "lower(coalesce(text, ''))"
    rl = "lower(coalesce(reply_text, ''))"
    dev = " OR ".join(f"contains({low}, '{t}')" for t in FL.DEVICE_TOKENS)
    cla = " OR ".join(f"contains({rl}, '{t}')" for t in FL.CLARIFY_TOKENS)
    acc, bill = kw_sql("text", P.SENSITIVE_ACCOUNT_KEYWORDS), kw_sql("text", P.BILLING_ACTION_KEYWORDS)
    conds = {
        "wrong_intent": "predicted_intent <> true_intent",
        "irrelevant_retrieved_evidence": "top_retrieval_similarity >= 0.45 AND top1_intent <> true_intent",
        "low_retrieval_similarity": "top_retrieval_similarity < 0.45",
        "unsupported_generation": "top_retrieval_similarity < 0.45 AND trim(coalesce(reply_text, '')) <> '' "
                                  "AND coalesce(evidence_count, 0) <= 0",
        "hallucinated_claim": "coalesce(hallucination_flag, false)",
        "missing_required_clarification": f"predicted_intent = 'playback_and_app_issues' AND NOT ({dev}) AND NOT ({cla})",
        "unsafe_auto_handle": f"decision = 'auto_handle' AND (({acc}) IS NOT NULL OR ({bill}) IS NOT NULL)",
        "unnecessary_escalation": "decision = 'escalate' AND lower(trim(coalesce(human_decision, ''))) = 'auto_handle'",
        "low_quality_response": "pass_fail = 'FAIL'",
        "ambiguous_customer_message": "primary_rule = 'E7'",
    }
    return "\nUNION ALL\n".join(f"SELECT msg_id, '{k}' AS bucket FROM failsrc WHERE coalesce({v}, false)"
                                for k, v in conds.items())


_FAIL_VIEWS = ["signals", "true_intents", "vec_queries", "vec_corpus"]


@query("failure_summary", "F1", with_views(_FAIL_VIEWS, f"""
SELECT bucket, count(*) AS n, min(msg_id) AS example_id FROM ({_failure_sql()}) b GROUP BY bucket""", extra=FAIL_CTES))
def q_failure_summary(spark, sf_dir):
    return FL.failure_summary(FL.failure_buckets(_policy_judged(spark, sf_dir), reply="reply_text"), "msg_id")


@query("failure_buckets", "F1", with_views(_FAIL_VIEWS, _failure_sql(), extra=FAIL_CTES))
def q_failures(spark, sf_dir):
    j = _policy_judged(spark, sf_dir)
    return FL.failure_buckets(j, reply="reply_text").select("msg_id", "bucket")


@query("intent_display", "P12", with_views(["signals"], """
SELECT s.msg_id, s.predicted_intent, coalesce(m.name, list_aggregate(list_transform(string_split(s.predicted_intent, '_'),
         lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ')) AS display_name,
       least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(s.intent_confidence * 1.25 - 0.1 AS DOUBLE))) AS confidence_clamped,
       list_aggregate(list_transform(string_split(d.source, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)),
         'string_agg', ' ') AS source_display
FROM signals s LEFT JOIN names m ON m.key = s.predicted_intent LEFT JOIN documents d ON d.doc_id = s.msg_id""",
    extra=["names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{_q(v)}')" for k, v in FL.INTENT_DISPLAY_NAMES.items())
           + ") AS t(key, name))"]))
def q_intent_display(spark, sf_dir):
    s = FX.signals(spark, sf_dir)
    d = read_table(spark, sf_dir, "documents", "doc_id", "source").withColumnRenamed("doc_id", "msg_id")
    # confidence stretched past [0, 1] on purpose so the clamp is exercised
    return s.join(d, "msg_id", "left").select(
        "msg_id", "predicted_intent", FL.display_name("predicted_intent").alias("display_name"),
        FL.clamp01(F.col("intent_confidence") * 1.25 - 0.1).alias("confidence_clamped"),
        FL.display_name("source").alias("source_display"))


@query("latency_summary", "A14", """
SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median,
       round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max
FROM events GROUP BY event_type""")
def q_latency(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_type", "value")
    rest = e.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"),
                                       F.round(F.max("value"), 4).alias("max"))
    q = exact_quantiles(e, "event_type", "value", {"median": 0.5, "p95": 0.95})
    same = rest["event_type"].eqNullSafe(q["event_type"])
    return rest.join(q, same, "left").select(rest["event_type"], "n", "mean", F.round("median", 4).alias("median"),
                                             F.round("p95", 4).alias("p95"), "max")
