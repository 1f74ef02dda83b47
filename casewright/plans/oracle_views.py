"""DuckDB SQL for the derived views, inlined as CTEs by the oracle queries.

These mirror ``casewright.sources.fixtures`` one for one. The Unicode
classes are the same strings as in ``casewright.functions.text``; DuckDB
(RE2) needs the 'g' flag for a global ``regexp_replace``.
"""

from __future__ import annotations

from casewright.functions.text import NON_WS, WORD, WS

WS_SQL = WS
NON_WS_SQL = NON_WS
WORD_SQL = WORD


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def norm_sql(expr: str) -> str:
    return f"lower({strip_sql(expr)})"


def words_sql(expr: str) -> str:
    """``s.split()`` as a DuckDB list."""
    return f"list_filter(regexp_split_to_array({expr}, '{WS_SQL}+'), lambda x: x <> '')"


VIEWS: dict[str, tuple[list[str], str]] = {
    "tweets": ([], """
  parts AS (
    SELECT conv_id, turn, role, text, 0 AS part FROM conversations WHERE role <> 'assistant'
    UNION ALL
    SELECT conv_id, turn, role, p.t AS text, CAST(p.i - 1 AS INTEGER) AS part
    FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS a FROM conversations WHERE role = 'assistant') s,
         LATERAL (SELECT unnest(s.a) AS t, generate_subscripts(s.a, 1) AS i) p),
  tweets AS (
    SELECT (conv_id*100 + turn)*1000 + part AS tweet_id,
           CASE role WHEN 'assistant' THEN 'support' WHEN 'system' THEN 'system' ELSE 'u' || CAST(conv_id AS VARCHAR) END AS author_id,
           role = 'user' AS inbound,
           'Wed Oct 11 ' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':' || lpad(CAST((part // 60) % 60 AS VARCHAR), 2, '0')
             || ':' || lpad(CAST(part % 60 AS VARCHAR), 2, '0') || ' +0000 2017' AS created_at,
           text,
           CASE WHEN turn > 0 THEN (conv_id*100 + turn - 1)*1000 END AS in_response_to_tweet_id
    FROM parts)"""),
    "tweet_golden": (["tweets"], """
  tweet_golden AS (
    SELECT tweet_id, text FROM tweets
    WHERE inbound AND tweet_id // 100000 IN (SELECT conv_id FROM conversations WHERE role = 'system'))"""),
    "docs_cases": ([], """
  docs_cases AS (
    SELECT doc_id AS customer_tweet_id, text AS customer_text,
           repeat('x', CAST(1 + doc_id % 7 AS INTEGER)) AS support_text FROM documents)"""),
    "docs_golden": ([], """
  docs_golden AS (
    SELECT doc_id AS tweet_id, text, lang AS intent FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels))"""),
    "labelled_docs": ([], """
  labelled_docs AS (SELECT doc_id AS tweet_id, text, lang AS intent FROM documents)"""),
    "taxonomy": ([], """
  taxonomy AS (SELECT * FROM (VALUES (1,'en'),(2,'fr'),(3,'de'),(4,'es'),(5,'it')) AS t(ord, intent))"""),
    "label_review": ([], """
  label_review AS (
    SELECT d.doc_id AS tweet_id, d.lang AS candidate_intent,
           CASE WHEN l.toxic = 1 THEN 'en' ELSE d.lang END AS human_verified_intent
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""),
    "messages": ([], """
  messages AS (
    SELECT doc_id AS msg_id, text FROM documents
    UNION ALL
    SELECT doc_id + 10000000000 AS msg_id,
           CASE doc_id % 12 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'Thanks a lot!'
             WHEN 3 THEN 'I was charged twice, want a refund' WHEN 4 THEN 'my account was hacked, reset password'
             WHEN 5 THEN 'cancel subscription & bank dispute' WHEN 6 THEN 'hello there' END AS text
    FROM documents WHERE doc_id % 12 < 7)"""),
    "true_intents": ([], """
  true_intents AS (
    SELECT doc_id AS msg_id, CASE lang WHEN 'en' THEN 'account_and_login' WHEN 'fr' THEN 'playback_and_app_issues'
             WHEN 'de' THEN 'billing_and_payment' WHEN 'es' THEN 'feature_requests' END AS true_intent
    FROM documents)"""),
    "signals": (["messages"], """
  signals AS (
    SELECT m.msg_id, m.text,
           CASE m.msg_id % 6 WHEN 0 THEN 'account_and_login' WHEN 1 THEN 'playback_and_app_issues'
             WHEN 2 THEN 'other_non_actionable' WHEN 3 THEN 'billing_and_payment'
             WHEN 4 THEN 'account_and_login' ELSE 'feature_requests' END AS predicted_intent,
           CAST((m.msg_id * 37) % 100 AS DOUBLE) / 100 AS intent_confidence,
           CAST((m.msg_id * 53) % 101 AS DOUBLE) / 100 AS top_retrieval_similarity,
           CAST((m.msg_id // 12) % 4 AS INTEGER) AS evidence_count,
           CASE WHEN m.msg_id % 23 = 0 THEN 'generation_failed' WHEN m.msg_id % 11 = 0 THEN 'insufficient_evidence'
             ELSE 'grounded' END AS grounding_status,
           CASE WHEN m.msg_id % 29 = 0 THEN '' ELSE 'We can help, send us a DM' END AS reply_text,
           CASE m.msg_id % 5 WHEN 0 THEN ' Escalate' WHEN 1 THEN '' ELSE 'auto_handle' END AS human_decision
    FROM messages m)"""),
    "vec_queries": ([], """
  vec_queries AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)"""),
    "vec_corpus": ([], """
  vec_corpus AS (SELECT vec_id AS case_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)"""),
    "ratings": ([], """
  ratings AS (
    SELECT o_orderkey AS tweet_id, o_orderpriority AS dimension, 1 + CAST(o_custkey % 9 AS DOUBLE) / 2 AS llm,
           least(CAST(5 AS DOUBLE), greatest(CAST(1 AS DOUBLE),
                 1 + CAST(o_custkey % 9 AS DOUBLE) / 2 + CAST((o_orderkey % 5) - 2 AS DOUBLE) / 2)) AS human
    FROM orders)"""),
    "judge_turns": ([], """
  judge_turns AS (
    SELECT a.conv_id * 100 + a.turn AS tweet_id, u.text AS customer_text, a.text AS generated_reply,
           CASE a.conv_id % 3 WHEN 0 THEN 'billing_and_payment' WHEN 1 THEN 'playback_and_app_issues'
             ELSE 'account_and_login' END AS predicted_intent,
           CAST((a.conv_id * 41 + a.turn * 7) % 101 AS DOUBLE) / 100 AS top_sim,
           CASE WHEN a.conv_id % 13 = 0 THEN 'insufficient_evidence' ELSE 'grounded' END AS grounding_status
    FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
    WHERE a.role = 'assistant')"""),
}


def with_views(names: list[str], body: str, extra: list[str] | None = None, recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (dependencies first) and
    any extra ``name AS (...)`` CTE strings."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEWS[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [VIEWS[n][1].strip() for n in order] + [e.strip() for e in (extra or [])]
    if not ctes:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body
