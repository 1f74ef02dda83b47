"""Keyword and greeting rules agree with Python ``re`` (Unicode \\b, \\w, \\s) on random text."""
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from casewright.operators import policy as P
from casewright.functions.text import py_strip

PIECES = ["hack", "hacked", "locked out", "can't log in", "refund", "bank statement", "charged twice",
          "hi", "hello", "thanks", "thank you", "ok", "cool", "é", "ß", "_", "x", "!", "?", ",", "'", "-",
          " ", "  ", "\t", "\n", "\xa0", "　", "Hey", "HACK", "refunds", "9"]
TEXT = st.lists(st.sampled_from(PIECES), min_size=0, max_size=10).map("".join)


def py_first_keyword(text, keywords):
    low = text.lower()
    for kw in P.ordered_keywords(keywords):
        if re.search(r"\b" + re.escape(kw) + r"\b", low):
            return kw
    return None


def py_greeting(text):
    cleaned = re.sub(r"[^\w\s]", "", text.strip().lower())
    words = cleaned.split()
    if not words or len(words) > P.GREETING_MAX_WORDS:
        return False
    pats = [r"^(" + "|".join(re.escape(g) for g in grp) + r")\b" for grp in P.GREETING_OPENERS]
    return any(re.search(p, cleaned) for p in pats)


@settings(max_examples=6, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=40))
def test_rules_match_python_re(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = df.select(
        "i", P.first_keyword(F.col("t"), P.SENSITIVE_ACCOUNT_KEYWORDS).alias("a"),
        P.first_keyword(F.col("t"), P.BILLING_ACTION_KEYWORDS).alias("b"),
        P.greeting_flag(py_strip(F.col("t"))).alias("g")).orderBy("i").collect()
    for t, r in zip(texts, rows):
        assert r["a"] == py_first_keyword(t, P.SENSITIVE_ACCOUNT_KEYWORDS), t
        assert r["b"] == py_first_keyword(t, P.BILLING_ACTION_KEYWORDS), t
        assert r["g"] == py_greeting(t.strip()), repr(t)
