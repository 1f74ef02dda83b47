"""Text semantics (Unicode strip/word classes), cleaner, splits and samples."""
from pyspark.sql import functions as F

from casewright.functions.text import clean_for_embedding, norm_key, py_strip, truncate, word_count
from casewright.operators import quality as Q
from conftest import SF_SMALL
from casewright.sources import fixtures as FX


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_cleaner_case(spark):
    got = one(spark, clean_for_embedding, "  @shop_help my parcel &lt;no. 7&gt; is   late, see http://ex.org/a?b=1 ok")
    assert got == "my parcel <no. 7> is late, see ok"
    assert one(spark, clean_for_embedding, None) == ""
    assert one(spark, clean_for_embedding, "&amp;lt; x") == "&lt; x"


def test_every_html_reference_is_decoded(spark):
    import html
    from casewright.functions.text import html_unescape
    texts = [f"a {name if name.endswith(';') else name + ' '} b".replace(name, "&" + name, 1) for name in html.entities.html5]
    texts += ["&#65;&#x42;&#128512;", "&nothing; & &", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", html_unescape("t").alias("x")).collect():
        assert r["x"] == (None if texts[r["i"]] is None else html.unescape(texts[r["i"]]))


def test_null_texts_are_no_duplicates_and_all_offenders_are_listed(spark):
    rows = [(i, None, "zz") for i in range(7)] + [(10, "nan", "en"), (11, " NAN ", "en"), (12, "", None), (12, "x", "en")]
    df = spark.createDataFrame(rows, "tweet_id long, text string, intent string")
    off = {(r["check"], r["tweet_id"]) for r in Q.golden_offenders(df, FX.taxonomy(spark)).collect()}
    assert {i for c, i in off if c == "empty_text"} == {*range(7), 12} and {i for c, i in off if c == "taxonomy_membership"} == set(range(7))
    assert {i for c, i in off if c == "duplicate_texts"} == {10, 11} and {i for c, i in off if c == "duplicate_tweet_ids"} == {12}
    r = Q.golden_report(df, FX.taxonomy(spark), expected_rows=11).first()
    assert (r["status"], r["total_issues"], r["empty_text"], r["invalid_classes"], r["duplicate_text_rows"]) == ("FAILED", 5, 8, 1, 2)
    missing = Q.golden_report(df.drop("intent"), FX.taxonomy(spark), expected_rows=11).first()
    assert missing["missing_columns"] == "intent" and missing["empty_text"] == 8 and missing["empty_intent"] is None


def test_python_strip_semantics(spark):
    assert one(spark, py_strip, "\t x \n ") == "x"
    assert one(spark, norm_key, "  HéLLo ") == "héllo"
    assert one(spark, word_count, " a  b\tc\n") == 3
    assert one(spark, lambda c: truncate(c, 10), "x" * 11) == "x" * 7 + "..."
    assert one(spark, lambda c: truncate(c, 10), "x" * 10) == "x" * 10


def test_split_disjoint_and_proportional(spark):
    d = FX.labelled_docs(spark, SF_SMALL)
    s = Q.stratified_split(d).cache()
    n = d.count()
    assert s.count() == n and s.select("tweet_id").distinct().count() == n
    test = s.filter("split = 'test'").count()
    assert test == -(-n * 25 // 100)
    per = {r["intent"]: (r["t"], r["n"]) for r in
           s.groupBy("intent").agg(F.count_if(F.col("split") == "test").alias("t"), F.count("*").alias("n")).collect()}
    for t, c in per.values():
        assert abs(t - c * test / n) <= 1.0


def test_take_per_group_exact(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(300)]
    df = spark.createDataFrame(rows, "tweet_id long, intent string")
    quotas = spark.createDataFrame([("hot", 17), ("cold", 5)], "intent string, quota long")
    got = Q.take_per_group(df, "intent", quotas, "tweet_id", 2026, prefix_chars=1)
    exp = (df.withColumn("h", Q.hash_key("tweet_id", 2026)).toPandas()
             .sort_values(["intent", "h", "tweet_id"]).groupby("intent").head(100))
    want = set(exp[exp.intent == "hot"].tweet_id[:17]) | set(exp[exp.intent == "cold"].tweet_id[:5])
    assert {r["tweet_id"] for r in got.collect()} == want


def test_samples_sizes(spark):
    d = FX.labelled_docs(spark, SF_SMALL).filter(F.col("intent").isNotNull())
    assert Q.quota_sample(d, 30).count() == 30
    assert Q.proportional_sample(d, 40).count() <= 40


def test_golden_report_flags_duplicates(spark):
    df = spark.createDataFrame([(1, "a", "en"), (1, "b", "fr"), (2, " A ", "xx"), (3, "", None)],
                               "tweet_id long, text string, intent string")
    r = Q.golden_report(df, FX.taxonomy(spark)).first()
    assert r["status"] == "FAILED"
    assert (r["duplicate_id_rows"], r["duplicate_text_rows"], r["invalid_classes"]) == (2, 2, 1)
    assert (r["empty_text"], r["empty_intent"]) == (1, 1)
    missing = Q.golden_report(df.drop("intent"), FX.taxonomy(spark)).first()
    assert missing["missing_columns"] == "intent"


def test_profile_approximate_close_to_exact(spark):
    cases = FX.docs_cases(spark, SF_SMALL)
    exact = Q.corpus_profile(cases).first()
    approx = Q.corpus_profile(cases, approximate=True).first()
    for c in ("distinct_customer_ids", "distinct_customer_texts", "distinct_replies"):
        assert abs(approx[c] - exact[c]) <= max(2, 0.05 * exact[c])


def test_profiles_of_parts_merge_to_the_same_whatever_the_split(spark):
    from casewright.operators.quality import corpus_profile, merge_parts, profile_parts
    rows = [(i, None if i % 50 == 0 else f"Text {i % 700}", f"reply {i % 90}") for i in range(3000)]
    cases = spark.createDataFrame(rows, "customer_tweet_id long, customer_text string, support_text string")
    merged = [merge_parts(profile_parts(cases, p)).first() for p in (F.col("customer_tweet_id") % 7, F.floor(F.col("customer_tweet_id") / 1000), F.lit(0))]
    exact = corpus_profile(cases).first()
    for m in merged:
        assert (m.n_rows, m.null_customer_text, m.null_support_text) == (3000, 60, 0)
        for c in ("distinct_customer_ids", "distinct_customer_texts", "distinct_replies"):
            assert abs(m[c] - exact[c]) <= 0.02 * exact[c]
    assert tuple(merged[0])[:3] == tuple(merged[1])[:3] and merge_parts(profile_parts(cases.limit(0), F.lit(0))).first().n_rows == 0
