"""A1 reply merge: a hot parent split across range partitions equals a brute-force merge."""
import random
from datetime import datetime, timezone

from casewright.operators.corpus import merge_multipart_replies
from conftest import SF_SMALL

FMT = "%a %b %d %H:%M:%S +0000 %Y"


def brute(rows):
    out = {}
    for parent in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == parent]

        def key(r):
            try:
                ts = datetime.strptime(r[3], FMT).replace(tzinfo=timezone.utc)
                return (0, ts, r[0])
            except (TypeError, ValueError):
                return (1, datetime.min.replace(tzinfo=timezone.utc), r[0])
        mine.sort(key=key)
        ids = ",".join(str(r[0]) for r in mine)
        texts = "\n".join(t.strip() for t in (r[1] for r in mine) if t is not None and t.strip())
        created = next((r[3] for r in mine if r[3] is not None), None)
        out[parent] = (ids, texts, created)
    return out


def test_hot_parent_across_partitions(spark):
    rng = random.Random(5)
    rows = []
    tid = 1
    for parent, n in ((10, 600), (20, 3), (30, 1)):
        for _ in range(n):
            sec = rng.randrange(0, 50)
            created = rng.choice([f"Wed Oct 11 06:{sec // 60:02d}:{sec % 60:02d} +0000 2017"] * 8 + ["garbage", None])
            text = rng.choice(["  part %d " % tid, "", "   ", None, "x\ty"])
            rows.append((tid, text, parent, created))
            tid += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "tweet_id long, text string, in_response_to_tweet_id long, created_at string")
    got = {r["customer_tweet_id"]: (r["support_tweet_id"], r["support_text"], r["support_created_at"])
           for r in merge_multipart_replies(df, num_partitions=8).collect()}
    assert got == brute(rows)


def test_counters_of_the_run_equal_the_audit_and_add_no_scan(spark):
    from casewright.operators import corpus as C
    from casewright.sources import fixtures as FX
    tweets, golden = FX.tweets(spark, SF_SMALL), FX.tweet_golden(spark, SF_SMALL)
    audit = C.RunAudit()
    cases = C.build_case_corpus(tweets, golden, FX.BRAND, audit=audit)
    plain = C.build_case_corpus(tweets, golden, FX.BRAND)
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan")
    assert scans(cases) == scans(plain)
    assert sorted(map(tuple, cases.collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, audit.rows(spark).collect())) == sorted(map(tuple, C.etl_audit(tweets, golden, FX.BRAND).collect()))
