import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from meterline.operators import cohorts as K
from meterline.operators import privacy as H
from meterline.sources.logs import records
from verification.tables import digest, rates

SF = "/root/testdata/sf0.001"
SECRETS = ["please fix the login bug", "kim@example.com", "sk-live-1234567890abcdef",
           "feature/acquisition", "/Users/kim/secret-project/plan.md", "7f3c9a11-22aa"]


def planted(spark):
    recs = [{"type": "assistant", "prompt": SECRETS[0], "author": SECRETS[1],
             "nested": {"key": SECRETS[2], "branch": SECRETS[3], "ok": True, "none": None},
             "calls": [{"name": "Read", "path": SECRETS[4]}] * 12, "conversationId": SECRETS[5],
             "created_at": "2026-11-11T11:11:11Z", "ts": 1793000000000, "tokens": {"input": i + 1}}
            for i in range(3)]
    return spark.createDataFrame([("f", 0, i, json.dumps(r)) for i, r in enumerate(recs)],
                                 "file string, block long, line long, value string")


def test_redaction_keeps_no_secret(spark):
    out = H.redact(planted(spark), F.col("line"), F.col("line")).orderBy("rid").collect()
    text = " ".join(r["json"] for r in out)
    assert not [s for s in SECRETS if s in text] and "11:11" not in text
    doc = json.loads(out[2]["json"])
    assert doc["type"] == "assistant" and doc["tokens"]["input"] == 3
    assert doc["conversationId"] == H.FAKE_ID and len(doc["calls"]) == 12
    short = H.redact(planted(spark), F.col("line"), F.col("line"), items=8).orderBy("rid").collect()
    assert len(json.loads(short[2]["json"])["calls"]) == 8
    assert doc["calls"][0] == {"name": "Read", "path": H.FAKE_PATH}
    assert doc["created_at"] == "2026-08-19T01:04:11.000Z"
    assert doc["ts"] == (H.BASE_EPOCH + 120) * 1000
    assert doc["nested"] == {"branch": "<redacted>", "key": "<redacted>", "none": None, "ok": True}


def test_draft_spec(spark):
    spec = H.draft_spec(records(planted(spark)), F.col("line"))
    assert spec["fields"]["input"] == "tokens.input" and spec["fields"]["ts"] == "created_at"
    assert spec["where"] == {"type": "assistant"}


def test_payload_is_small_clean_and_in_range(spark):
    p = H.payload(digest(spark, SF).priced, rates(spark).base, repos=True, cohorts=["x" * 24])
    with pytest.raises(ValueError):
        H.payload(digest(spark, SF).priced, rates(spark).base, cohorts=["x" * 25])
    assert H.audit(p).count() == 0
    rows = p.collect()
    assert rows and all(0 <= v < len(H.BUCKETS[m]) for r in rows for m, v in r["metrics"].items())
    assert all(len(json.dumps(r.asDict(True))) < 4096 for r in rows)
    assert rows[0]["cohorts"] == ["x" * 24]
    assert not [r for r in rows if "shop" in json.dumps(r.asDict(True))]


def test_hmac_agrees_with_the_standard_library(spark):
    for secret in ("short", "k" * 100):
        got = spark.range(1).select(K.hmac_sha256(secret, F.lit("uid:é"))).first()[0]
        assert got == hmac.new(secret.encode(), "uid:é".encode(), hashlib.sha256).hexdigest()


def test_bucket_edges(spark):
    edges = [0, 5, 10]
    df = spark.createDataFrame([(-1.0,), (0.0,), (4.9,), (5.0,), (99.0,)], "v double")
    assert [r[0] for r in df.select(H.bucket(F.col("v"), edges)).collect()] == [0, 0, 0, 1, 2]


def test_percent_rank_with_one_value_held_by_most(spark):
    df = spark.range(300).select(F.col("id").alias("person"), F.lit("m").alias("metric"),
                                 F.when(F.col("id") < 200, 1.0).otherwise(
                                     F.col("id").cast("double")).alias("value"))
    from pyspark.sql import Window as W
    want = df.select("person", F.percent_rank().over(W.partitionBy("metric").orderBy("value")))
    got = K.ranked(df, chunk_rows=20).select("person", "percent_rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_person_days_are_summed_once(spark, tmp_path):
    """Whoever reads the facts again reads the stored rows: no sum is made twice."""
    from verification.privacy_queries import facts
    spark.range(300).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1800).alias("ts"),
        (F.col("id") % 5).alias("user_id"), F.element_at(F.array(F.lit("view"), F.lit("signup")), (F.col("id") % 2 + 1).cast("int"))
        .alias("event_type"), F.format_string('{"k": %d}', F.col("id") % 40).alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    found = facts(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert found.agg(F.sum("turns")).first()[0] == 300 and found.count() == 5 * 7


def test_histograms_find_each_value_in_one_list_of_edges(spark):
    """As by comparing with every edge, but with a few comparisons in the plan instead of 300."""
    metric, low, high = "turns", *K.HIST_RANGES["turns"]
    edges = K.log_edges(low, high)
    values = [None, 0, 1, 2, 3, 5, 8, 1000, 4999, 5000, 5001, 10**9, *[int(e) + d for e in edges for d in (0, 1)]]
    zeros = [F.lit(0).cast("long").alias(c) for c in (*K.FLAT_SUMS, "peak_context", "models_used", "switch_sessions")
             if c != metric]
    facts = spark.createDataFrame([("all", "2024-01-01", v) for v in values], "slice string, date string, turns long") \
        .select("*", *zeros)
    out = K.histograms(facts)
    got = {r["bucket"]: r["n"] for r in out.filter(F.col("metric") == metric).collect()}
    want = {}
    for v in values:
        at = max(sum((v or 0) >= e for e in edges) - 1, 0)
        want[at] = want.get(at, 0) + 1
    assert got == want and {r["metric"] for r in out.collect()} == set(K.HIST_RANGES)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 30


def test_a_record_is_opened_at_once(spark, monkeypatch):
    """The values of a record come from one generate, not from one for each of twelve levels."""
    plans, store = [], H.write_and_read

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")))
        return store(df, label)

    monkeypatch.setattr(H, "write_and_read", seen)
    rows = [json.dumps({"type": "msg", "a.role": "x", "in": {"n": i, "e": {}, "l": [{"name": "t"}]}}) for i in range(3)]
    recs = records(spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(rows)],
                                         "file string, block long, line long, value string"))
    table = {r["path"]: (r["leaf"], r["numbers"], r["strings"], r["markers"]) for r in H.profile(recs, F.col("line")).collect()}
    assert table == {"type": ("type", 0, 3, 1), "a.role": ("role", 0, 3, 1), "in.n": ("n", 3, 0, 0),
                     "in.e": ("e", 0, 0, 0), "in.l": ("l", 0, 0, 0)}
    assert plans == [("walked", 2)]
