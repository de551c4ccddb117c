"""Running values over one huge key, shared storage, redaction and audit on odd records."""

import json
import time

import pytest
from pyspark.sql import functions as F

from meterline import cluster
from meterline.operators import privacy as H
from meterline.operators.scan import Scan, by_chunks, running
from meterline.streaming.jobs import once_only, watch_tables
from meterline.schema import conform
from meterline.sources.logs import records


def nearest(df, chunk):
    value = F.when(F.col("i") % 1000 == 7, F.col("i"))
    return running(df, ["k"], ["i"], [Scan("back", "last", value), Scan("ahead", "next", value)], chunk)


def test_a_million_rows_of_one_key(spark):
    """The nearest later value takes a pass, not a pass per row; chunks give the same."""
    took = {}
    for n in (250_000, 1_000_000):
        df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("i"))
        start = time.time()
        whole = nearest(df, None).agg(F.sum(F.col("ahead") * (F.col("i") % 13 + 1)).alias("a"),
                                      F.sum(F.col("back") * (F.col("i") % 13 + 1)).alias("b")).first()
        took[n] = time.time() - start
    cut = by_chunks(df, ["k"], ["i"], nearest, chunk_rows=150_000).agg(
        F.sum(F.col("ahead") * (F.col("i") % 13 + 1)).alias("a"),
        F.sum(F.col("back") * (F.col("i") % 13 + 1)).alias("b")).first()
    assert whole == cut
    first = nearest(df, None).filter("i in (0, 7, 8, 999993, 999999)").orderBy("i").collect()
    assert [r["ahead"] for r in first] == [7, 7, 1007, None, None]
    assert took[1_000_000] < 12 * max(took[250_000], 0.5)


class _Remote:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: None)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        cluster.shared_dir(_Remote)


def test_scratch_is_cleared(spark, monkeypatch):
    monkeypatch.setattr(cluster, "_MADE", [])
    df = cluster.write_and_read(spark.range(5), "rows")
    assert df.count() == 5 and cluster.clear_scratch(spark) == 1
    assert cluster.clear_scratch(spark) == 0


def test_audit_looks_at_every_element(spark):
    df = spark.createDataFrame(
        [([{"a": 1}, {"cwd": 2}], {"x": {"k": 1}, "y": {"prompt": 1}}, [[{"q": 1}], [{"b": 1}, {"email": 1}]]),
         (None, None, None)],
        "list array<map<string,int>>, second map<string,map<string,int>>, deep array<array<map<string,int>>>")
    hits = {r["hit"] for r in H.audit(df).collect()}
    assert hits == {"list/*/cwd", "second/*/prompt", "deep/*/*/email"}
    inner = spark.createDataFrame([(([(1, 2)],),)], "x struct<l:array<struct<ok:int,branch:int>>>")
    assert [r["hit"] for r in H.audit(inner).collect()] == ["x/l/*/branch"]


def test_redaction_rebuilds_nested_records(spark):
    rows = ['{"a": [], "b": {}, "role": "user", "n": [1, [2, {"text": "secret", "id": "u1"}]], "t": null}',
            '{"created": 1700000000, "when": {"updated_at": 1700000000000, "count": 12}, "ok": true, "x": 1.5}',
            '["plain", {"path": "/home/me/x"}]', "not json", None, '"words"', "{}"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, value string")
    got = {r["rid"]: json.loads(r["json"]) for r in H.redact(df, F.col("i"), F.col("i")).collect()}
    clock = H.BASE_EPOCH + 60
    assert got == {
        0: {"a": [], "b": {}, "role": "user", "n": [1, [2, {"text": "<redacted>", "id": "ses-0001"}]], "t": None},
        1: {"created": clock, "when": {"updated_at": clock * 1000, "count": 12}, "ok": True, "x": 1.5},
        2: ["<redacted>", {"path": H.FAKE_PATH}], 5: "<redacted>", 6: {}}
    deep = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":"secret"}}}, "l": [1, 2, 3]}')], "i int, value string")
    assert H.redact(deep, F.col("i"), F.col("i"), items=2, depth=2).first()["json"] == \
        '{"a":{"b":"<redacted>"},"l":[1,2]}'


def test_records_of_any_depth(spark):
    def nested(levels, list_at):
        rec = {"count": levels, "role": "user", "empty": {}, "none": []}
        for k in range(levels):
            rec = {"in": [k, rec] if k % 5 == list_at else rec, "count": k}
        return rec

    recs = [nested(3, 1), nested(11, 9), nested(12, 9), nested(30, 9), nested(27, 2)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "i int, value string")
    got = {r["rid"]: json.loads(r["json"]) for r in H.redact(df, F.col("i"), F.col("i")).collect()}
    assert got == dict(enumerate(recs))
    parsed = df.filter("i = 3").select("i", F.parse_json("value").alias("rec"))
    table = {r["path"]: r["numbers"] for r in H.profile(parsed, F.col("i")).collect()}
    assert all(table["in." * k + "count"] == 1 for k in range(31))
    assert H.profile(parsed.limit(0), F.col("i")).count() == 0
    line = {"type": "msg", "created_at": "2026-11-11T11:11:11Z"}
    deep = {"usage": {"input_tokens": 5, "output_tokens": 3}, "model": "m"}
    for _ in range(14):
        deep = {"x": deep}
    parsed = spark.createDataFrame([(1, json.dumps(line | deep))], "i int, value string").select(
        "i", F.parse_json("value").alias("rec"))
    fields = H.draft_spec(parsed, F.col("i"))["fields"]
    assert fields["input"] == "x." * 14 + "usage.input_tokens" and fields["model"] == "x." * 14 + "model"


def test_draft_spec_finds_the_clock(spark):
    rows = [json.dumps({"type": "msg" if i % 2 else "note", "created": i, "time": 1.7e12 + i, "model": "m",
                        "usage": {"input_tokens": 5 * (i % 2), "output_tokens": 3 * (i % 2)}}) for i in range(40)]
    lines = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(rows)],
                                  "file string, block long, line long, value string")
    spec = H.draft_spec(records(lines), F.col("line"))
    assert spec == {"fields": {"output": "usage.output_tokens", "input": "usage.input_tokens", "ts": "time",
                               "model": "model"}, "where": {"type": "msg"}, "ts_unit": "millis"}


def test_no_first_copy_is_lost_late(spark, tmp_path):
    """Newest drops first, one file a batch: every turn lands once."""
    days = [f"2024-0{m}-{d:02d}T00:00:00Z" for m in (1, 2, 3) for d in range(1, 20)]
    rows = conform(spark.createDataFrame([(t, i, "p", "s") for i, t in enumerate(days)],
                                         "ts_raw string, seq long, provider string, session string"))
    landing = str(tmp_path / "in")
    for keep in ("ts_raw >= '2024-03'", "ts_raw < '2024-03'", "true"):
        rows.filter(keep).coalesce(1).write.mode("append").parquet(landing)
        once_only(watch_tables(spark, landing, rows.schema, 1), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(len(days)))


def test_small_chunks_stay_few(spark):
    """The number of chunks, whose cuts reach the driver, does not grow with the rows."""
    df = spark.range(20_000).select(F.lit("s").alias("k"), F.col("id").alias("i"))
    cut = by_chunks(df, ["k"], ["i"], lambda d, chunk: nearest(d, chunk).withColumn(
        "at", F.col(chunk) if chunk else F.lit(None)), chunk_rows=10).cache()
    assert cut.select("at").distinct().count() <= 512
    same = nearest(df, None).exceptAll(cut.drop("at"))
    assert cut.count() == 20_000 and same.isEmpty()
