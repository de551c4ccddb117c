"""Windows kept fresh by a stream, late turns included; files of a written store."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from meterline import cluster
from meterline.streaming import jobs as J
from verification import catalogue  # noqa: F401
from verification.registry import QUERIES

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FIRST = [("a", 0), ("a", 3), ("a", 16), ("b", 299), (None, 20), ("a", 700), ("b", None)]
LATER = [("a", 2), ("a", 575), ("b", 576), ("c", 690), ("a", 900), ("a", 900)]  # minutes; the first is too late


def wanted(batches, hours, slide, late=120):
    """Windows as a watermark closes them: a turn counts where its window was open when it came."""
    used, limit = {}, None
    for batch in batches:
        for who, at in batch:
            if at is not None:
                for start in range((at - hours * 60) // slide * slide, at + 1, slide):
                    if start <= at < start + hours * 60 and (limit is None or start + hours * 60 > limit):
                        used[start + hours * 60, who] = used.get((start + hours * 60, who), 0) + 1
        limit = max(x for x in (limit, *(at - late for _, at in batch if at is not None)) if x is not None)
    return {(T0 + dt.timedelta(minutes=end), who, n) for (end, who), n in used.items() if end <= limit}


@pytest.mark.parametrize("hours,slide", [(5, 15), (1, 45)])
def test_rolling_quota_over_batches_with_late_turns(spark, tmp_path, hours, slide):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    batches = [FIRST, LATER, [("a", 901)], [("b", 3000)], [("c", 6000)]]
    for batch in batches:
        rows = spark.createDataFrame([(w, None if m is None else T0 + dt.timedelta(minutes=m)) for w, m in batch],
                                     "person string, ts timestamp").coalesce(1)
        rows.write.mode("append").parquet(landing)
        J.rolling_quota(J.watch_tables(spark, landing, rows.schema), "person", out, mark, hours, f"{slide} minutes")
    found = J.quota_rows(spark, out).select(F.unix_seconds("as_of"), "person", "used").collect()
    got = [(dt.datetime.fromtimestamp(s, dt.timezone.utc), w, n) for s, w, n in found]
    assert len(got) == len(set(got)) and set(got) == wanted(batches, hours, slide)
    assert not os.path.exists(f"{out}/slots/batch=0")  # no open window needs it


def test_turns_are_held_once_and_not_once_per_window(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("person"), F.timestamp_seconds(
        F.lit(1704067200) + F.col("id") * 60).alias("ts"))
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(landing)
    J.rolling_quota(J.watch_tables(spark, landing, rows.schema), "person", out, str(tmp_path / "mark"))
    assert spark.read.parquet(f"{out}/slots").count() <= 34 * 3
    assert J.quota_rows(spark, out).agg(F.max("used")).first()[0] == 100  # five hours of every third minute


def test_a_user_has_one_file_however_many_tasks_write(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
                                   (F.col("id") % 9).alias("user_id"), F.lit('{"k": 1}').alias("props"))
    rows.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["s01_discover"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted((f"users/u={u}", 1) for u in range(9))
    files = glob.glob(f"{cluster._MADE[-1].removeprefix('file:')}/users/*/*.txt")
    assert len(files) == 9
