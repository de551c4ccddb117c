import json

import pytest
from pyspark.sql import functions as F

from meterline.cluster import get_session  # noqa: F401
from meterline.operators.attribution import Topology
from meterline.schema import conform
from meterline.sources import logs as L
from meterline.sources import native as N
from meterline.sources import store as S
from meterline.sources.spec import SpecSource, load_specs

TOPO = Topology({"code_roots": ["/home/dev/code"], "surface_rules": {"*": [["src/*", "src/{1}"]]}}, home="/home/dev")
SPEC = {"provider": "p", "where": {"type": "model"}, "input_is_total": True,
        "from_path": {"session": [r"/session-.*-([^-/]+)\.jsonl$"], "sidechain": "["},
        "fields": {"ts": "timestamp", "model": "model", "input": "tokens.input",
                   "output": "tokens.output", "cache_read": "tokens.cached"},
        "tools": {"list": "toolCalls", "args": "args", "path_args": ["file_path"]}}


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def turn(i, **more):
    return {"type": "model", "timestamp": f"2026-08-19T01:{i // 60:02d}:{i % 60:02d}Z",
            "model": "m-20260101", "tokens": {"input": 100 + i, "output": 5, "cached": 60}, **more}


def test_spec_over_files(spark, tmp_path):
    write(tmp_path / "chats" / "session-2026-a1b2c3d4e5.jsonl", [
        {"type": "user"}, turn(1, toolCalls=[
            {"name": "read", "args": {"file_path": "/home/dev/code/my-app/src/api/h.ts"}},
            {"name": "list", "args": {"file_path": "/home/dev/code/my-app/README.md"}}]),
        "{broken", "", {"type": "model", "tokens": {"input": 0}}, turn(2)])
    source = SpecSource({**SPEC, "roots": [f"{tmp_path}/chats/*.jsonl", f"{tmp_path}/no/*.x"]}, TOPO)
    rows = source.load(spark).orderBy("turn").collect()
    assert [r["turn"] for r in rows] == [1, 2]
    assert rows[0]["input"] == 41 and rows[0]["cache_read"] == 60
    assert rows[0]["session"] == "a1b2c3d4e5" and rows[0]["model"] == "m"
    assert rows[0]["repo"] == "my-app" and rows[0]["surfaces"] == ["(root)", "src/api"]
    assert rows[0]["tools"] == ["read", "list"] and not rows[0]["sidechain"]
    assert L.quarantine(L.read_lines(spark, f"{tmp_path}/chats/*.jsonl")).count() == 1


def test_line_order_survives_a_file_read_in_pieces(spark, tmp_path):
    write(tmp_path / "big" / "session-x-deadbeef.jsonl", [turn(i) for i in range(600)])
    source = SpecSource({**SPEC, "roots": [f"{tmp_path}/big/*.jsonl"]}, TOPO)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192b")
    try:
        assert L.split_chunk(spark, source.spec["roots"]) == "block"
        rows = source.load(spark).select("turn", "input").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r[0], r[1]) for r in rows) == [(i + 1, 40 + i) for i in range(600)]


def test_broken_specs_are_left_out(tmp_path):
    (tmp_path / "a.json").write_text("{")
    (tmp_path / "b.json").write_text('{"provider": "x"}')
    (tmp_path / "c.json").write_text('{"provider": "y", "roots": ["~/x/*.jsonl"]}')
    found = load_specs([str(p) for p in tmp_path.glob("*.json")] + ["/none.json"], TOPO)
    assert [s.provider for s in found] == ["y"]


@pytest.mark.parametrize("value,want", [
    ({"a": {"b": [{"c": "x"}]}}, "x"), ({"a": {"b": []}}, None), ({"a": "b"}, None), ([1], None)])
def test_dig(spark, value, want):
    df = spark.createDataFrame([(json.dumps(value),)], "j string").select(
        F.parse_json("j").alias("v"))
    assert df.select(L.dig("v", "a.b.0.c")).first()[0] == want


def test_running_totals_reset_and_repeat(spark):
    total = lambda i, o: {"timestamp": "2026-08-19T01:00:00Z", "type": "event_msg", "payload": {
        "type": "token_count", "info": {"total_token_usage": {
            "input_tokens": i, "cached_input_tokens": 0, "output_tokens": o}}}}
    call = {"type": "response_item", "payload": {"type": "function_call", "name": "shell"}}
    log = [{"type": "session_meta", "payload": {"id": "thread-000001", "cwd": "/x/proj",
                                                "source": '{"subagent": "rev"}'}},
           {"type": "turn_context", "payload": {"model": "openai/m", "effort": "low"}},
           call, total(10, 5), total(10, 5), call, call, total(4, 9), call,
           {"type": "event_msg", "payload": {"type": "token_count", "info": {}}}]
    lines = spark.createDataFrame([("f", 0, i, json.dumps(r)) for i, r in enumerate(log)],
                                  L.LINE_SCHEMA)
    rows = N.rollout(lines, TOPO).orderBy("turn").collect()
    assert [(r["turn"], r["input"], r["output"], len(r["tools"])) for r in rows] == \
        [(1, 10, 5, 1), (2, 0, 4, 2)]
    assert rows[0]["agent"] == "rev" and rows[0]["sidechain"] and rows[0]["workspace"] == "proj"
    assert rows[0]["session"] == "thread-000001" and rows[0]["model"] == "m"


def turns_frame(spark, rows):
    from meterline.schema import conform
    return conform(spark.createDataFrame(
        rows, "provider string, session string, ts_raw string, workspace string, output long, "
              "synthetic boolean, seq long"))


def test_store_repair(spark, tmp_path):
    path = str(tmp_path / "store")
    a = ("p", "s1", "2026-01-05T00:00:00Z", "w", 1, False, 1)
    sample = ("p", "dabc12", "2026-02-05T00:00:00Z", "growth-web", 1, False, 2)
    flagged = ("p", "s9", None, "w", 1, True, 3)
    S.append(turns_frame(spark, [a, sample, flagged, a[:-1] + (9,)]), path)
    assert S.count_samples(S.scan(spark, path)).first()[0] == 2
    S.purge_samples(spark, path)
    assert [r["month"] for r in S.scan(spark, path).collect()] == ["2026-01", "2026-01"]
    S.dedupe_store(spark, path)
    assert [r["seq"] for r in S.scan(spark, path).collect()] == [1]
    S.dedupe_store(spark, path)
    assert S.scan(spark, path).count() == 1


def test_full_sync_twice_writes_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("p", f"s{i}", "2026-01-05T00:00:00Z", "w", i, False, i) for i in range(20)]

    def bad(_):
        raise OSError("gone")

    sources = [S.Source("bad", bad), S.Source("p", lambda s: turns_frame(s, rows + rows[:5]))]
    first = {r["provider"]: r for r in S.sync(spark, sources, path, full=True).collect()}
    again = {r["provider"]: r for r in S.sync(spark, sources, path, full=True).collect()}
    assert first["bad"]["error"].startswith("OSError") and not first["bad"]["ok"]
    assert again["p"]["written"] == 0 and again["p"]["read"] == 25


def test_reconcile_reads_the_time_of_the_fresh_turns(spark, tmp_path):
    """Turns of other times are not compared; missing, empty and odd stamps still find their copies."""
    stamps = ["2024-01-01T00:00:00Z", "2024-01-15T00:00:00Z", "2024-01-15T12:00:00Z", "2024-02-01T00:00:00Z", None, "", "odd"]

    def made(rows):
        return conform(spark.createDataFrame(rows, "ts_raw string, session string, seq long"))

    path = str(tmp_path / "store")
    S.append(made([(t, "a", i) for i, t in enumerate(stamps)]), path)
    fresh = made([(t, s, i) for i, t in enumerate(stamps[1:]) for s in "ab"])
    got = S.reconcile_months(fresh, path)
    assert sorted((r["ts_raw"] or "", r["session"]) for r in got.collect()) == sorted(
        (t, "b") for t in {t or "" for t in stamps[1:]})
    dated = fresh.filter("ts_raw like '2024-%'")
    assert sorted(r["ts_raw"] for r in S.reconcile_months(dated, path).collect()) == stamps[1:4]
    plan = S.reconcile_months(dated, path)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_raw,2024-01-15T00:00:00Z)" in plan


def test_only_new_turns_are_compared_with_each_other(spark, monkeypatch):
    """Turns that the store holds are gone before the first copies are looked for."""
    row = lambda t, i: (f"2024-01-0{t}T00:00:00Z", i, "p", "s")
    turns = lambda rows: conform(spark.createDataFrame(
        rows, "ts_raw string, seq long, provider string, session string"))
    fresh, stored = turns([row(1, 1), row(1, 2), row(2, 3), row(3, 5), row(3, 4)]), turns([row(1, 9), row(2, 8)])
    seen, first = [], S.first_copies

    def watched(df):
        seen.append(sorted(r["seq"] for r in df.collect()))
        return first(df)

    monkeypatch.setattr(S, "first_copies", watched)
    assert [r["seq"] for r in S.reconcile(fresh, stored).collect()] == [4]
    assert seen == [[4, 5]]
