"""Logs that grow, shrink and are replaced between reads."""

import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from meterline.operators.attribution import Topology
from meterline.sources import native as N
from meterline.sources import store as S
from meterline.sources import tail
from meterline.sources.resume import MERGE, GrowingLogs, ReaderState

TOPO = Topology({"code_roots": ["/home/dev/code"]}, home="/home/dev")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: b.replace(b"\r", b"\n")), max_size=12).map(b"\n".join),
       st.lists(st.integers(0, 150), max_size=5), st.integers(1, 9), st.integers(0, 400))
def test_ranges_share_no_line_and_lose_none(data, cuts, read, long):
    data = b"x" * long + data
    bounds = sorted({0, len(data), *(c % (len(data) + 1) for c in cuts)})
    got = [x for a, b in zip(bounds, bounds[1:]) for x in tail.lines_of(io.BytesIO(data), a, b, read)]
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_only_the_range_is_read():
    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            self.total += len(out)
            return out
    old, new = b"".join(b"%05d\n" % i for i in range(20_000)), b"".join(b"%05d\n" % i for i in range(50))
    handle = Counted(old + new)
    assert len(list(tail.lines_of(handle, len(old), len(old + new)))) == 50
    assert handle.total <= len(new) + 256


def test_tasks_cut_long_files_and_gather_short_ones():
    files = [("a", "a", 0, 250, True), ("b", "b", 10, 30, False), ("c", "c", 0, 70, True), ("d", "d", 5, 5, False)]
    tasks = [t.ranges for t in tail.tasks_of(files, 100)]
    assert all(sum(r[3] - r[2] for r in t) <= 100 for t in tasks)
    assert [r[:4] for t in tasks for r in t] == [("a", "a", 0, 100), ("a", "a", 100, 200), ("a", "a", 200, 250),
                                                 ("b", "b", 10, 30), ("c", "c", 0, 70)]
    assert len(tasks) == 4 and tail.tasks_of([], 100) == []


def test_many_short_ranges_share_a_task():
    cut = tail.tasks_of([("a", "a", 0, 10_000, True), ("b", "b", 7, 2_000, False)], 3)
    tasks = tail.gathered(cut, most=20)
    assert len(cut) > 3_000 and len(tasks) <= 21
    assert [r for t in tasks for r in t.ranges] == [r for t in cut for r in t.ranges]
    assert tail.gathered(cut, most=20, size=3) == cut and tail.gathered(cut[:20], most=20) == cut[:20]
    reader = tail._Batch({"ranges": json.dumps([["a", "a", 0, 100 * tail.TASKS, True]]), "bytes": "10"})
    assert len(reader.partitions()) <= tail.TASKS


def total(i, n):
    return {"type": "event_msg", "timestamp": f"2026-03-0{1 + i // 60}T01:{i % 60:02d}:00Z", "payload": {
        "type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": n}}}}


def call(name):
    return {"type": "event_msg", "payload": {"type": "function_call", "name": name, "arguments": "{}"}}


def text(*records):
    return "".join(json.dumps(r) + "\n" for r in records)


META = {"type": "session_meta", "payload": {"id": "thread-1", "cwd": "/home/dev/code/shop", "source": "cli"}}
CONTEXT = {"type": "turn_context", "payload": {"model": "m-one", "effort": "high", "cwd": ""}}


def turns_of(spark, logs):
    rows = S.scan(spark, logs.store).orderBy("ts_raw", "turn").collect()
    return [(r["turn"], r["input"], r["model"], r["session"], r["repo"], r["tools"]) for r in rows]


def test_a_log_that_grows_shrinks_and_is_replaced(spark, tmp_path):
    log, store = tmp_path / "logs" / "a.jsonl", str(tmp_path / "store")
    log.parent.mkdir()
    logs = GrowingLogs("codex", [f"{tmp_path}/logs/*.jsonl"], N.ROLLOUT, TOPO, store)
    half = json.dumps(total(2, 175))
    log.write_text(text(META, CONTEXT, total(1, 100), call("shell")) + half[:40])
    first = logs.sync(spark)
    assert (first["files"], first["turns"], first["written"]) == (1, 1, 1)
    # The rest of the cut line, another call: settings, total and the waiting call are known.
    log.write_text(text(META, CONTEXT, total(1, 100), call("shell")) + half + "\n" + text(call("edit")))
    second = logs.sync(spark)
    assert second["bytes"] == len(half) - 40 + 1 + len(text(call("edit"))) and second["written"] == 1
    assert turns_of(spark, logs)[1] == (2, 75, "m-one", "thread-1", "shop", ["shell"])
    assert logs.sync(spark) == {"files": 0, "bytes": 0, "turns": 0, "written": 0}

    # A job lost after its turns were appended: the version before is found, nothing is doubled.
    log.write_text(log.read_text() + text(total(3, 200)))
    commit, ReaderState.commit = ReaderState.commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    try:
        logs.sync(spark)
        raise AssertionError
    except OSError:
        pass
    finally:
        ReaderState.commit = commit
    assert len(turns_of(spark, logs)) == 3
    again = logs.sync(spark)
    assert (again["turns"], again["written"]) == (1, 0)
    assert turns_of(spark, logs)[2] == (3, 25, "m-one", "thread-1", "shop", ["edit"])

    # Shrunk, then replaced by a longer one: read anew, with nothing carried over.
    log.write_text(text(META, total(61, 5)))
    assert logs.sync(spark)["bytes"] == log.stat().st_size
    assert turns_of(spark, logs)[3] == (1, 5, None, "thread-1", "shop", [])
    other = {**META, "payload": {**META["payload"], "id": "thread-2"}}
    log.write_text(text(other, CONTEXT, total(62, 9), total(63, 19), total(64, 20)))
    assert logs.sync(spark)["bytes"] == log.stat().st_size
    assert [t[:4] for t in turns_of(spark, logs)[4:]] == [(1, 9, "m-one", "thread-2"), (2, 10, "m-one", "thread-2"),
                                                          (3, 1, "m-one", "thread-2")]


def test_versions_are_merged_and_old_ones_go(spark, tmp_path):
    state = ReaderState(spark, str(tmp_path / "state"))
    for n in range(1, MERGE + 4):
        cursors = spark.createDataFrame([(f"f{n % 5}", n, n, n)], "file string, size long, mtime long, mark long")
        state.commit(n, cursors, spark.createDataFrame([(f"f{n % 5}", n)], "file string, base long"))
        if n in (3, MERGE + 1, MERGE + 3):
            want = {f"f{i % 5}": i for i in range(1, n + 1)}
            assert {r["file"]: r["size"] for r in state.cursors().collect()} == want
            carried = state.carried(spark.createDataFrame([], "file string, base long").schema)
            assert {r["file"]: r["base"] for r in carried.collect()} == want
    assert len(state.versions()) <= 3
    assert {r["size"] for r in state.cursors(MERGE + 3).collect()} == set(range(MERGE - 2, MERGE + 3))


def test_globs_stay_within_their_folder(tmp_path):
    for name in ("a/x.jsonl", "a/b/y.jsonl", "a/_hidden.jsonl", "z.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    short = lambda globs: {k.removeprefix(f"file://{tmp_path}/"): v for k, v in tail.sizes(globs).items()}
    assert short([f"{tmp_path}/*/*.jsonl"]) == {"a/x.jsonl": 2}
    assert short([f"file://{tmp_path}/a/*/*.jsonl", f"{tmp_path}/*.jsonl"]) == {"a/b/y.jsonl": 2, "z.jsonl": 2}
    assert short([f"{tmp_path}/none/*"]) == {}


def test_providers_of_a_registry_fail_alone(spark, tmp_path):
    from meterline.sources.registry import growing_sources
    from meterline.sources.resume import sync_grown
    (tmp_path / "spec.json").write_text(json.dumps({
        "provider": "own", "roots": [f"{tmp_path}/own/*.jsonl"], "where": {"type": "m"},
        "fields": {"ts": "at", "output": "n"}}))
    (tmp_path / "own").mkdir()
    roots = {p: [f"{tmp_path}/{p}/*.jsonl"] for p in ("claude-code", "codex", "kimi-code", "antigravity")}
    logs = growing_sources(TOPO, str(tmp_path / "store"), roots, specs=[str(tmp_path / "spec.json")])
    assert [x.provider for x in logs] == ["claude-code", "codex", "kimi-code", "antigravity", "own"]
    rows = [{"type": "m", "at": f"2026-01-01T00:00:0{i}Z", "n": i} for i in range(1, 6)]
    for n in (2, 5):
        (tmp_path / "own" / "a.jsonl").write_text(text({"type": "x"}, *rows[:n]))
        logs[1].shape = None  # a reader that breaks is not asked while it has no logs
        got = {r["provider"]: r for r in sync_grown(spark, logs[1:2] + logs[-1:]).collect()}
    assert got["codex"]["ok"] and got["own"]["written"] == 3
    assert [r["turn"] for r in S.scan(spark, str(tmp_path / "store")).orderBy("turn").collect()] == [1, 2, 3, 4, 5]
    logs[-1].shape = None
    (tmp_path / "own" / "a.jsonl").write_text(text({"type": "x"}, *rows, rows[0]))
    got = sync_grown(spark, logs[-1:]).first()
    assert not got["ok"] and "AttributeError" in got["error"]
