"""Log sources: logs are derived from ``events`` (and ``conversations``) and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.cluster import scratch_path
from meterline.functions.clock import epoch_to_iso
from meterline.schema import event_key
from meterline.sources import logs as L
from meterline.sources import native as N
from meterline.sources import store as S
from meterline.sources.elements import read_elements
from meterline.sources.registry import LogSource
from meterline.sources.resume import GrowingLogs
from meterline.sources.spec import SpecSource
from verification.registry import query
from verification.rollup_queries import _doubled
from verification.tables import TOPOLOGY, table, turns, with_turns

FILES = 40  # users share log files; each file is one ordered log
BLOCK = 50  # lines per block of a derived log


def events(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn(
        "iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def as_lines(df, rec, file):
    """JSON lines with a place in their file."""
    return df.select(file.alias("file"), F.floor(F.col("event_id") / BLOCK).alias("block"),
                     F.col("event_id").alias("line"), F.to_json(rec).alias("value"))


CHAT_SPEC = {
    "provider": "chat", "roots": [], "where": {"role": "assistant"}, "default_entrypoint": "cli",
    "entrypoint_map": {"vs": "ide"}, "default_model": "mid-a", "input_is_total": True,
    "from_path": {"session": ["/none/([^/]+)/x$", r"/u([0-9]+)/log\.jsonl$"],
                  "sidechain": "/u[0-9]*5/"},
    "fields": {"ts": "at.0", "session": "conversation.id", "cwd": "workspace.path",
               "model": "model", "stop": "finish", "entrypoint": "entry",
               "input": "usage.prompt", "output": "usage.completion",
               "cache_read": "usage.details.cached", "cache_create": "usage.details.created"},
    "tools": {"list": "calls", "where": {"type": "function"}, "name": "function.name",
              "args": "function.args", "path_args": ["file_path", "path"]},
}


def chat_lines(spark, sf):
    """Chat records: one in three is a user message, one in five has no usage."""
    i = F.col("event_id")
    tool = lambda name, path, kind: F.struct(
        F.lit(kind).alias("type"), F.struct(F.lit(name).alias("name"), F.struct(
            path.alias("file_path")).alias("args")).alias("function"))
    user = F.col("user_id").cast("string")
    rec = F.struct(
        F.when(i % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.array("iso").alias("at"),
        F.when(i % 4 != 0, F.struct(F.concat(F.lit("conversation-"), user).alias("id")))
        .alias("conversation"),
        F.when(i % 7 == 0, "vs").when(i % 7 == 1, "web").alias("entry"),
        F.struct(F.concat(F.lit("/home/dev/code/r"), user).alias("path")).alias("workspace"),
        F.when(i % 2 == 0, F.lit("openai/light-a-20240101")).alias("model"),
        F.lit("stop").alias("finish"),
        F.when(i % 5 != 0, F.struct(
            (i % 900 + 1000).alias("prompt"), (i % 70 + 1).alias("completion"),
            F.struct((i % 800).alias("cached"), (i % 50).alias("created")).alias("details")))
        .alias("usage"),
        F.when(i % 2 == 0, F.array(
            tool("Read", F.concat(F.lit("/home/dev/code/r"), user, F.lit("/src/a/b.py")), "function"),
            tool("Skip", F.lit("/tmp/x"), "other"),
            tool("Edit", F.concat(F.lit("/home/dev/code/r"), user, F.lit("/docs/x.md")), "function")))
        .alias("calls"))
    file = F.concat(F.lit("/logs/u"), F.col("user_id") % FILES, F.lit("/log.jsonl"))
    return as_lines(events(spark, sf), rec, file)


CHAT_SQL = f"""chat AS (SELECT *, '/logs/u' || (user_id % {FILES}) || '/log.jsonl' AS file,
  event_id % 900 + 1000 AS prompt, event_id % 800 AS cached, event_id % 50 AS created
  FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0),
chat_turns AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_raw,
  CASE WHEN event_id % 4 <> 0 THEN 'conversation-' || user_id ELSE CAST(user_id % {FILES} AS VARCHAR) END AS session,
  'r' || user_id AS workspace, 'r' || user_id AS repo,
  CASE WHEN event_id % 2 = 0 THEN ['docs', 'src/a'] ELSE CAST([] AS VARCHAR[]) END AS surfaces,
  CASE event_id % 7 WHEN 0 THEN 'ide' WHEN 1 THEN 'web' ELSE 'cli' END AS entrypoint,
  CASE WHEN event_id % 2 = 0 THEN 'light-a' ELSE 'mid-a' END AS model,
  (user_id % {FILES}) % 10 = 5 AS sidechain,
  CAST(row_number() OVER (PARTITION BY file ORDER BY event_id) AS INTEGER) AS turn,
  greatest(0, prompt - cached - created) AS input, event_id % 70 + 1 AS output,
  cached AS cache_read, created AS cache_create,
  CASE WHEN event_id % 2 = 0 THEN ['Read', 'Edit'] ELSE CAST([] AS VARCHAR[]) END AS tools,
  CASE WHEN event_id % 7 = 0 THEN 'personal' ELSE 'work' END AS lane FROM chat)"""


def chat_turns(spark, sf):
    return SpecSource(CHAT_SPEC, TOPOLOGY).turns(chat_lines(spark, sf), "block")


def chat(name, cols, doc=None):
    """Register one check over the chat turns."""
    def run(spark, sf):
        return chat_turns(spark, sf).select("seq", *cols)
    run.__doc__ = doc
    listed = ", ".join(["seq", *cols])
    query(name, f"WITH {CHAT_SQL} SELECT {listed} FROM chat_turns")(run)


@query("s01_discover", """
SELECT 'users/u=' || user_id AS folder, 1 AS found FROM events GROUP BY user_id""")
def s01(spark, sf):
    """Files of a written store found by glob, without reading them."""
    root = scratch_path(spark, "logs")
    # One file a user, written by many tasks.
    events(spark, sf).withColumn("u", F.col("user_id")).select("iso", "u") \
        .repartition(8 * spark.sparkContext.defaultParallelism, "u").write.partitionBy("u").text(f"{root}/users")
    found = L.discover(spark, f"{root}/users/*/*.txt")
    return found.groupBy(F.regexp_extract("file", "(users/u=[0-9]+)/", 1).alias("folder")) \
        .agg(F.lit(1).alias("found"))


def _written(spark, sf):
    """Chat lines written as text files, one folder per user."""
    root = scratch_path(spark, "logs")
    lines = chat_lines(spark, sf)
    lines.select("value", F.regexp_extract("file", "u([0-9]+)/", 1).alias("u"), "line") \
        .repartitionByRange(8, "u", "line").sortWithinPartitions("u", "line") \
        .drop("line").write.partitionBy("u").text(root)
    return f"{root}/*/*.txt"


@query("s02_jsonl_scan", f"""WITH {CHAT_SQL} SELECT ts_raw, model, entrypoint, input, output,
  cache_read, cache_create, tools, count(*) AS n FROM chat_turns GROUP BY ALL""")
def s02(spark, sf):
    """Lines written to files, read back and parsed."""
    source = SpecSource({**CHAT_SPEC, "roots": [_written(spark, sf)]}, TOPOLOGY)
    return source.load(spark).groupBy("ts_raw", "model", "entrypoint", "input", "output",
                                      "cache_read", "cache_create", "tools") \
        .agg(F.count("*").alias("n"))


DOC_SPEC = {"provider": "doc", "format": "json", "roots": [], "where": {"role": "assistant"},
            "ts_unit": "seconds", "from_path": {"session": ["/c([0-9]+)/"]},
            "fields": {"ts": "at", "output": "chars", "model": "model"}}


def _doc(extra=None):
    return F.struct("role", (F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn")).alias("at"),
                    F.length("text").alias("chars"), F.lit("mid-a").alias("model"))


DOC_SQL = """SELECT CAST(conv_id AS VARCHAR) AS session, {turn} AS turn, length(text) AS output,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100 + c.turn), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_raw
FROM conversations c WHERE role = 'assistant' AND length(text) > 0"""


@query("s03_json_document", DOC_SQL.format(turn="CAST(1 AS INTEGER)"))
def s03(spark, sf):
    """One document per message."""
    c = table(spark, sf, "conversations")
    docs = c.select(F.concat(F.lit("/c"), "conv_id", F.lit("/m"), "turn", F.lit(".json"))
                    .alias("file"), F.lit(0).cast("long").alias("block"),
                    F.lit(0).cast("long").alias("line"), F.to_json(_doc()).alias("value"))
    return SpecSource(DOC_SPEC, TOPOLOGY).turns(docs).select("session", "turn", "output", "ts_raw")


@query("s04_json_array", DOC_SQL.format(
    turn="CAST(row_number() OVER (PARTITION BY conv_id ORDER BY c.turn) AS INTEGER)"))
def s04(spark, sf):
    """One document per conversation, its messages in an array."""
    c = table(spark, sf, "conversations")
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").alias("o"), _doc().alias("m")))).alias("ms")).select(
        F.concat(F.lit("/c"), "conv_id", F.lit("/history.json")).alias("file"),
        F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line"),
        F.to_json(F.struct(F.struct(F.transform("ms", lambda x: x["m"]).alias("messages"))
                           .alias("task"))).alias("value"))
    spec = {**DOC_SPEC, "records": "task.messages"}
    return SpecSource(spec, TOPOLOGY).turns(docs).select("session", "turn", "output", "ts_raw")


DOCS = 4  # long documents, each with the messages of every fourth conversation


@query("s04_split_documents", f"""
SELECT CAST(conv_id % {DOCS} AS VARCHAR) AS session, CAST(row_number() OVER (
  PARTITION BY conv_id % {DOCS} ORDER BY conv_id, c.turn) AS INTEGER) AS turn, length(text) AS output,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100 + c.turn), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_raw
FROM conversations c WHERE role = 'assistant' AND length(text) > 0""")
def s04_split(spark, sf):
    """Documents with one long list each, cut into pieces of 16 kB that are read on their own."""
    c = table(spark, sf, "conversations")
    text = F.to_json(F.struct("role", "text", *[_doc()[k].alias(k) for k in ("at", "chars", "model")]))
    place = [(F.col("conv_id") % DOCS).alias("line"), F.lit(1).alias("part"), "conv_id", "turn"]
    rows = c.select(*place, F.concat(F.lit(", "), text).alias("value"))
    ends = spark.range(DOCS).select(F.col("id").alias("line"), F.explode(F.create_map(
        F.lit(0), F.lit('{"task": {"notes": ["}", {"messages": []}], "messages": [null'),
        F.lit(2), F.lit("]}}"))).alias("part", "value"))
    path = scratch_path(spark, "documents")
    rows.unionByName(ends, allowMissingColumns=True).repartition(DOCS, "line").sortWithinPartitions(
        "line", "part", "conv_id", "turn").select(F.col("line").alias("doc"), "value") \
        .write.partitionBy("doc").text(path)
    recs = read_elements(spark, f"{path}/*/part-*", "task.messages", longer_than=0, piece=16 << 10)
    spec = {**DOC_SPEC, "records": "task.messages", "from_path": {"session": ["/doc=([0-9]+)/"]}}
    return SpecSource(spec, TOPOLOGY).of_records(recs, "block").select("session", "turn", "output", "ts_raw")


@query("s05_quarantine", """
SELECT CASE WHEN event_id % 6 = 0 THEN 'broken' ELSE 'kept' END AS state, count(*) AS n,
  CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 6 <> 1 GROUP BY 1""")
def s05(spark, sf):
    """Half-written lines go to quarantine, blank ones nowhere."""
    lines = chat_lines(spark, sf)
    cut = lines.withColumn("value", F.when(F.col("line") % 6 == 0, F.expr("left(value, length(value) - 3)"))
                           .when(F.col("line") % 6 == 1, "   ").otherwise(F.col("value")))
    both = L.records(cut).select("line", F.lit("kept").alias("state")).unionByName(
        L.quarantine(cut).select("line", F.lit("broken").alias("state")))
    return both.groupBy("state").agg(F.count("*").alias("n"), F.sum("line").alias("ids"))


@query("s06_record_filter", """
SELECT event_id % 3 <> 0 AND event_id % 5 <> 0 AS is_turn, count(*) AS n FROM events GROUP BY 1""")
def s06(spark, sf):
    recs = L.records(chat_lines(spark, sf))
    return recs.groupBy(SpecSource(CHAT_SPEC, TOPOLOGY).is_turn().alias("is_turn")) \
        .agg(F.count("*").alias("n"))


@query("s07_dotted_lookup", """
SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'Edit' END AS third_tool,
  CAST(CASE WHEN event_id % 5 <> 0 THEN event_id % 800 END AS BIGINT) AS cached,
  CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS VARCHAR) AS mistyped FROM events""")
def s07(spark, sf):
    d = lambda p, t="string": L.dig("rec", p, t)
    return L.records(chat_lines(spark, sf)).select(
        F.col("line").alias("seq"), d("calls.2.function.name").alias("third_tool"),
        d("usage.details.cached", "long").alias("cached"), d("usage.none.x").alias("missing"),
        d("role.0.deeper").alias("mistyped"))


chat("s08_session_from_path", ["session", "sidechain"])


@query("s09_epoch_stamps", """
SELECT event_id AS seq, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS millis,
  strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS seconds,
  CASE WHEN event_id % 2 = 0 THEN 'not a number'
    ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%gZ') END AS passed FROM events""")
def s09(spark, sf):
    e = events(spark, sf)
    sec = F.unix_seconds("ts").cast("string")
    return e.select(
        F.col("event_id").alias("seq"),
        epoch_to_iso(F.unix_millis("ts").cast("string"), "millis").alias("millis"),
        epoch_to_iso(sec, "seconds").alias("seconds"),
        epoch_to_iso(F.when(F.col("event_id") % 2 == 0, "not a number").otherwise(sec), "seconds")
        .alias("passed"))


chat("s10_net_input", ["input", "cache_read", "cache_create"])
chat("s11_tools_touched", ["tools", "surfaces", "repo"])
chat("s12_turn_ordinal", ["turn"])
chat("s13_defaults", ["entrypoint", "model", "workspace", "lane"])


def transcript_lines(spark, sf):
    i = F.col("event_id")
    usage = F.struct((i % 500).alias("input_tokens"), (i % 90 + 1).alias("output_tokens"),
                     (i % 40).alias("cache_creation_input_tokens"),
                     (i % 3000).alias("cache_read_input_tokens"),
                     F.struct((i % 40).alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
                     F.struct((i % 2).alias("web_search_requests")).alias("server_tool_use"),
                     F.lit("standard").alias("service_tier"))
    block = lambda kind, name: F.struct(
        F.lit(kind).alias("type"), F.lit(name).alias("name"),
        F.struct(F.lit("/home/dev/code/shop/src/ui/a.ts").alias("file_path")).alias("input"))
    rec = F.struct(
        F.when(i % 3 == 0, "user").otherwise("assistant").alias("type"),
        F.col("iso").alias("timestamp"),
        F.concat(F.lit("abcdefgh"), F.col("user_id")).alias("sessionId"),
        F.lit("/home/dev/code/clients").alias("cwd"), F.lit("vscode").alias("entrypoint"),
        (F.col("k") % 9 == 0).alias("isSidechain"),
        F.struct(F.lit("mid-a-20240101").alias("model"),
                 F.when(i % 4 != 0, usage).alias("usage"),
                 F.array(block("text", "no"), block("tool_use", "Edit")).alias("content"))
        .alias("message"))
    file = F.concat(F.lit("/t/"), F.col("user_id") % FILES, F.lit(".jsonl"))
    return as_lines(events(spark, sf), rec, file)


@query("s14_transcript", f"""
WITH a AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(row_number() OVER (PARTITION BY user_id % {FILES} ORDER BY event_id) AS INTEGER) AS turn
  FROM events WHERE event_id % 3 <> 0)
SELECT event_id AS seq, turn, 'abcdefgh' || user_id AS session, 'ide' AS entrypoint, 'mid-a' AS model,
  'clients' AS repo, k % 9 = 0 AS sidechain, event_id % 500 AS input, event_id % 90 + 1 AS output,
  event_id % 40 AS cache_create, event_id % 3000 AS cache_read, event_id % 40 AS cache_1h,
  CAST(0 AS BIGINT) AS cache_5m, CAST(event_id % 2 AS INTEGER) AS web_search, ['Edit'] AS tools,
  'standard' AS tier FROM a WHERE event_id % 4 <> 0""")
def s14(spark, sf):
    return N.transcript(transcript_lines(spark, sf), TOPOLOGY, chunk="block").select(
        "seq", "turn", "session", "entrypoint", "model", "repo", "sidechain", "input", "output",
        "cache_create", "cache_read", "cache_1h", "cache_5m", "web_search", "tools", "tier")


def on_disk(spark, lines, path, keep="true"):
    """Lines as log files: a folder with one file per log, in the order of the lines."""
    name = F.translate(F.col("file"), "/", "_").alias("log")
    (lines.filter(keep).select(name, "block", "line", "value").repartition("log")
     .sortWithinPartitions("log", "block", "line").select("log", "value")
     .write.mode("overwrite").partitionBy("log").text(path))


def from_disk(spark, lines, read):
    """Turns of written and reread logs, through a source that finds its own files."""
    path = scratch_path(spark, "logs")
    on_disk(spark, lines, path)
    return LogSource("disk", [f"{path}/*/*"], read, TOPOLOGY).load(spark)


@query("s14_files", f"""
WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id % {FILES} ORDER BY event_id) AS INTEGER) AS turn
  FROM events WHERE event_id % 3 <> 0)
SELECT 'abcdefgh' || user_id AS session, turn, event_id % 500 AS input, event_id % 90 + 1 AS output,
  event_id % 40 AS cache_create, event_id % 3000 AS cache_read FROM a WHERE event_id % 4 <> 0""")
def s14_files(spark, sf):
    """Transcripts written as files and found again by a source."""
    return from_disk(spark, transcript_lines(spark, sf), N.transcript).select(
        "session", "turn", "input", "output", "cache_create", "cache_read")


@query("s14_resumed", f"""
WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id % {FILES} ORDER BY event_id) AS INTEGER) AS turn
  FROM events WHERE event_id % 3 <> 0)
SELECT 'abcdefgh' || user_id AS session, turn, event_id % 500 AS input, event_id % 90 + 1 AS output,
  event_id % 40 AS cache_create, event_id % 3000 AS cache_read FROM a WHERE event_id % 4 <> 0""")
def s14_resumed(spark, sf):
    """Ordinals go on over three ingests; a log is read by many tasks of 64 kB."""
    lines = transcript_lines(spark, sf)
    return read_in_pieces(spark, lines, N.TRANSCRIPT, 3, 1 << 16)[0].select(
        "session", "turn", "input", "output", "cache_create", "cache_read")


@query("s26_grown_logs", """
WITH t AS (SELECT event_id, (SELECT max(event_id) // 2 FROM events) AS half FROM events
  WHERE event_id % 3 <> 0 AND event_id % 4 <> 0)
SELECT 'first' AS run, count(*) FILTER (event_id < half) AS written, count(*) FILTER (event_id < half) AS read FROM t
UNION ALL SELECT 'grown', count(*) FILTER (event_id >= half), count(*) FROM t
UNION ALL SELECT 'again', 0, count(*) FROM t UNION ALL SELECT 'unchanged', 0, 0""")
def s26_grown(spark, sf):
    """Logs grow between syncs: only the new turns are added; unchanged logs are not read."""
    path, store = scratch_path(spark, "logs"), scratch_path(spark, "store")
    lines = transcript_lines(spark, sf)
    half = events(spark, sf).agg(F.floor(F.max("event_id") / 2)).first()[0]
    source, runs = [LogSource("disk", [f"{path}/*/*"], N.transcript, TOPOLOGY).source()], []
    for run, keep, since in (("first", f"line < {half}", None), ("grown", "true", "2000-01-01T00:00:00"),
                             ("again", None, None), ("unchanged", None, "2100-01-01T00:00:00")):
        if keep:
            on_disk(spark, lines, path, keep)
        runs.append(S.sync(spark, source, store, since=since).select(F.lit(run).alias("run"), "written", "read"))
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out


def grow(spark, lines, path, keep):
    """Log files of stable names that hold the lines kept, in order; a log grows in place."""
    staged = scratch_path(spark, "staged")
    on_disk(spark, lines, staged, keep)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    for f in fs.globStatus(at(f"{staged}/log=*/part-*")):
        name = f.getPath().getParent().getName().removeprefix("log=")
        fs.delete(at(f"{path}/log{name}"), False)
        fs.rename(f.getPath(), at(f"{path}/log{name}"))


def bytes_of(lines, keep):
    return lines.filter(keep).agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]


def read_in_pieces(spark, lines, shape, pieces=5, bytes_per_task=1 << 20):
    """Turns of logs that grew between ``pieces`` ingests, and what every ingest reports."""
    path, store = scratch_path(spark, "logs"), scratch_path(spark, "store")
    logs = GrowingLogs("disk", [f"{path}/*"], shape, TOPOLOGY, store, bytes_per_task=bytes_per_task)
    last, reports, before = lines.agg(F.max("line")).first()[0], [], 0
    for piece in range(1, pieces + 1):
        keep = f"line <= {last * piece // pieces}"
        grow(spark, lines, path, keep)
        now = bytes_of(lines, keep)
        reports.append((f"piece {piece}", now - before, logs.sync(spark)))
        before = now
    reports.append(("nothing new", 0, logs.sync(spark)))
    return S.scan(spark, store), reports


@query("s26_byte_ranges", """
WITH l AS (SELECT max(event_id) AS last FROM events),
p AS (SELECT r, last * r // 3 AS hi, CASE r WHEN 1 THEN -1 ELSE last * (r - 1) // 3 END AS lo FROM l, range(1, 4) g(r)),
t AS (SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0)
SELECT 'piece ' || r AS run, count(event_id) AS written, true AS new_bytes_only
FROM p LEFT JOIN t ON event_id > lo AND event_id <= hi GROUP BY r UNION ALL SELECT 'nothing new', 0, true""")
def s26_bytes(spark, sf):
    """Logs grow in three pieces: every ingest reads the bytes that are new and no others."""
    lines = transcript_lines(spark, sf).filter("value is not null")
    _, reports = read_in_pieces(spark, lines, N.TRANSCRIPT, 3)
    rows = [(run, r["written"], r["bytes"] == size) for run, size, r in reports]
    return spark.createDataFrame(rows, "run string, written bigint, new_bytes_only boolean")


def rollout_lines(spark, sf):
    """Settings, calls and running totals; totals repeat, and reset now and then."""
    i, u = F.col("event_id"), F.col("user_id")
    total = F.floor(i / 10) * 7 % 5000  # repeats while the decade lasts, resets at 5000
    kind = i % 10
    none = F.lit(None)
    payload = F.struct(
        F.when(kind == 3, "function_call").when(kind == 4, "web_search_call")
        .when((kind == 5) | (kind == 6), "token_count").alias("type"),
        F.when(kind == 1, F.concat(F.lit("thread-"), i)).alias("id"),
        F.when(kind == 1, F.when(i % 20 == 1, "vscode").otherwise(
            '{"subagent": {"name": "reviewer"}}')).alias("source"),
        F.when(kind == 1, "/home/dev/code/meta").when(kind == 2, F.when(
            i % 20 == 2, "/home/dev/code/ctx").otherwise("")).alias("cwd"),
        F.when(kind == 2, "openai/light-a").alias("model"),
        F.when(kind == 2, "high").alias("reasoning_effort"),
        F.when(kind == 3, "shell").alias("name"),
        F.when(kind == 3, F.lit('{"workdir": "/home/dev/code/meta/docs/x.md"}')).alias("arguments"),
        F.when((kind == 5) | (kind == 6), F.struct(F.struct(
            (total * 3).alias("input_tokens"), total.alias("cached_input_tokens"),
            (total * 2).alias("output_tokens")).alias("total_token_usage"))).alias("info"))
    rec = F.struct(F.when(kind == 1, "session_meta").when(kind == 2, "turn_context")
                   .otherwise("event_msg").alias("type"), F.col("iso").alias("timestamp"),
                   payload.alias("payload"))
    # A log is every row of one fixed stride of ids, so it holds all ten kinds.
    file = F.concat(F.lit("/r/"), F.floor(i / 10) % FILES, F.lit(".jsonl"))
    return as_lines(events(spark, sf), rec, file)


# Each decade of ids is: 1 meta, 2 context, 3 call, 4 search, 5 total, 6 the same total again.
ROLLOUT_SQL = f"""WITH d AS (SELECT DISTINCT event_id // 10 AS d FROM events),
t AS (SELECT d, (d * 7) % 5000 AS total, d % {FILES} AS f,
  coalesce(lag((d * 7) % 5000) OVER (PARTITION BY d % {FILES} ORDER BY d), 0) AS prev FROM d
  WHERE EXISTS (SELECT 1 FROM events WHERE event_id = d * 10 + 5)),
r AS (SELECT *, greatest(0, total - prev) AS step FROM t),
-- a decade whose total fell emits nothing, and its calls wait for the next one
e AS (SELECT *, step > 0 AS emits, sum(CASE WHEN step > 0 THEN 1 ELSE 0 END) OVER (
    PARTITION BY f ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM r),
w AS (SELECT *, n - CASE WHEN emits THEN 1 ELSE 0 END AS grp FROM e),
c AS (SELECT f, grp, count(*) AS waits FROM w GROUP BY 1, 2)
"""


@query("s15_running_total", ROLLOUT_SQL + """
SELECT d * 10 + 5 AS seq, CAST(n AS INTEGER) AS turn, step * 2 AS input, step AS cache_read, step * 2 AS output
FROM w WHERE emits""")
def s15(spark, sf):
    return N.rollout(rollout_lines(spark, sf), TOPOLOGY, chunk="block").select(
        "seq", "turn", "input", "cache_read", "output")


@query("s15_files", ROLLOUT_SQL + """
SELECT d * 10 + 5 AS number, CAST(n AS INTEGER) AS turn, step * 2 AS input, step AS cache_read, step * 2 AS output
FROM w WHERE emits""")
def s15_files(spark, sf):
    """Running totals from files; the turn is known by the number in its session's id."""
    t = from_disk(spark, rollout_lines(spark, sf), N.rollout)
    number = F.regexp_extract("session", "([0-9]+)$", 1).cast("long") + 4
    return t.select(number.alias("number"), "turn", "input", "cache_read", "output")


RESUMED_SQL = ROLLOUT_SQL + """
SELECT d * 10 + 5 AS number, CAST(n AS INTEGER) AS turn, step * 2 AS input, step AS cache_read, step * 2 AS output,
  'light-a' AS model, CASE WHEN d % 2 = 0 THEN 'ide' END AS entrypoint, CASE WHEN d % 2 = 0 THEN 'ctx' ELSE 'meta' END AS workspace,
  waits * 2 AS calls FROM w JOIN c USING (f, grp) WHERE emits"""


def resumed(turns_):
    number = F.regexp_extract("session", "([0-9]+)$", 1).cast("long") + 4
    return turns_.select(number.alias("number"), "turn", "input", "cache_read", "output", "model", "entrypoint", "workspace",
                         F.size("tools").cast("long").alias("calls"))


@query("s15_resumed", RESUMED_SQL)
def s15_resumed(spark, sf):
    """Totals, settings, ordinals and waiting calls are carried over five ingests of growing logs."""
    return resumed(read_in_pieces(spark, rollout_lines(spark, sf), N.ROLLOUT)[0])


@query("s16_carried_settings", ROLLOUT_SQL + """
SELECT d * 10 + 5 AS seq, 'thread-' || (d * 10 + 1) AS session, 'light-a' AS model, 'high' AS effort,
  CASE WHEN d % 2 = 0 THEN 'ide' END AS entrypoint, CASE WHEN d % 2 = 0 THEN 'ctx' ELSE 'meta' END AS workspace
FROM w WHERE emits""")
def s16(spark, sf):
    return N.rollout(rollout_lines(spark, sf), TOPOLOGY, chunk="block").select(
        "seq", "session", "model", "effort", "entrypoint", "workspace")


@query("s17_pending_tools", ROLLOUT_SQL + """
SELECT d * 10 + 5 AS seq, waits * 2 AS calls, 'shell,WebSearch' AS first_two,
  CASE WHEN d % 2 = 0 THEN 'ctx' ELSE 'meta' END AS repo,
  CASE WHEN d % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['docs'] END AS surfaces
FROM w JOIN c USING (f, grp) WHERE emits""")
def s17(spark, sf):
    t = N.rollout(rollout_lines(spark, sf), TOPOLOGY, chunk="block")
    return t.select("seq", F.size("tools").cast("long").alias("calls"),
                    F.array_join(F.slice("tools", 1, 2), ",").alias("first_two"), "repo",
                    "surfaces")


@query("s18_subagent", ROLLOUT_SQL + """
SELECT d * 10 + 5 AS seq, d % 2 = 1 AS sidechain, CASE WHEN d % 2 = 1 THEN 'reviewer' END AS agent
FROM w WHERE emits""")
def s18(spark, sf):
    return N.rollout(rollout_lines(spark, sf), TOPOLOGY, chunk="block").select(
        "seq", "sidechain", "agent")


def oplog_lines(spark, sf):
    """Decades of ids: 1 config update, 3 and 4 calls of a step, 5 the step's end."""
    i = F.col("event_id")
    kind, d = i % 10, F.floor(i / 10)
    step = F.concat(F.lit("step-"), d)
    usage = F.when(d % 4 == 0, F.to_json(F.struct(
        (d % 50 + 1).alias("inputOther"), (d % 9).alias("output"), (d % 700)
        .alias("inputCacheRead"), (d % 30).alias("inputCacheCreation")))) \
        .when(d % 4 == 1, F.to_json(F.struct(
            (d % 50 + 1).alias("input_tokens"), (d % 9).alias("output_tokens"),
            (d % 700).alias("cache_read_input_tokens"),
            (d % 30).alias("cache_creation_input_tokens")))) \
        .when(d % 4 == 2, F.to_json(F.struct(
            (d % 50 + 701).alias("prompt_tokens"), (d % 9).alias("completion_tokens"),
            F.struct((d % 700).alias("cached_tokens")).alias("prompt_tokens_details"))))
    event = F.struct(
        F.when(kind == 5, "step.end").when(kind.isin(3, 4), "tool.call")
        .otherwise("step.begin").alias("type"),
        F.when(kind == 5, step).alias("uuid"), F.when(kind.isin(3, 4), step).alias("stepUuid"),
        F.when(kind == 3, "ReadFile").when(kind == 4, "Shell").alias("name"),
        F.when(kind == 3, F.lit('{"path": "/home/dev/code/ops/docs/a.md"}')).alias("args"),
        F.when(kind == 5, F.parse_json(usage)).alias("usage"))
    rec = F.struct(
        F.when(kind == 1, "config.update").when(kind == 2, "metadata")
        .otherwise("context.append_loop_event").alias("type"),
        F.unix_millis("ts").alias("time"),
        F.when((kind == 1) & (d % 2 == 0), F.when(d % 4 == 0, "kimi-code/k3").otherwise("other"))
        .alias("modelAlias"),
        F.when((kind == 1) & (d % 3 == 0), F.concat(F.lit("/home/dev/code/c"), d % 5)).alias("cwd"),
        F.when(kind == 1, F.when(d % 6 == 0, "off").when(d % 6 == 3, "high"))
        .alias("thinkingEffort"),
        F.when(kind > 2, event).alias("event"))
    f = d % FILES
    file = F.concat(F.lit("/h/sessions/wd_proj"), f % 7, F.lit("_0123456789ab/session-"), f,
                    F.when(f % 3 == 0, "/wire.jsonl").when(f % 3 == 1, "/agents/main/wire.jsonl")
                    .otherwise("/agents/helper/wire.jsonl"))
    return as_lines(events(spark, sf), rec, file)


OPLOG_SQL = f"""WITH d AS (SELECT DISTINCT event_id // 10 AS d FROM events WHERE event_id % 10 = 5),
s AS (SELECT *, d % {FILES} AS f, CASE WHEN d % 4 = 0 THEN 'kimi-k3' WHEN d % 2 = 0 THEN 'other' END AS u_model,
  CASE WHEN d % 3 = 0 THEN 'c' || (d % 5) END AS u_cwd,
  CASE WHEN d % 6 = 0 THEN 'off' WHEN d % 6 = 3 THEN 'high' END AS u_effort FROM d),
r AS (SELECT *, last_value(u_model IGNORE NULLS) OVER w AS model, last_value(u_cwd IGNORE NULLS) OVER w AS cwd,
  nullif(last_value(u_effort IGNORE NULLS) OVER w, 'off') AS effort FROM s
  WINDOW w AS (PARTITION BY f ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY f ORDER BY d) AS INTEGER) AS turn FROM r WHERE d % 4 <> 3)
"""


@query("s19_op_log_state", OPLOG_SQL + "SELECT d * 10 + 5 AS seq, turn, model, effort FROM o")
def s19(spark, sf):
    return N.oplog(oplog_lines(spark, sf), TOPOLOGY, chunk="block").select(
        "seq", "turn", "model", "effort")


@query("s19_files", OPLOG_SQL + """
SELECT turn, model, effort, count(*) AS n FROM o GROUP BY ALL""")
def s19_files(spark, sf):
    return from_disk(spark, oplog_lines(spark, sf), N.oplog).groupBy("turn", "model", "effort") \
        .agg(F.count("*").alias("n"))


@query("s19_resumed", OPLOG_SQL + """
SELECT turn, model, effort, coalesce(cwd, 'ops') AS repo, 'ReadFile,Shell' AS calls, count(*) AS n FROM o GROUP BY ALL""")
def s19_resumed(spark, sf):
    """Settings, ordinals and calls of unfinished steps are carried over five ingests of growing logs."""
    t, _ = read_in_pieces(spark, oplog_lines(spark, sf), N.OPLOG)
    return t.groupBy("turn", "model", "effort", "repo", F.array_join("tools", ",").alias("calls")).agg(F.count("*").alias("n"))


@query("s20_step_calls", OPLOG_SQL + """
SELECT d * 10 + 5 AS seq, ['ReadFile', 'Shell'] AS tools, coalesce(cwd, 'ops') AS repo,
  CASE WHEN cwd IS NULL THEN ['docs'] ELSE CAST([] AS VARCHAR[]) END AS surfaces FROM o""")
def s20(spark, sf):
    return N.oplog(oplog_lines(spark, sf), TOPOLOGY, chunk="block").select(
        "seq", "tools", "repo", "surfaces")


@query("s21_usage_shapes", OPLOG_SQL + """
SELECT d * 10 + 5 AS seq, CASE WHEN d % 4 = 2 THEN greatest(0, d % 50 + 701 - d % 700) ELSE d % 50 + 1 END AS input,
  d % 9 AS output, d % 700 AS cache_read, CASE WHEN d % 4 = 2 THEN 0 ELSE d % 30 END AS cache_create FROM o""")
def s21(spark, sf):
    return N.oplog(oplog_lines(spark, sf), TOPOLOGY, chunk="block").select(
        "seq", "input", "output", "cache_read", "cache_create")


@query("s22_tombstones", """
WITH ops AS (SELECT 'session-' || (user_id % 60) AS session_id, event_id, event_id % 5 = 0 AS gone,
  CASE WHEN event_id % 5 <> 0 THEN '/w/' || event_id END AS work_dir FROM events WHERE event_id % 5 <> 1)
SELECT session_id, first(work_dir ORDER BY event_id DESC) AS work_dir FROM ops
GROUP BY 1 HAVING NOT first(gone ORDER BY event_id DESC)""")
def s22(spark, sf):
    i = F.col("event_id")
    rec = F.struct(F.concat(F.lit("session-"), F.col("user_id") % 60).alias("sessionId"),
                   F.when(i % 5 == 0, True).alias("deleted"),
                   F.when(i % 5 > 1, F.concat(F.lit("/w/"), i)).alias("workDir"))
    return N.session_index(as_lines(events(spark, sf), rec, F.lit("/h/session_index.jsonl")))


@query("s23_path_ids", OPLOG_SQL + """
SELECT d * 10 + 5 AS seq, 'session-' || f AS session, f % 3 = 2 AS sidechain,
  CASE WHEN f % 3 = 2 THEN 'helper' END AS agent,
  CASE WHEN f % 4 = 0 THEN 'dir' || f WHEN f % 7 < 2 THEN 'Named ' || (f % 7) ELSE 'proj' || (f % 7) END AS workspace
FROM o""")
def s23(spark, sf):
    """Workspace: the session index first, then the named workspaces, then the folder key."""
    lines = oplog_lines(spark, sf)
    files = lines.select("file").distinct()
    f = F.regexp_extract("file", "session-([0-9]+)", 1).cast("int")
    index = files.filter(f % 4 == 0).select(
        F.concat(F.lit("session-"), f).alias("session_id"),
        F.concat(F.lit("/x/dir"), f, F.lit("/")).alias("work_dir"))
    named = files.filter(f % 7 < 2).select(
        F.concat(F.lit("wd_proj"), f % 7, F.lit("_0123456789ab")).alias("wd_key"),
        F.concat(F.lit("Named "), f % 7).alias("name")).distinct()
    return N.oplog(lines, TOPOLOGY, index, named, chunk="block").select(
        "seq", "session", "sidechain", "agent", "workspace")


@query("s24_files", f"""
WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id % {FILES} ORDER BY conv_id * 1000 + turn) AS INTEGER) AS n
  FROM conversations WHERE role = 'assistant')
SELECT n AS turn, CASE WHEN turn % 4 = 3 THEN 77 ELSE 1500 END AS input,
  CASE WHEN turn % 4 = 3 THEN 33 ELSE greatest(10, length(text) // 4) END AS output, count(*) AS logs FROM a GROUP BY ALL""")
def s24_files(spark, sf):
    return from_disk(spark, planner_lines(spark, sf), N.planner).groupBy("turn", "input", "output") \
        .agg(F.count("*").alias("logs"))


@query("s24_resumed", f"""
WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id % {FILES} ORDER BY conv_id * 1000 + turn) AS INTEGER) AS n
  FROM conversations WHERE role = 'assistant')
SELECT DISTINCT n AS turn, CASE WHEN turn % 4 = 3 THEN 77 ELSE 1500 END AS input,
  CASE WHEN turn % 4 = 3 THEN 33 ELSE greatest(10, length(text) // 4) END AS output FROM a""")
def s24_resumed(spark, sf):
    """Logs of one folder have no session here, so turns with the same number and counts are one."""
    return read_in_pieces(spark, planner_lines(spark, sf), N.PLANNER, 3)[0].select("turn", "input", "output").distinct()


@query("s24_planner_log", f"""
WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id % {FILES} ORDER BY conv_id * 1000 + turn) AS INTEGER) AS n
  FROM conversations WHERE role = 'assistant')
SELECT conv_id * 1000 + turn AS seq, n AS turn, 'brain-' || (conv_id % {FILES}) AS session,
  CASE WHEN turn % 4 = 1 THEN 'mid-a' ELSE 'gemini-3.6-flash' END AS model, 'high' AS effort,
  CASE WHEN turn % 4 = 3 THEN 77 ELSE 1500 END AS input,
  CASE WHEN turn % 4 = 3 THEN 33 ELSE greatest(10, length(text) // 4) END AS output,
  ['view_file'] AS tools, 'shop' AS repo, 'a.ts' AS workspace FROM a""")
def s24(spark, sf):
    """Whole message texts are measured; a turn with counts keeps them."""
    return N.planner(planner_lines(spark, sf), TOPOLOGY, chunk="block").select(
        "seq", "turn", "session", "model", "effort", "input", "output", "tools", "repo",
        "workspace")


def planner_lines(spark, sf):
    c = table(spark, sf, "conversations")
    rec = F.struct(
        F.lit("MODEL").alias("source"), F.when(F.col("role") == "assistant", "PLANNER_RESPONSE")
        .otherwise("USER_INPUT").alias("type"), F.col("text").alias("content"),
        F.when(F.col("turn") % 4 == 1, "mid-a-20240101").alias("model"),
        F.when(F.col("turn") % 4 == 3, F.struct(F.lit(77).alias("prompt_tokens"),
                                                F.lit(33).alias("output_tokens"))).alias("usage"),
        F.array(F.struct(F.lit("view_file").alias("name"), F.struct(
            F.lit("/home/dev/code/shop/src/ui/a.ts").alias("AbsolutePath")).alias("args")))
        .alias("tool_calls"))
    return c.select(F.concat(F.lit("/g/brain/brain-"), F.col("conv_id") % FILES,
                              F.lit("/.system_generated/logs/transcript.jsonl")).alias("file"),
                     F.floor(F.col("conv_id") / 20).alias("block"),
                     (F.col("conv_id") * 1000 + F.col("turn")).alias("line"),
                    F.to_json(rec).alias("value"))


def _store_turns(spark, sf):
    from meterline.schema import conform
    return conform(turns(spark, sf).drop("person"))


@query("s25_sync_sources", """
SELECT 'broken' AS provider, false AS ok, 0 AS read, 0 AS written
UNION ALL SELECT 'chat', true, count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0),
  count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0) FROM events
UNION ALL SELECT 'turns', true, count(*), count(*) FROM events""")
def s25(spark, sf):
    """A failing source is reported and the others still land."""
    def broken(_):
        raise ValueError("unreadable")
    path = scratch_path(spark, "store")
    done = S.sync(spark, [S.Source("chat", lambda s: chat_turns(s, sf)), S.Source("broken", broken),
                          S.Source("turns", lambda s: _store_turns(s, sf))], path)
    return done.select("provider", "ok", "read", "written")


@query("s27_month_partitions", """
SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m') END AS month,
  count(*) AS n FROM orders GROUP BY 1""")
def s27(spark, sf):
    from meterline.schema import conform
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 50 != 0, F.date_format(
            "o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts_raw"),
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("session"))
    path = scratch_path(spark, "store")
    S.append(conform(o), path)
    return S.scan(spark, path).groupBy("month").agg(F.count("*").alias("n"))


@query("s28_pruned_scan", """
SELECT CAST(o_custkey AS VARCHAR) AS session, o_orderkey AS seq FROM orders
WHERE strftime(o_orderdate, '%Y-%m') IN ('1997-03', '1997-04')""")
def s28(spark, sf):
    """Only the wanted month folders are read."""
    from meterline.schema import conform
    o = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_raw"),
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("session"))
    path = scratch_path(spark, "store")
    S.append(conform(o), path)
    return S.scan(spark, path).filter(F.col("month").isin("1997-03", "1997-04")) \
        .select("session", "seq")


@query("s29_reconcile", with_turns(
    "SELECT seq, session, ts_raw FROM turns WHERE seq % 4 <> 0"))
def s29(spark, sf):
    """A full re-read of a damaged log over a store that holds every fourth turn."""
    stored = turns(spark, sf).filter("seq % 4 = 0")
    return S.reconcile(_doubled(spark, sf), stored).select("seq", "session", "ts_raw")


@query("s30_dedupe", with_turns("SELECT seq, session, ts_raw, surfaces FROM turns"))
def s30(spark, sf):
    """Later copies have lower line numbers and other surfaces; the first copy must win."""
    t = _doubled(spark, sf).withColumn("ingest", F.lit(1))
    late = turns(spark, sf).withColumns({"seq": F.col("seq") - 10**9, "ingest": F.lit(2),
                                         "surfaces": F.array(F.lit("late"))})
    return S.first_copies(t.unionByName(late)).select("seq", "session", "ts_raw", "surfaces")


@query("s30_dedupe_counts", with_turns("""
SELECT count(*) AS kept, CAST(sum(CASE WHEN seq % 9 = 0 THEN 2 WHEN seq % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS removed
FROM turns"""))
def s30_counts(spark, sf):
    return S.dedupe_counts(_doubled(spark, sf))


@query("s31_purge_samples", with_turns("""
SELECT seq % 13 = 0 OR (seq % 6 = 0 AND seq % 2 = 0) AS sample, count(*) AS n FROM turns GROUP BY 1"""))
def s31(spark, sf):
    i = F.col("seq")
    t = turns(spark, sf).withColumn("synthetic", i % 13 == 0) \
        .withColumn("workspace", F.when(i % 2 == 0, "growth-web").otherwise(F.col("workspace"))) \
        .withColumn("session", F.when(i % 6 == 0, F.concat(F.lit("d"), F.lpad(
            F.lower(F.hex(i % 1048576)), 5, "0"))).otherwise(F.col("session")))
    kept = S.without_samples(t).select(F.lit(False).alias("sample"))
    gone = t.filter(S.is_sample()).select(F.lit(True).alias("sample"))
    return kept.unionByName(gone).groupBy("sample").agg(F.count("*").alias("n"))


@query("s32_event_key", with_turns("""
SELECT seq, concat_ws('|', provider, session, ts_raw, CASE WHEN turn <> 0 THEN CAST(turn AS VARCHAR) ELSE '' END, CAST(input AS VARCHAR),
  CAST(output AS VARCHAR), CASE WHEN cache_read <> 0 THEN CAST(cache_read AS VARCHAR) ELSE '' END, model) AS event_key
FROM turns"""))
def s32(spark, sf):
    return turns(spark, sf).select("seq", event_key().alias("event_key"))


@query("s33_sync_summary", with_turns("""
SELECT 'turns' AS provider, 'first' AS run, count(*) AS read, count(*) AS written, 0 AS skipped,
  strftime(min(ts), '%Y-%m') AS first_month, strftime(max(ts), '%Y-%m') AS last_month FROM turns
UNION ALL SELECT 'turns', 'again', count(*), 0, count(*), NULL, NULL FROM turns"""))
def s33(spark, sf):
    """A second full run writes nothing and says so."""
    path = scratch_path(spark, "store")
    source = [S.Source("turns", lambda s: _store_turns(s, sf))]
    cols = ("provider", "run", "read", "written", "skipped", "first_month", "last_month")
    one = S.sync(spark, source, path).withColumn("run", F.lit("first")).select(*cols)
    two = S.sync(spark, source, path).withColumn("run", F.lit("again")).select(*cols)
    return one.unionByName(two)


@query("s34_digest_sink", with_turns("""
SELECT 'by_tool' AS report, tool AS label, count(*) AS n FROM (SELECT unnest(tools) AS tool FROM turns) GROUP BY 2
UNION ALL SELECT 'by_provider', provider, count(*) FROM turns GROUP BY 2"""))
def s34(spark, sf):
    """Every report is written to its own folder; two are read back."""
    from verification.tables import digest
    path = scratch_path(spark, "digest")
    digest(spark, sf).stored().write(path)
    tool = spark.read.parquet(f"{path}/by_tool").select(
        F.lit("by_tool").alias("report"), F.col("tool").alias("label"), F.col("calls").alias("n"))
    prov = spark.read.parquet(f"{path}/by_provider").select(
        F.lit("by_provider").alias("report"), F.col("provider").alias("label"),
        F.col("turns").alias("n"))
    return tool.unionByName(prov)
