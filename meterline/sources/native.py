"""Log shapes a spec cannot describe: four hand-built readers over ordered lines.

Every running value (ordinals, deltas, carried settings) goes through
``scan.running`` on (file; block, line), so a file that holds a third of all
lines is cut at its blocks and still gives exact results.

A reader has two halves: ``*_read`` parses lines into a few fields, ``*_turns`` makes turns of
them and returns, beside the turns, what a later read of the same files must know. That is
rows of the parsed shape again - one per file with the settings and totals in force and the
number of turns so far (``base``), one per tool call that waits for its turn - which go before
the next read's rows (``sources.resume``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.cluster import lookup_join, write_and_read
from meterline.functions.models import drop_snapshot_date, strip_gateway
from meterline.operators.attribution import Topology, basename, session_id
from meterline.operators.scan import Scan, hold, running
from meterline.sources import logs as L
from meterline.sources.spec import finish

# Entry points as a person would name them, per log shape.
TRANSCRIPT_ENTRY = {"claude-desktop": "desktop", "cli": "cli", "sdk-cli": "sdk",
                    "vscode": "ide", "jetbrains": "ide"}
ROLLOUT_ENTRY = {"exec": "cli", "vscode": "ide", "cli": "cli", "app": "desktop"}

# Tool arguments that hold a path, per log shape.
TRANSCRIPT_PATHS = ("file_path", "notebook_path", "path")
ROLLOUT_PATHS = ("path", "file_path", "workdir", "cwd", "notebook_path")
OPLOG_PATHS = ("file_path", "path", "notebook_path", "cwd", "workdir")
PLANNER_PATHS = ("Cwd", "DirectoryPath", "SearchPath", "AbsolutePath", "TargetFile", "path",
                 "file_path", "workspace")

# Short model names of the op log, and the planner log's defaults.
OPLOG_MODELS = {"k3": "kimi-k3", "kimi-for-coding": "kimi-k2.7-code",
                "kimi-for-coding-highspeed": "kimi-k2.7-code-highspeed"}
OPLOG_MODEL_PREFIX = "kimi-code/"
PLANNER_MODEL = "gemini-3.6-flash"
PLANNER_EFFORT = "high"
PLANNER_INPUT = 1500
PLANNER_MIN_OUTPUT = 10

# Counters of the rollout log's running total.
ROLLOUT_COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens",
                    "reasoning_output_tokens")

FILE, PLACE = ["file"], ["block", "line"]


def _mapped(raw: Column, names: dict, otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, raw), otherwise)


def _places(lines: DataFrame) -> list[str]:
    """Where a line stands and, in a partial read, whether its file is read from the start."""
    return [*FILE, *PLACE, *(c for c in ("fresh",) if c in lines.columns)]


def _base(parsed: DataFrame) -> Column:
    """Turns before this read, on the row that carries them; null on every row of the log."""
    return F.col("base") if "base" in parsed.columns else F.lit(None).cast("bigint")


def _names(blocks: Column, at: str = "name") -> Column:
    return F.filter(F.transform(blocks, lambda b: L.truthy(L.dig(b, at))), lambda n: n.isNotNull())


# -- assistant transcripts ------------------------------------------------------

def transcript(lines: DataFrame, topology: Topology, provider: str = "claude-code",
               chunk: str | None = None) -> DataFrame:
    """Assistant records with exact usage.

    The ordinal counts every assistant record; those without usage are dropped
    afterwards.
    """
    return transcript_turns(transcript_read(lines), topology, provider, chunk)[0]


def transcript_turns(parsed: DataFrame, topology: Topology, provider: str = "claude-code",
                     chunk: str | None = None) -> tuple[DataFrame, DataFrame]:
    base = _base(parsed)
    recs = running(parsed, FILE, PLACE, [Scan("turn", "total", F.coalesce(base, F.lit(1)))], chunk)
    turns = recs.filter(F.col("counted") & base.isNull()).withColumn("provider", F.lit(provider))
    return finish(turns, topology), _ordinals(recs)


def _ordinals(recs: DataFrame) -> DataFrame:
    return recs.groupBy(*FILE).agg(F.max("turn").cast("bigint").alias("base"))


def transcript_read(lines: DataFrame) -> DataFrame:
    recs = L.records(lines).filter(L.dig("rec", "type") == "assistant")
    usage = L.dig("rec", "message.usage", "map<string,variant>")
    d = lambda p, kind="string": L.dig("rec", p, kind)
    n = lambda p: L.counter("rec", f"message.usage.{p}")
    blocks = F.filter(L.items("rec", "message.content"), lambda b: L.equals(
        b, {"type": "tool_use"}))
    entry = d("entrypoint")
    return recs.select(
        *_places(lines), F.coalesce(F.size(usage) > 0, F.lit(False)).alias("counted"),
        d("timestamp").alias("ts_raw"), session_id(d("sessionId")).alias("session"),
        F.coalesce(d("cwd"), F.lit("")).alias("_cwd"), L.truthy(d("gitBranch")).alias("branch"),
        _mapped(entry, TRANSCRIPT_ENTRY, entry).alias("entrypoint"),
        drop_snapshot_date(d("message.model")).alias("model"), d("effort").alias("effort"),
        d("message.usage.service_tier").alias("tier"), d("message.usage.speed").alias("speed"),
        F.coalesce(d("isSidechain", "boolean"), F.lit(False)).alias("sidechain"),
        d("slug").alias("agent"), d("message.stop_reason").alias("stop"),
        n("input_tokens").alias("input"), n("output_tokens").alias("output"),
        n("cache_creation_input_tokens").alias("cache_create"),
        n("cache_read_input_tokens").alias("cache_read"),
        n("cache_creation.ephemeral_1h_input_tokens").alias("cache_1h"),
        n("cache_creation.ephemeral_5m_input_tokens").alias("cache_5m"),
        n("server_tool_use.web_search_requests").alias("web_search"),
        n("server_tool_use.web_fetch_requests").alias("web_fetch"),
        _names(blocks).alias("tools"),
        L.path_args(blocks, "input", TRANSCRIPT_PATHS).alias("_paths"))


# -- rollouts: running totals ---------------------------------------------------

def subagent(source: Column) -> Column:
    """Name of a delegated thread, from a tag that is JSON (text or object)."""
    sub = F.try_variant_get(F.when(F.startswith(source, F.lit("{")), F.try_parse_json(source)),
                            "$.subagent", "variant")
    named = F.try_variant_get(sub, "$", "map<string,string>")
    values = F.filter(F.map_values(named), lambda v: v.isNotNull() & ~v.isin("", "false", "0"))
    plain = F.try_variant_get(sub, "$", "string")
    return F.when(named.isNotNull(), F.coalesce(F.get(values, F.lit(0)), F.lit("unnamed"))) \
        .otherwise(F.nullif(plain, F.lit("")))


def rollout(lines: DataFrame, topology: Topology, provider: str = "codex",
            chunk: str | None = None) -> DataFrame:
    """Turns as differences of a running total, with carried session settings.

    A repeated total is no turn. Tool calls belong to the next emitted turn.
    """
    # Parsed once into a few fields; turns and calls are both read from there.
    return rollout_turns(write_and_read(rollout_read(lines), "rollout"), topology, provider, chunk)[0]


def rollout_read(lines: DataFrame) -> DataFrame:
    kind, inner = F.col("kind"), F.col("inner")
    # Most lines are messages: they are dropped before any field is looked up.
    recs = L.records(lines).select("*", L.dig("rec", "type").alias("kind"),
                                   L.dig("rec", "payload.type").alias("inner"))
    setting = F.coalesce(kind.isin("session_meta", "turn_context"), F.lit(False))
    is_call = ~setting & F.coalesce(inner.isin("function_call", "custom_tool_call",
                                               "local_shell_call", "web_search_call"), F.lit(False))
    is_total = ~setting & F.coalesce(inner == "token_count", F.lit(False))
    recs = recs.filter(setting | is_call | is_total)
    p = lambda path: L.dig("rec", f"payload.{path}")
    places = _places(lines)
    fields = recs.select(
        *places, "kind", "inner", L.dig("rec", "timestamp").alias("ts_raw"),
        *[F.when(setting, p(c)).alias(c) for c in ("id", "cwd", "source", "model", "effort",
                                                   "reasoning_effort")],
        *[F.when(is_call, p(c)).alias(c) for c in ("name", "arguments")],
        F.when(is_total, L.dig("rec", "payload.info.total_token_usage", "map<string,variant>"))
        .alias("usage"))
    count = lambda c: F.coalesce(F.try_variant_get(
        F.try_element_at("usage", F.lit(c)), "$", "bigint"), F.lit(0))
    search = inner == "web_search_call"
    paths = F.filter(F.array(*[F.get_json_object("arguments", f"$.{k}") for k in ROLLOUT_PATHS]),
                     lambda x: x.isNotNull() & F.startswith(x, F.lit("/")))
    read = fields.select(
        *places, "ts_raw",
        F.when(kind == "session_meta", F.struct("id", "cwd", "source")).alias("meta"),
        F.when(kind == "turn_context", F.struct("model", F.coalesce(
            L.truthy(F.col("effort")), "reasoning_effort").alias("effort"), "cwd")).alias("ctx"),
        F.when(is_total & (F.size("usage") > 0), F.struct(
            *[count(c).alias(c) for c in ROLLOUT_COUNTERS])).alias("totals"),
        F.when(is_call, F.struct(
            F.when(search, "WebSearch").otherwise(L.truthy(F.col("name"))).alias("name"),
            F.when(search, F.array().cast("array<string>")).otherwise(paths).alias("paths")))
        .alias("call"))
    useful = F.coalesce(F.col("meta").isNotNull() | F.col("ctx").isNotNull()
                        | F.col("totals").isNotNull() | F.col("call").isNotNull(), F.lit(False))
    return read.filter(useful)


def rollout_turns(parsed: DataFrame, topology: Topology, provider: str = "codex",
                  chunk: str | None = None) -> tuple[DataFrame, DataFrame]:
    base = _base(parsed)
    state = running(parsed, FILE, PLACE, [
        Scan("m", "last", F.col("meta")), Scan("c", "last", F.col("ctx")),
        Scan("prev", "last_before", F.col("totals"))], chunk)
    used = {c: F.greatest(F.lit(0), F.col(f"totals.{c}") - F.coalesce(f"prev.{c}", F.lit(0)))
            for c in ROLLOUT_COUNTERS}
    worked = F.lit(False)
    for col in used.values():
        worked = worked | (col > 0)
    state = hold(state.withColumn("emits", F.coalesce(worked, F.lit(False)) & base.isNull()), chunk)
    state = running(state, FILE, PLACE, [
        Scan("turn", "total", F.coalesce(base, F.col("emits").cast("int")))], chunk)
    last = state.groupBy(*FILE).agg(F.max_by(
        F.struct(F.col("m").alias("meta"), F.col("c").alias("ctx"), F.coalesce("totals", "prev").alias("totals"),
                 F.col("turn").cast("bigint").alias("base")), F.struct(*PLACE)).alias("end"))
    waiting = state.filter("call is not null").join(
        last.select(F.col("file").alias("l_file"), F.col("end.base").alias("l_turn")),
        (F.col("file") == F.col("l_file")) & (F.col("turn") == F.col("l_turn")), "left_semi")
    left = last.select("file", "end.*").unionByName(waiting.select("file", "line", "call"), allowMissingColumns=True)
    turns = state.filter("emits")
    keys = turns.select(F.col("file").alias("k_file"), F.col("turn").alias("k_turn"))
    calls = state.filter("call is not null").select(
        "file", (F.col("turn") + 1).alias("turn"), "block", "line", "call")
    # Calls after the last turn belong to none and are dropped before collecting.
    calls = calls.join(keys, (calls["file"] == keys["k_file"]) & (calls["turn"] == keys["k_turn"]),
                       "left_semi")
    listed = calls.groupBy(F.col("file").alias("c_file"), F.col("turn").alias("c_turn")).agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "call"))).alias("calls"))
    joined = turns.join(listed, (turns["file"] == listed["c_file"])
                        & (turns["turn"] == listed["c_turn"]), "left")
    empty = F.array().cast("array<string>")
    source = F.col("m.source")
    framed = joined.select(
        "file", "line", F.lit(provider).alias("provider"), "ts_raw",
        session_id(F.col("m.id")).alias("session"),
        F.coalesce(L.truthy(F.col("c.cwd")), F.col("m.cwd"), F.lit("")).alias("_cwd"),
        strip_gateway(F.col("c.model")).alias("model"), F.col("c.effort").alias("effort"),
        _mapped(source, ROLLOUT_ENTRY, F.lit(None).cast("string")).alias("entrypoint"),
        subagent(source).alias("agent"), subagent(source).isNotNull().alias("sidechain"), "turn",
        F.greatest(F.lit(0), used["input_tokens"] - used["cached_input_tokens"]).alias("input"),
        used["cached_input_tokens"].alias("cache_read"), used["output_tokens"].alias("output"),
        F.coalesce(F.filter(F.transform("calls", lambda x: x["call"]["name"]),
                            lambda x: x.isNotNull()), empty).alias("tools"),
        F.coalesce(F.flatten(F.transform("calls", lambda x: x["call"]["paths"])), empty)
        .alias("_paths"))
    return finish(framed, topology), left


# -- op logs: event-sourced steps -----------------------------------------------

def oplog_model(alias: Column) -> Column:
    name = F.regexp_replace(L.truthy(alias), f"^{OPLOG_MODEL_PREFIX}", "")
    return _mapped(name, OPLOG_MODELS, name)


def step_tokens(usage: Column) -> Column:
    """Three shapes of usage -> struct(input, output, cache_read, cache_create)."""
    has = lambda k: F.try_variant_get(usage, f"$.{k}", "variant").isNotNull()
    n = lambda k: L.counter(usage, k)
    shape = lambda i, o, r, c: F.struct(
        i.alias("input"), o.alias("output"), r.alias("cache_read"), c.alias("cache_create"))
    details = F.when(has("prompt_tokens_details"), n("prompt_tokens_details.cached_tokens")) \
        .otherwise(n("input_tokens_details.cached_tokens"))
    return (F.when(has("inputOther") | has("inputCacheRead"), shape(
                n("inputOther"), n("output"), n("inputCacheRead"), n("inputCacheCreation")))
            .when(has("input_tokens") | has("output_tokens"), shape(
                n("input_tokens"), n("output_tokens"), n("cache_read_input_tokens"),
                n("cache_creation_input_tokens")))
            .otherwise(shape(F.greatest(F.lit(0), n("prompt_tokens") - details),
                             n("completion_tokens"), details, F.lit(0).cast("long"))))


def session_index(lines: DataFrame) -> DataFrame:
    """Append-only index with tombstones -> current (session_id, work_dir)."""
    recs = L.records(lines).select(
        "file", "block", "line", L.truthy(L.dig("rec", "sessionId")).alias("session_id"),
        L.truthy(L.dig("rec", "workDir")).alias("work_dir"),
        F.coalesce(L.dig("rec", "deleted", "boolean"), F.lit(False)).alias("gone"))
    ops = recs.filter(F.col("session_id").isNotNull()
                      & (F.col("gone") | F.col("work_dir").isNotNull()))
    last = ops.groupBy("session_id").agg(F.max_by(
        F.struct("gone", "work_dir"), F.struct("file", "block", "line")).alias("op"))
    return last.filter(~F.col("op.gone")).select("session_id", F.col("op.work_dir")
                                                 .alias("work_dir"))


def workspace_names(docs: DataFrame) -> DataFrame:
    """``workspaces.json`` -> (wd_key, name)."""
    entries = L.records(docs).select(F.explode(
        L.dig("rec", "workspaces", "map<string,variant>")).alias("wd_key", "meta"))
    root = basename(F.coalesce(L.dig("meta", "root"), F.lit("")))
    return entries.select("wd_key", F.coalesce(L.truthy(L.dig("meta", "name")), L.truthy(root))
                          .alias("name")).filter(F.col("name").isNotNull())


def oplog_ids(file: Column) -> Column:
    """Path -> struct(wd_key, session_id, agent); the agent defaults to ``main``."""
    parts = F.split(file, "/")
    i = F.array_position(parts, "sessions").cast("int")
    part = lambda k: F.get(parts, i - 1 + k)
    known = (i > 0) & (i + 1 < F.size(parts))
    agent = F.when(i + 3 < F.size(parts) - 1, part(4)).otherwise(F.lit("main"))
    none = F.lit(None).cast("string")
    return F.struct(F.when(known, part(1)).otherwise(none).alias("wd_key"),
                    F.when(known, part(2)).otherwise(none).alias("session_id"),
                    F.when(known, agent).otherwise(F.lit("main")).alias("agent"))


def oplog(lines: DataFrame, topology: Topology, index: DataFrame | None = None,
          workspaces: DataFrame | None = None, provider: str = "kimi-code",
          chunk: str | None = None) -> DataFrame:
    """One turn per finished step; model, folder and effort come from earlier updates.

    A call joins the first end of its step that follows it. Calls that name no
    step stay without a turn.
    """
    # Parsed once into a few fields; ends, calls and turns are all read from there.
    return oplog_turns(write_and_read(oplog_read(lines), "oplog"), topology, index, workspaces, provider, chunk)[0]


def oplog_read(lines: DataFrame) -> DataFrame:
    kind, event = F.col("kind"), F.col("event")
    # Most operations are messages: they are dropped before any field is looked up.
    recs = L.records(lines).select("*", L.dig("rec", "type").alias("kind"),
                                   L.dig("rec", "event.type").alias("event"))
    update = F.coalesce(kind == "config.update", F.lit(False))
    loop = F.coalesce(kind == "context.append_loop_event", F.lit(False))
    ended = loop & F.coalesce(event == "step.end", F.lit(False))
    is_call = loop & F.coalesce(event == "tool.call", F.lit(False))
    recs = recs.filter(update | ended | is_call)
    d = lambda p, t="string": L.dig("rec", p, t)
    places = _places(lines)
    fields = recs.select(
        *places, ended.alias("ended"), is_call.alias("is_call"),
        *[F.when(update, d(c)).alias(c) for c in ("modelAlias", "cwd", "thinkingEffort")],
        F.when(ended, d("event.uuid")).when(is_call, d("event.stepUuid")).alias("step"),
        F.when(ended, d("event.usage", "variant")).alias("usage"), d("time", "double").alias("ms"),
        F.when(ended, d("event.finishReason")).alias("stop"),
        F.when(is_call, d("event.name")).alias("name"),
        F.when(is_call, d("event.args")).alias("args"))
    # Arguments are an object or its JSON text; both read as text here.
    paths = F.filter(F.array(*[F.get_json_object("args", f"$.{k}") for k in OPLOG_PATHS]),
                     lambda x: x.isNotNull() & F.startswith(x, F.lit("/")))
    counted = F.col("ended") & F.coalesce(F.size(F.try_variant_get(
        "usage", "$", "map<string,variant>")) > 0, F.lit(False))
    read = fields.select(
        *places, "ended", "is_call", "step", "ms", "stop",
        oplog_model(F.col("modelAlias")).alias("u_model"), L.truthy(F.col("cwd")).alias("u_cwd"),
        L.truthy(F.col("thinkingEffort")).alias("u_effort"), counted.alias("counted"),
        F.when(counted, step_tokens(F.col("usage"))).alias("tokens"),
        L.truthy(F.col("name")).alias("name"),
        F.when(F.col("is_call"), paths).alias("paths"))
    return read.filter(F.coalesce("u_model", "u_cwd", "u_effort").isNotNull()
                       | F.col("ended") | F.col("is_call"))


def oplog_turns(parsed: DataFrame, topology: Topology, index: DataFrame | None = None,
                workspaces: DataFrame | None = None, provider: str = "kimi-code",
                chunk: str | None = None) -> tuple[DataFrame, DataFrame]:
    state = running(parsed, FILE, PLACE, [
        Scan("model", "last", F.col("u_model")), Scan("cwd", "last", F.col("u_cwd")),
        Scan("set_effort", "last", F.col("u_effort")),
        Scan("turn", "total", F.coalesce(_base(parsed), F.col("counted").cast("int"), F.lit(0)))], chunk)
    steps = parsed.filter("(ended or is_call) and step is not null").select(
        *FILE, *PLACE, "step", "ended", "is_call", "name", "paths")
    calls = running(steps, [*FILE, "step"], PLACE, [
        Scan("e_at", "next", F.when(F.col("ended"), F.struct(*PLACE)))], chunk).filter("is_call")
    listed = calls.filter("e_at is not null").groupBy(
        F.col("file").alias("c_file"), F.col("step").alias("c_step"), F.col("e_at").alias("c_at")).agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "name", "paths"))).alias("calls"))
    last = state.groupBy(*FILE).agg(F.max_by(
        F.struct(F.col("model").alias("u_model"), F.col("cwd").alias("u_cwd"), F.col("set_effort").alias("u_effort"),
                 F.col("turn").cast("bigint").alias("base")), F.struct(*PLACE)).alias("end"))
    waiting = calls.filter("e_at is null").select("file", "line", "step", "is_call", "name", "paths")
    left = last.select("file", "end.*").unionByName(waiting, allowMissingColumns=True)
    turns = state.filter("counted")
    joined = turns.join(listed, (turns["file"] == listed["c_file"])
                        & (turns["step"] == listed["c_step"])
                        & (F.struct("block", "line") == F.col("c_at")), "left")
    ids = oplog_ids(F.col("file"))
    joined = joined.withColumn("ids", ids)
    wd_name = F.nullif(F.regexp_extract("ids.wd_key", "^wd_(.+)_[0-9a-f]{8,}$", 1), F.lit(""))
    if workspaces is not None:
        named = workspaces.select(F.col("wd_key").alias("w_key"), F.col("name").alias("w_name"))
        joined = lookup_join(joined, named, F.col("ids.wd_key") == F.col("w_key"),
                             spread=F.xxhash64("file", "line"))
        wd_name = F.coalesce("w_name", wd_name)
    if index is not None:
        joined = lookup_join(joined, index.withColumnRenamed("session_id", "i_session"),
                             F.col("ids.session_id") == F.col("i_session"),
                             spread=F.xxhash64("file", "line"))
        wd_name = F.when(F.col("work_dir").isNotNull(), L.truthy(basename(F.col("work_dir")))) \
            .otherwise(wd_name)
    sub = F.col("ids.agent") != "main"
    empty = F.array().cast("array<string>")
    stamp = F.date_format(F.timestamp_millis(F.floor(F.col("ms")).cast("long")),
                          "yyyy-MM-dd'T'HH:mm:ss'Z'")
    framed = joined.select(
        "file", "line", F.lit(provider).alias("provider"),
        F.when(F.col("ms") > 0, stamp).alias("ts_raw"),
        session_id(F.col("ids.session_id")).alias("session"), wd_name.alias("workspace"),
        F.coalesce("cwd", F.lit("")).alias("_cwd"), "model",
        F.nullif(F.col("set_effort"), F.lit("off")).alias("effort"), "turn",
        F.lit("cli").alias("entrypoint"), "stop", sub.alias("sidechain"),
        F.when(sub, F.col("ids.agent")).alias("agent"),
        *[F.col(f"tokens.{c}").alias(c) for c in ("input", "output", "cache_read",
                                                  "cache_create")],
        F.coalesce(F.filter(F.transform("calls", lambda x: x["name"]), lambda x: x.isNotNull()),
                   empty).alias("tools"),
        F.coalesce(F.flatten(F.transform("calls", lambda x: x["paths"])), empty).alias("_paths"))
    return finish(framed, topology), left


# -- planner logs ---------------------------------------------------------------

def planner(lines: DataFrame, topology: Topology, provider: str = "antigravity",
            chunk: str | None = None) -> DataFrame:
    """Planner responses; a turn without token counts is estimated from its text length."""
    return planner_turns(planner_read(lines), topology, provider, chunk)[0]


def planner_turns(parsed: DataFrame, topology: Topology, provider: str = "antigravity",
                  chunk: str | None = None) -> tuple[DataFrame, DataFrame]:
    base = _base(parsed)
    recs = running(parsed, FILE, PLACE, [Scan("turn", "total", F.coalesce(base, F.lit(1)))], chunk)
    return finish(recs.filter(base.isNull()).withColumn("provider", F.lit(provider)), topology), _ordinals(recs)


def planner_read(lines: DataFrame) -> DataFrame:
    recs = L.records(lines).filter((L.dig("rec", "source") == "MODEL")
                                   & (L.dig("rec", "type") == "PLANNER_RESPONSE"))
    d = lambda p, t="string": L.dig("rec", p, t)
    either = lambda *ps: F.coalesce(*[L.truthy(d(p)) for p in ps])
    box = F.when(F.size(d("usage", "map<string,variant>")) > 0, d("usage", "variant")) \
        .otherwise(d("tokens", "variant"))
    two = lambda a, b: F.when(L.counter(box, a) != 0, L.counter(box, a)) \
        .otherwise(L.counter(box, b))
    inp, out = two("input_tokens", "prompt_tokens"), two("output_tokens", "completion_tokens")
    silent = (inp == 0) & (out == 0)
    chars = F.length(F.coalesce(d("content"), F.lit(""))) \
        + F.length(F.coalesce(d("thinking"), F.lit("")))
    guess = F.greatest(F.lit(PLANNER_MIN_OUTPUT), F.floor(chars / 4)).cast("long")
    blocks = L.items("rec", "tool_calls")
    parts = F.split("file", "/")
    at = F.array_position(parts, "brain").cast("int")
    sid = F.when((at > 0) & (at < F.size(parts)), F.get(parts, at))
    paths = L.path_args(blocks, "args", PLANNER_PATHS)
    return recs.select(
        *_places(lines), either("created_at", "timestamp").alias("ts_raw"),
        session_id(F.coalesce(L.truthy(sid), d("sessionId"))).alias("session"),
        F.coalesce(F.get(paths, F.lit(0)), F.lit("")).alias("_cwd"), F.lit("ide")
        .alias("entrypoint"),
        drop_snapshot_date(F.coalesce(either("model", "model_name"), F.lit(PLANNER_MODEL)))
        .alias("model"),
        F.coalesce(either("effort"), F.lit(PLANNER_EFFORT)).alias("effort"),
        (F.coalesce(d("is_subagent", "boolean"), F.lit(False))
         | F.coalesce(d("sidechain", "boolean"), F.lit(False))).alias("sidechain"),
        either("subagent", "agent_role").alias("agent"),
        F.when(silent, F.lit(PLANNER_INPUT)).otherwise(inp).alias("input"),
        F.when(silent, guess).otherwise(out).alias("output"),
        L.counter(box, "cache_creation_input_tokens").alias("cache_create"),
        L.counter(box, "cache_read_input_tokens").alias("cache_read"),
        _names(blocks).alias("tools"), paths.alias("_paths"))


@dataclass(frozen=True)
class Shape:
    """A reader's two halves: lines to parsed rows, parsed rows to turns and what is carried on."""

    read: Callable[[DataFrame], DataFrame]
    turns: Callable[..., tuple[DataFrame, DataFrame]]


TRANSCRIPT, ROLLOUT = Shape(transcript_read, transcript_turns), Shape(rollout_read, rollout_turns)
OPLOG, PLANNER = Shape(oplog_read, oplog_turns), Shape(planner_read, planner_turns)
