"""Attribution: path -> (repo, surface), lanes, and session gap-fill.

The topology is compiled into column expressions when the plan is built; no
path is looked at by Python code at run time and no path survives the parse.
"""

from __future__ import annotations

import json
import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators.scan import CHUNK_ROWS, Scan, by_chunks, hold, running

# Tool names that change something, and tool names that only look.
WRITE_TOOLS = ("Edit", "Write", "NotebookEdit", "MultiEdit", "apply_patch", "create_file",
               "edit_file", "str_replace_editor", "replace_file_content",
               "multi_replace_file_content", "write_to_file", "generate_image")
READ_TOOLS = ("Read", "Grep", "Glob", "NotebookRead", "read_file", "search", "grep", "list_dir",
              "view_file", "read_url_content", "search_web", "manage_task", "manage_subagents",
              "invoke_subagent", "run_command")

# Labels of throw-away work and of files at the top of a repo.
SCRATCH_REPO = "scratchpad"
SCRATCH_SURFACE = "scratch files"
ROOT_SURFACE = "(root)"


def _null() -> Column:
    return F.lit(None).cast("string")


def let(value: Column, body) -> Column:
    """Name a sub-expression so that using it many times does not copy it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Topology:
    """Workspace layout compiled to column expressions."""

    def __init__(self, config: dict, home: str | None = None):
        def expand(root: str) -> str:
            if home is not None and root.startswith("~"):
                root = home + root[1:]
            return os.path.expanduser(root).rstrip("/")

        longest = lambda item: -len(item[0])
        self.roots = [r for r, _ in sorted(((expand(r), None) for r in config["code_roots"]),
                                           key=longest)]
        self.special = sorted(((expand(r), n) for r, n in
                               (config.get("special_roots") or {}).items()), key=longest)
        self.scratch = list(config.get("scratch_prefixes") or [])
        self.marker = config.get("worktree_marker") or ".worktrees"
        self.incidental = list(config.get("incidental_repos") or [])
        self.rules = config.get("surface_rules") or {}
        self.lanes = config.get("lanes") or {}

    @classmethod
    def from_json(cls, path: str, home: str | None = None) -> Topology:
        """A user's own layout; only ``code_roots`` is needed, the README shows every key."""
        with open(path, encoding="utf-8") as handle:
            return cls(json.load(handle), home)

    # -- path -> repo, rel ---------------------------------------------------

    def split(self, path: Column) -> Column:
        """Absolute path -> struct(repo, rel); both null outside every known root."""
        mark = f"/{self.marker}/"
        outside = _pair(_null(), _null())

        def resolve(clean: Column) -> Column:
            # Below a worktree marker the part before it names the repository.
            nested = F.contains(clean, F.lit(mark))
            head = F.when(nested, F.substring_index(clean, mark, 1)).otherwise(clean)
            return let(F.struct(clean.alias("clean"), head.alias("head"), nested.alias("nested")),
                       lambda v: let(F.struct(v.alias("v"), self._plain(v["head"]).alias("own")),
                                     combine))

        def combine(w: Column) -> Column:
            clean, head, own = w["v"]["clean"], w["v"]["head"], w["own"]
            tail = F.substr(clean, F.length(head) + len(mark) + 1)
            inside = F.when(F.contains(tail, F.lit("/")),
                            F.substr(tail, F.instr(tail, "/") + 1)).otherwise("")
            owner = F.coalesce(own["repo"], F.nullif(basename(head), F.lit("")))
            return (F.when(self._scratch(clean), _pair(F.lit(SCRATCH_REPO), _null()))
                    .when(w["v"]["nested"], _pair(owner, inside)).otherwise(own))

        return F.when(F.startswith(path, F.lit("/")), let(normalise_path(path), resolve)) \
            .otherwise(outside)

    def _scratch(self, clean: Column) -> Column:
        hits = [F.startswith(clean, F.lit(p)) for p in self.scratch]
        return reduce(lambda a, b: a | b, hits, F.lit(False))

    def _plain(self, clean: Column) -> Column:
        out = F.when(self._scratch(clean), _pair(F.lit(SCRATCH_REPO), _null()))
        for root, name in self.special:
            rel = F.regexp_replace(F.substr(clean, F.lit(len(root) + 1)), "^/+", "")
            under = (clean == root) | F.startswith(clean, F.lit(root + "/"))
            out = out.when(under, _pair(F.lit(name), rel))
        for root in self.roots:
            rest = F.substr(clean, F.lit(len(root) + 2))
            first = F.substring_index(rest, "/", 1)
            rel = F.when(F.contains(rest, F.lit("/")),
                         F.substr(rest, F.instr(rest, "/") + 1)).otherwise("")
            loose = ~F.contains(rest, F.lit("/")) & F.contains(rest, F.lit("."))
            repo = F.nullif(first, F.lit(""))
            out = out.when(F.startswith(clean, F.lit(root + "/")),
                           F.when(loose, _pair(_null(), _null())).otherwise(_pair(repo, rel)))
        return out.otherwise(_pair(_null(), _null()))

    # -- repo, rel -> surface ------------------------------------------------

    def surface(self, repo: Column, rel: Column) -> Column:
        """Repo-relative path -> coarse area; only a folder can become a label."""
        bound = F.struct(repo.alias("repo"), rel.alias("rel"), F.split(rel, "/").alias("parts"))
        return let(bound, lambda v: self._surface(v["repo"], v["rel"], v["parts"]))

    def _surface(self, repo: Column, rel: Column, parts: Column) -> Column:
        fallback = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(ROOT_SURFACE)
        shared = F.coalesce(*[_rule(p, label, rel, parts) for p, label in
                              self.rules.get("*", [])], fallback)
        own = None
        for name, rules in self.rules.items():
            if name != "*" and rules:
                label = F.coalesce(*[_rule(p, text, rel, parts) for p, text in rules])
                own = F.when(repo == name, label) if own is None else own.when(repo == name, label)
        chosen = shared if own is None else F.coalesce(own, shared)
        return (F.when(repo.isNull(), _null())
                .when(repo == SCRATCH_REPO, SCRATCH_SURFACE)
                .when(F.coalesce(rel, F.lit("")) == "", ROOT_SURFACE)
                .otherwise(chosen))

    def classify(self, path: Column) -> Column:
        """Absolute path -> struct(repo, surface)."""
        return let(self.split(path), lambda v: F.struct(
            v["repo"].alias("repo"), self.surface(v["repo"], v["rel"]).alias("surface")))

    # -- turns ---------------------------------------------------------------

    def is_incidental(self, repo: Column) -> Column:
        if not self.incidental:
            return F.lit(False)
        return F.coalesce(repo.isin(self.incidental), F.lit(False))

    def pick_repo(self, cwd_repo: Column, touched_repos: Column) -> Column:
        """Where the turn ran, else what it touched first; incidental repos last."""
        ranked = F.filter(F.concat(F.array(cwd_repo), touched_repos), lambda r: r.isNotNull())
        real = F.filter(ranked, lambda r: ~self.is_incidental(r))
        return F.coalesce(F.get(real, F.lit(0)), F.get(ranked, F.lit(0)))

    def lane(self, repo: Column, entrypoint: Column, provider: Column) -> Column:
        """First rule whose stated conditions all hold, else the default lane."""
        have = {"repo": repo, "entrypoint": entrypoint, "provider": provider}
        chain = None
        for rule in self.lanes.get("rules", []):
            stated = {k: v for k, v in rule.items() if k != "lane"}
            if not stated:
                continue
            tests = [have[k].eqNullSafe(v) if k in have else F.lit(v is None)
                     for k, v in stated.items()]
            hit = reduce(lambda a, b: a & b, tests)
            lane = F.lit(rule["lane"])
            chain = F.when(hit, lane) if chain is None else chain.when(hit, lane)
        default = F.lit(self.lanes.get("default", "work"))
        return default if chain is None else chain.otherwise(default)

    def attribute(self, df: DataFrame, cwd: Column, touched_paths: Column) -> DataFrame:
        """Add ``repo`` and ``surfaces`` from the working folder and touched paths."""
        touched = F.array_distinct(F.filter(F.transform(touched_paths, self.classify),
                                            lambda t: t["repo"].isNotNull()))
        framed = df.withColumn("_touched", touched)
        repo = self.pick_repo(self.split(cwd)["repo"],
                              F.transform(F.col("_touched"), lambda t: t["repo"]))
        framed = framed.withColumn("repo", repo)
        return framed.withColumn("surfaces", surfaces_of(F.col("_touched"), F.col("repo"))) \
            .drop("_touched")


def surfaces_of(touched: Column, repo: Column) -> Column:
    """Sorted distinct areas of the chosen repo."""
    mine = F.filter(touched, lambda t: (t["repo"] == repo) & (F.coalesce(
        t["surface"], F.lit("")) != ""))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(mine, lambda t: t["surface"]))),
                      F.array().cast("array<string>"))


def _pair(repo: Column, rel: Column) -> Column:
    return F.struct(repo.cast("string").alias("repo"), rel.cast("string").alias("rel"))


def normalise_path(path: Column) -> Column:
    """Collapse '//', '/./' and 'x/../' and drop the trailing slash.

    Segments are folded left to right, a '..' removing the segment before it.
    """
    folded = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(
            F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    # Exactly two leading slashes are a root of their own on POSIX.
    lead = F.when(path.rlike("^//([^/]|$)"), "//").otherwise("/")
    return F.when(path.rlike(r"//|/\.{1,2}(/|$)|.+/$"),
                  F.concat(lead, F.array_join(folded, "/"))).otherwise(path)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def workspace(cwd: Column) -> Column:
    return F.nullif(basename(F.coalesce(cwd, F.lit(""))), F.lit(""))


def session_id(session: Column) -> Column:
    """The id as it is written; a blank one is none."""
    return F.nullif(session, F.lit(""))


def short_session(session: Column) -> Column:
    """The first eight characters, for display only: different sessions may share them."""
    return F.nullif(F.left(session, F.lit(8)), F.lit(""))


def segment_match(pattern: str, rel: Column) -> Column:
    """Segment glob: '*' is exactly one segment and the pattern is a prefix."""
    body = "/".join("[^/]*" if s == "*" else re.escape(s) for s in pattern.split("/"))
    return rel.rlike(f"^{body}(/|$)")


def fill_label(label: str, parts: Column) -> Column:
    """Replace ``{n}`` by segment n; null when n is the last segment (a file name).

    A number past the end of the path has no segment and stays as written.
    """
    pieces = re.split(r"(\{\d+\})", label)
    out, last = [], F.size(parts) - 1
    refused = F.lit(False)
    for piece in pieces:
        if re.fullmatch(r"\{\d+\}", piece):
            n = int(piece[1:-1])
            refused = refused | (last == n)
            out.append(F.coalesce(F.get(parts, F.lit(n)), F.lit(piece)))
        elif piece:
            out.append(F.lit(piece))
    text = F.concat(*out) if out else F.lit("")
    return F.when(~refused, F.nullif(text, F.lit("")))


def _rule(pattern: str, label: str, rel: Column, parts: Column) -> Column:
    return F.when(segment_match(pattern, rel), fill_label(label, parts))


def tool_class(name: Column) -> Column:
    return F.when(name.isin(*WRITE_TOOLS), "write").when(name.isin(*READ_TOOLS), "read") \
        .otherwise("other")


def tool_counts(tools: Column) -> dict[str, Column]:
    """Per-turn counts of write, read and all tool calls."""
    safe = F.coalesce(tools, F.array().cast("array<string>"))
    return {
        "writes": F.size(F.filter(safe, lambda t: t.isin(*WRITE_TOOLS))),
        "reads": F.size(F.filter(safe, lambda t: t.isin(*READ_TOOLS))),
        "tool_calls": F.size(safe),
    }


def gap_fill(turns: DataFrame, topology: Topology, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Give every turn one repo and one surface from its session.

    An unattributed turn takes the nearest attributed repo, backwards in time
    first, real repos before incidental ones. A missing surface comes from the
    nearest turn in the same unbroken run of one repo. Adds ``surface`` and
    ``inferred``. Turns without a session form one session, so it is the usual
    hot key; ``by_chunks`` cuts it.
    """
    order = ["_o_ts", "seq"]
    # Turns with no stamp sort before all others, as the empty string does.
    framed = turns.select(
        "*", F.coalesce("session", F.lit("")).alias("_o_sid"),
        F.coalesce(F.unix_micros("ts"), F.lit(-(2**62))).alias("_o_ts"))
    if "surface" not in turns.columns:
        framed = framed.withColumn("surface", _null())
    filled = by_chunks(framed, ["_o_sid"], order,
                       lambda df, chunk: _fill(df, topology, order, chunk), chunk_rows)
    return filled.drop("_o_sid", "_o_ts")


def _fill(df: DataFrame, topology: Topology, order: list[str], chunk: str | None) -> DataFrame:
    keys = ["_o_sid"]
    here = F.nullif(F.col("repo"), F.lit(""))
    real = F.when(~topology.is_incidental(here), here)
    df = running(df, keys, order, [
        Scan("_p_real", "last", real), Scan("_n_real", "next", real),
        Scan("_p_any", "last", here), Scan("_n_any", "next", here)], chunk)
    df = df.withColumn("_repo", F.coalesce(here, "_p_real", "_n_real", "_p_any", "_n_any"))
    is_real = F.col("_repo").isNotNull() & ~topology.is_incidental(F.col("_repo"))
    df = hold(df.withColumn("_real", is_real), chunk)
    # A run of a real repo is not broken by incidental turns in between.
    repo_or_blank = F.coalesce("_repo", F.lit(""))
    df = running(df, keys, order, [
        Scan("_prev_real", "last_before", F.when(F.col("_real"), F.col("_repo"))),
        Scan("_prev", "last_before", repo_or_blank)], chunk)
    df = hold(df, chunk)
    df = running(df, keys, order, [
        Scan("_run_real", "total", F.when(F.col("_real") & ~F.col("_repo").eqNullSafe(
            F.col("_prev_real")), 1).otherwise(0)),
        Scan("_run_any", "total", F.when(~repo_or_blank.eqNullSafe(F.col("_prev")), 1)
             .otherwise(0))], chunk)
    df = hold(df, chunk)
    own = F.get("surfaces", F.lit(0))
    seen = lambda run, keep: F.when(own.isNotNull() & keep, F.struct(
        own.alias("own"), F.col(run).alias("run")))
    df = running(df, keys, order, [
        Scan("_p_r", "last", seen("_run_real", F.col("_real"))),
        Scan("_n_r", "next", seen("_run_real", F.col("_real"))),
        Scan("_p_a", "last", seen("_run_any", ~F.col("_real"))),
        Scan("_n_a", "next", seen("_run_any", ~F.col("_real")))], chunk)
    same = lambda held, run: F.when(F.col(held)["run"] == F.col(run), F.col(held)["own"])
    near = F.when(F.col("_real"), F.coalesce(same("_p_r", "_run_real"), same("_n_r", "_run_real"))) \
        .otherwise(F.coalesce(same("_p_a", "_run_any"), same("_n_a", "_run_any")))
    preset = F.nullif(F.col("surface"), F.lit(""))
    near = F.when(F.col("_repo").isNotNull(), near)
    filled_repo = here.isNull() & F.col("_repo").isNotNull()
    filled_surface = own.isNull() & preset.isNull() & near.isNotNull()
    df = (df.withColumn("inferred", filled_repo | filled_surface)
          .withColumn("surface", F.coalesce(own, preset, near))
          .withColumn("repo", F.col("_repo")))
    return df.drop("_p_real", "_n_real", "_p_any", "_n_any", "_repo", "_real", "_prev_real",
                   "_prev", "_run_real", "_run_any", "_p_r", "_n_r", "_p_a", "_n_a")
