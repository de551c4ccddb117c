import random

import pytest
from pyspark.sql import functions as F

from meterline.operators.attribution import Topology, gap_fill
from meterline.operators.scan import Scan, running

TOPO = Topology({
    "code_roots": ["~/code"], "scratch_prefixes": ["/tmp/"],
    "special_roots": {"~/.claude": "claude-config", "~/.config": "dotfiles"},
    "incidental_repos": ["scratchpad", "claude-config", "dotfiles"],
    "surface_rules": {"claude-config": [["projects/*/memory/*", "agent memory"]],
                      "*": [["src/*", "src/{1}"], ["packages/*", "package:{1}"], ["docs/*", "docs"]]}, "lanes": {
    "default": "work", "rules": [{"repo": "toy", "lane": "personal"}]}}, home="/home/dev")


@pytest.mark.parametrize("path,repo,surface", [
    ("/home/dev/code/shop/src/api/h.ts", "shop", "src/api"),
    ("/home/dev/code/shop/src/h.ts", "shop", "src"),
    ("/home/dev/code/shop/README.md", "shop", "(root)"),
    ("/home/dev/code/notes.txt", None, None),
    ("/home/dev/code/shop/.worktrees/fix/packages/ui/lib/a.ts", "shop", "package:ui"),
    ("/tmp/x/y.py", "scratchpad", "scratch files"),
    ("/home/dev/.claude/projects/p/memory/m.md", "claude-config", "agent memory"),
    ("/home/dev/.config", "dotfiles", "(root)"),
    ("/etc/hosts", None, None), ("code/shop", None, None), (None, None, None),
    ("/home/dev/code/../code/shop/docs/a/", "shop", "docs"),
])
def test_paths(spark, path, repo, surface):
    df = spark.createDataFrame([(path,)], "p string").select(TOPO.classify(F.col("p")).alias("c"))
    row = df.select("c.repo", "c.surface").first()
    assert (row[0], row[1]) == (repo, surface)


def brute(rows, incidental):
    """Nearest-neighbour definition over one ordered session, by direct search."""
    n = len(rows)
    real = [r is not None and r not in incidental for r, _ in rows]

    def nearest(ok):
        out = []
        for i in range(n):
            back = [j for j in range(i, -1, -1) if ok(j)]
            ahead = [j for j in range(i, n) if ok(j)]
            out.append(rows[back[0]][0] if back else rows[ahead[0]][0] if ahead else None)
        return out

    by_real, by_any = nearest(lambda j: real[j]), nearest(lambda j: rows[j][0] is not None)
    repo = [rows[i][0] or by_real[i] or by_any[i] for i in range(n)]
    solid = [r is not None and r not in incidental for r in repo]

    def same_run(i, j):
        lo, hi = min(i, j), max(i, j)
        between = [k for k in range(lo, hi + 1) if solid[k] or not solid[i]]
        return repo[i] is not None and solid[i] == solid[j] and all(
            repo[k] == repo[i] for k in between)

    surface = []
    for i in range(n):
        if rows[i][1]:
            surface.append(rows[i][1])
            continue
        back = [j for j in range(i - 1, -1, -1) if rows[j][1] and same_run(i, j)]
        ahead = [j for j in range(i + 1, n) if rows[j][1] and same_run(i, j)]
        surface.append(rows[back[0]][1] if back else rows[ahead[0]][1] if ahead else None)
    return list(zip(repo, surface))


@pytest.mark.parametrize("chunk_rows", [10**9, 6])
def test_gap_fill_matches_direct_search(spark, chunk_rows):
    rng = random.Random(7)
    data, want = [], {}
    for s in range(60):
        rows = []
        for _ in range(rng.randint(1, 14)):
            repo = rng.choice([None, None, "a", "b", "scratchpad"])
            rows.append((repo, rng.choice([None, "x", "y"]) if repo else None))
        for i, ((repo, own), done) in enumerate(zip(rows, brute(rows, {"scratchpad"}))):
            # The last session has no id: the rows without one form one session.
            sid = None if s == 59 else f"s{s:02d}"
            data.append((sid, s * 100 + i, repo, [own] if own else []))
            want[s * 100 + i] = (*done, repo is None and done[0] is not None
                                 or not own and done[1] is not None)
    df = spark.createDataFrame(
        data, "session string, seq long, repo string, surfaces array<string>").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    filled = gap_fill(df.repartition(5), TOPO, chunk_rows)
    got = {r["seq"]: (r["repo"], r["surface"], r["inferred"]) for r in filled.collect()}
    assert got == want


def test_chunked_scan_equals_plain_window(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"),
        F.floor(F.col("id") / 40).alias("chunk"))
    scans = [Scan("a", "last", F.col("v")), Scan("b", "last_before", F.col("v")),
             Scan("c", "next", F.col("v")), Scan("d", "total", F.lit(1))]
    plain = running(df, ["k"], ["id"], scans).orderBy("id").collect()
    cut = running(df, ["k"], ["id"], scans, "chunk").select(*df.columns, *"abcd") \
        .orderBy("id").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in cut]


def test_layout_from_json(tmp_path):
    (tmp_path / "layout.json").write_text('{"code_roots": ["~/work"], "incidental_repos": ["notes"]}')
    own = Topology.from_json(str(tmp_path / "layout.json"), home="/home/dev")
    assert own.roots == ["/home/dev/work"] and own.incidental == ["notes"] and own.rules == {}
