"""Attribution over paths and turns mapped from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.functions.clock import local_time
from meterline.operators import attribution as A
from verification.registry import query
from verification.tables import TOPOLOGY, table, turns, with_filled, with_turns

# shape -> (path, repo, rel, surface); ``$`` is the number of the user.
SHAPES = [
    ("/home/dev/code/r$/src/api/x.py", "r$", "src/api/x.py", "src/api"),
    ("/home/dev/code/r$/src/x.py", "r$", "src/x.py", "src"),
    ("/home/dev/code/clients/w$/docs/a.md", "w$", "docs/a.md", "docs"),
    ("/home/dev/code/clients", "clients", "", "(root)"),
    ("/home/dev/code/readme$.md", None, None, None),
    ("/tmp/x/$", "scratchpad", None, "scratch files"),
    ("/home/dev/.config/nvim$/init.lua", "dotfiles", "nvim$/init.lua", "nvim$"),
    ("/home/dev/code/shop/.worktrees/f$/packages/core$/lib/a.ts", "shop",
     "packages/core$/lib/a.ts", "package:core$"),
    ("/srv/other/$", None, None, None),
    ("code/r$/src", None, None, None),
    ("/home/dev/code/shop/special/z$/deep/f.txt", "shop", "special/z$/deep/f.txt", "deep z$"),
    ("/home/dev/code//shop/special/./a/../b$/g.txt", "shop", "special/b$/g.txt", "special"),
    ("/srv/thing$/.worktrees/w1/tests/t.py", "thing$", "tests/t.py", "tests"),
    ("/home/dev/code/r$", "r$", "", "(root)"),
    ("/var/folders/a/.worktrees/q/src/b/c", "scratchpad", None, "scratch files"),
]


def _shaped(i):
    n = F.col("person")
    arms = [F.concat(*[x for j, piece in enumerate(s[i].split("$")) for x in
                       ([n] if j else []) + [F.lit(piece)]]) if s[i] is not None
            else F.lit(None).cast("string") for s in SHAPES]
    return F.get(F.array(*arms), (F.col("seq") % len(SHAPES)).cast("int"))


def _sql_shaped(i):
    arms = " ".join(f"WHEN {k} THEN " + " || person || ".join(f"'{p}'" for p in s[i].split("$"))
                    for k, s in enumerate(SHAPES) if s[i] is not None)
    return f"CASE seq % {len(SHAPES)} {arms} END"


def paths(spark, sf):
    return turns(spark, sf).select("seq", "person", _shaped(0).alias("path"))


@query("a01_split_path", with_turns(f"SELECT {_sql_shaped(0)} AS path, {_sql_shaped(1)} AS repo, "
                                    f"{_sql_shaped(2)} AS rel, count(*) AS n FROM turns GROUP BY ALL"))
def a01(spark, sf):
    found = paths(spark, sf).select("path", TOPOLOGY.split(F.col("path")).alias("s"))
    return found.groupBy("path", F.col("s.repo").alias("repo"), F.col("s.rel").alias("rel")) \
        .agg(F.count("*").alias("n"))


@query("a02_surface", with_turns(f"SELECT {_sql_shaped(1)} AS repo, {_sql_shaped(3)} AS surface, "
                                 "count(*) AS n FROM turns GROUP BY ALL"))
def a02(spark, sf):
    known = turns(spark, sf).select(_shaped(1).alias("repo"), _shaped(2).alias("rel"))
    return known.groupBy("repo", TOPOLOGY.surface(F.col("repo"), F.col("rel")).alias("surface")) \
        .agg(F.count("*").alias("n"))


@query("a03_segment_glob", """
SELECT count(*) AS n, count(*) FILTER (split_part(url, '/', 4) = 'fr') AS fr_pages,
  count(*) FILTER (len(string_split(url, '/')) > 4 AND split_part(url, '/', 3) LIKE '%.example.com'
    AND split_part(url, '/', 3) NOT LIKE '%/%') AS deep FROM pages""")
def a03(spark, sf):
    p = table(spark, sf, "pages")
    # Segments of http://host/lang/page are '', host, lang, page below the scheme.
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return p.agg(F.count("*").alias("n"),
                 F.count_if(A.segment_match("*/fr", rel)).alias("fr_pages"),
                 F.count_if(A.segment_match("*/*/*", rel) & rel.rlike(r"^[^/]*\.example\.com/"))
                 .alias("deep"))


@query("a04_label_fill", with_turns("""
SELECT person, seq % 3 AS depth, CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN 'area:p' || person
  ELSE 'area:p' || person END AS label, count(*) AS n FROM turns GROUP BY ALL"""))
def a04(spark, sf):
    """The last segment is a file name and never becomes a label."""
    parts = F.split(F.concat(F.lit("apps/p"), F.col("person"), F.when(F.col("seq") % 3 == 1, "/x")
                             .when(F.col("seq") % 3 == 2, "/x/y").otherwise("")), "/")
    return turns(spark, sf).groupBy("person", (F.col("seq") % 3).alias("depth"),
                                    A.fill_label("area:{1}", parts).alias("label")) \
        .agg(F.count("*").alias("n"))


@query("a05_classify", with_turns(f"SELECT {_sql_shaped(0)} AS path, {_sql_shaped(1)} AS repo, "
                                  f"{_sql_shaped(3)} AS surface, count(*) AS n FROM turns GROUP BY ALL"))
def a05(spark, sf):
    found = paths(spark, sf).select("path", TOPOLOGY.classify(F.col("path")).alias("s"))
    return found.groupBy("path", "s.repo", "s.surface").agg(F.count("*").alias("n"))


def _touching(spark, sf):
    """Turns with a working folder and three touched paths."""
    n = F.col("person")
    cwd = F.when(F.col("seq") % 4 == 0, "/tmp/job").when(
        F.col("seq") % 4 == 1, F.concat(F.lit("/home/dev/code/c"), n)).otherwise("/srv")
    path = lambda s: F.concat(*[x for j, p in enumerate(s.split("$"))
                                for x in ([n] if j else []) + [F.lit(p)]])
    touched = F.when(F.col("seq") % 3 == 0, F.array(
        path("/tmp/note$"), path("/home/dev/code/t$/src/b/f.py"),
        path("/home/dev/code/t$/docs/f.md"), path("/home/dev/code/t$/src/b/g.py"))) \
        .when(F.col("seq") % 3 == 1, F.array(path("/home/dev/code/c$/tests/a/t.py"),
                                             path("/home/dev/.config/x/y"))) \
        .otherwise(F.array(path("/tmp/only$")))
    t = turns(spark, sf).drop("repo", "surfaces", "lane")
    return TOPOLOGY.attribute(t, cwd, touched)


TOUCH_SQL = """picked AS (SELECT seq, person, entrypoint, provider,
  CASE WHEN seq % 4 = 1 THEN 'c' || person
    WHEN seq % 3 = 0 THEN 't' || person WHEN seq % 3 = 1 THEN 'c' || person
    ELSE 'scratchpad' END AS repo FROM turns)"""


@query("a06_pick_repo", with_turns(f", {TOUCH_SQL} SELECT repo, count(*) AS n FROM picked GROUP BY 1"))
def a06(spark, sf):
    return _touching(spark, sf).groupBy("repo").agg(F.count("*").alias("n"))


@query("a07_surfaces", with_turns(f""", {TOUCH_SQL}
SELECT seq, repo, CASE WHEN repo = 't' || person THEN ['docs', 'src/b']
  WHEN seq % 3 = 1 AND repo = 'c' || person THEN ['tests']
  WHEN repo = 'scratchpad' THEN ['scratch files'] ELSE CAST([] AS VARCHAR[]) END AS surfaces
FROM picked"""))
def a07(spark, sf):
    return _touching(spark, sf).select("seq", "repo", "surfaces")


@query("a08_lane", with_turns("""
SELECT repo, entrypoint, provider, lane, count(*) AS n FROM turns GROUP BY ALL"""))
def a08(spark, sf):
    t = turns(spark, sf).drop("lane")
    lane = TOPOLOGY.lane(F.col("repo"), F.col("entrypoint"), F.col("provider"))
    return t.groupBy("repo", "entrypoint", "provider", lane.alias("lane")) \
        .agg(F.count("*").alias("n"))


@query("a09_gap_fill_repo", with_filled("SELECT seq, session, repo FROM filled"))
def a09(spark, sf):
    return A.gap_fill(turns(spark, sf), TOPOLOGY).select("seq", "session", "repo")


@query("a10_gap_fill_surface", with_filled("SELECT seq, repo, surface, inferred FROM filled"))
def a10(spark, sf):
    return A.gap_fill(turns(spark, sf), TOPOLOGY).select("seq", "repo", "surface", "inferred")


@query("a10_gap_fill_one_session", with_filled("SELECT seq, repo, surface, inferred FROM filled")
       .replace("PARTITION BY session ", "PARTITION BY provider ")
       .replace("PARTITION BY session, run", "PARTITION BY provider, run"))
def a10_hot(spark, sf):
    """A few sessions hold everything: every session is cut into chunks."""
    t = turns(spark, sf).withColumn("session", F.col("provider"))
    return A.gap_fill(t, TOPOLOGY, chunk_rows=500).select("seq", "repo", "surface", "inferred")


@query("a11_local_time", """
WITH y AS (SELECT o_orderkey, o_orderdate AS ts, make_date(year(o_orderdate), 4, 1) AS a,
  make_date(year(o_orderdate), 10, 31) AS o FROM orders),
z AS (SELECT *, CAST(a + CAST((7 - isodow(a)) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 7 HOUR AS dst_on,
  CAST(o - CAST(isodow(o) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 6 HOUR AS dst_off FROM y)
SELECT o_orderkey, ts + INTERVAL 330 MINUTE AS fixed,
  CASE WHEN ts >= dst_on AND ts < dst_off THEN ts - INTERVAL 4 HOUR ELSE ts - INTERVAL 5 HOUR END AS zoned
FROM z""")
def a11(spark, sf):
    """A fixed offset, and a zone that observes daylight saving."""
    o = table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", local_time(F.col("ts"), 5.5).alias("fixed"),
                    local_time(F.col("ts"), "America/New_York").alias("zoned"))


@query("a13_workspace", with_turns("""
SELECT CASE seq % 4 WHEN 0 THEN 'w' || person WHEN 1 THEN 'w' || person END AS workspace,
  count(*) AS n FROM turns GROUP BY 1"""))
def a13(spark, sf):
    cwd = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("/home/x/w"), F.col("person"))) \
        .when(F.col("seq") % 4 == 1, F.concat(F.lit("/home/x/w"), F.col("person"), F.lit("//"))) \
        .when(F.col("seq") % 4 == 2, "/")
    return turns(spark, sf).groupBy(A.workspace(cwd).alias("workspace")).agg(F.count("*").alias("n"))


@query("a14_session_id", with_turns("SELECT session, count(*) AS n FROM turns GROUP BY 1"))
def a14_id(spark, sf):
    """Whole ids are kept: no two sessions merge."""
    return turns(spark, sf).groupBy(A.session_id(F.col("session")).alias("session")) \
        .agg(F.count("*").alias("n"))


@query("a14_short_session", with_turns(
    "SELECT left(session, 8) AS session, count(*) AS n FROM turns GROUP BY 1"))
def a14(spark, sf):
    return turns(spark, sf).groupBy(A.short_session(F.col("session")).alias("session")) \
        .agg(F.count("*").alias("n"))


@query("a15_tool_class", with_turns("""
SELECT CASE WHEN tool = 'Edit' THEN 'write' WHEN tool IN ('Read', 'Grep') THEN 'read'
  ELSE 'other' END AS kind, count(*) AS calls FROM (SELECT unnest(tools) AS tool FROM turns)
GROUP BY 1"""))
def a15(spark, sf):
    calls = turns(spark, sf).select(F.explode("tools").alias("tool"))
    return calls.groupBy(A.tool_class(F.col("tool")).alias("kind")).agg(F.count("*").alias("calls"))
