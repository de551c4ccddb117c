"""Hard negatives, packing and conversation repair against plain Python forms."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from helpers import odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterline.llm import conversations, hard_negatives, packing
from meterline.llm.queries import QUERIES
from meterline.llm.selection_queries import damaged

INF, NAN = float("inf"), float("nan")


# -- hard negatives ---------------------------------------------------------------

def plain_mine(rows, positives=5, negatives=3, window=(50, 95)):
    live = [(i, v, lab, [math.floor(256 * x) for x in vec]) for i, (v, lab, vec) in enumerate(rows)
            if lab is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    last = 1 << 62
    out = []
    for i, v, lab, vec in live:
        if v is None or v % 50:
            continue
        scored = sorted(((-max(-2**55, min(2**55, sum(a * b for a, b in zip(vec, w)))), last if u is None else u, m)
                         for j, u, m, w in live if j != i))
        for s, u, m in [x for x in scored if x[2] == lab][:positives]:
            good = [x for x in scored if x[2] != lab and window[0] * -s <= 100 * -x[0] <= window[1] * -s]
            out += [(v, None if u == last else u, r + 1, None if x[1] == last else x[1], -s, -x[0])
                    for r, x in enumerate(good[:negatives])]
    return sorted(out, key=repr)


def vectors(spark, rows):
    full = [(v, lab, vec, v, "x") for v, lab, vec in rows]
    return spark.createDataFrame(full, "vec_id bigint, label int, embedding array<double>, rid bigint, score string")


def mined(spark, rows, **more):
    out = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0, **more)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_hard_negatives_match_brute_force(spark):
    rng = random.Random(4)
    center = {c: [rng.gauss(0, 0.2) for _ in range(8)] for c in range(3)}
    rows = [(10 * i, i % 3 if i % 7 else (i + 1) % 3, [x + rng.gauss(0, 0.12) for x in center[i % 3]]) for i in range(160)]
    rows += [(50, 1, rows[5][2]), (50, 1, rows[5][2]), (77, 2, rows[5][2]), (None, 0, rows[5][2]), (None, 2, rows[3][2])]
    rows += [(3000, None, [1.0]), (3050, 1, None), (3100, 1, [None, 1.0]), (3150, 1, [NAN]), (3200, 1, [INF, 0.0])]
    rows += [(3250, 1, []), (3300, 1, [0.5]), (-50, 2, [-x for x in rows[2][2]])]
    want = plain_mine(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_hard_negatives_ties_and_large_components(spark):
    same = [(i, i % 2, [1.0, 1.0]) for i in range(0, 120, 5)]
    near = [(200 + i, 1 - i % 2, [0.7, 0.7]) for i in range(9)]
    large = [(1000, 5, [3e6, 2e6]), (1001, 5, [3e6, 1.0]), (1002, 6, [2e6, 3.0]), (1003, 6, [1e30, 1.0])]
    rows = same + near + large
    assert mined(spark, rows) == plain_mine(rows)


def test_hard_negatives_blocks_and_empty(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.randrange(4), [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    want = plain_mine(rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "BATCH", 17)
    assert mined(spark, rows) == want
    assert mined(spark, []) == []
    monkeypatch.undo()
    assert hard_negatives.blocks_of(20, 1000, 12) == (1, 12)
    a, r = hard_negatives.blocks_of(2_000_000, 100_000_000, 12)
    assert a * 8192 >= 2_000_000 and 2_000_000 / a * (100_000_000 / r) <= 1 << 33


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(-4, 4), st.integers(0, 9)), max_size=12), max_size=5),
       st.integers(1, 4))
def test_tops_keep_the_best_of_each_group(batches, k):
    tops = hard_negatives.Tops(4, k)
    for b in batches:
        tops.offer(*(np.array([x[i] for x in b], np.int64) for i in range(3)))
    rows = [x for b in batches for x in b]
    for g in range(4):
        want = sorted((-s, v) for h, s, v in rows if h == g)[:k]
        got = [(-s, v) for s, v in zip(tops.score[g].tolist(), tops.vec[g].tolist()) if s > hard_negatives.NOTHING]
        assert got == want


# -- packing ----------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_places_every_piece_once(lengths, capacity):
    counts = Counter(lengths)
    made, got = packing.plan(counts, capacity), Counter()
    for times, content in made:
        assert times > 0 and sum(n * c for n, c in content.items()) <= capacity
        for n, c in content.items():
            got[n] += times * c
    assert got == counts
    gaps = []
    for n in sorted(lengths, reverse=True):  # best fit, piece by piece
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    assert sum(t for t, _ in made) <= len(gaps)


def test_plan_finds_exact_complements():
    for counts, sequences in (({6: 4, 4: 4}, 4), ({5: 3, 3: 3, 2: 3}, 3), ({4: 1, 3: 1, 2: 1, 1: 1}, 1),
                              ({10: 10**15, 7: 10**12, 3: 10**12}, 10**15 + 10**12), ({}, 0), ({1: 7}, 1)):
        assert sum(t for t, _ in packing.plan(counts, 10)) == sequences


def ids_of(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer
    return [*Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_round_trip_and_odd_rows(spark):
    rng = random.Random(2)
    texts = [(20 + i, "x1 " * rng.randint(0, 900)) for i in range(40)]
    texts += [(80, "it's a<|endoftext|>b  \n\x85　don't"), (81, "a" * 70_000), (82, "é " * 70_000)]
    docs, rows = odd_docs(spark, texts)
    packed = packing.pack(docs)
    got = packed.collect()
    pieces = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 1024 and r["offset"] + r["length"] <= 1024
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], ids))
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(ids_of(t))
    for d, texts_of_d in want.items():
        whole = Counter()
        for ids in texts_of_d:
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids) + 1, 1024)]
            whole.update((p, a, tuple(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
        assert Counter((p, s, tuple(i)) for p, s, i in pieces[d]) == whole
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for s, parts in by_sequence.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 1024) + 1
    built = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert built == {s: b"".join(bytes(p[2]) for p in sorted(parts)) for s, parts in by_sequence.items()}
    assert packing.pack(docs.limit(0)).count() == 0


def test_op12_checksums(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op12_best_fit_packing"](spark, "/root/testdata/sf0.001").limit(60).collect():
        ids = np.array(ids_of(docs[r["doc_id"]])[r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())


# -- conversations ----------------------------------------------------------------

def plain_repair(turns):
    """Least (cost, audit) over all edits: a search that spells every audit out."""
    start, wanted = (0, ""), {0: "u", 1: "u", 3: "u", 2: "a"}
    shift = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserts(level):
        for _ in range(3):
            for t, (c, a) in list(level.items()):
                to = shift[t, wanted[t]]
                level[to] = min(level.get(to, (c + 3, "")), (c + 2, a + "I"))
        return level
    level = {0: start}
    for initial, fault in turns:
        after = {}
        for t, (c, a) in inserts(level).items():
            options = [(t, c + 3, a + "D")]
            if fault in ("-", "t"):
                stays = c + (fault == "t")
                options.append((shift[t, wanted[t]], stays + 2, a + "R"))
                if (t, initial) in shift:
                    options.append((shift[t, initial], stays, a + "K"))
            for to, cost, audit in options:
                after[to] = min(after.get(to, (cost, audit)), (cost, audit))
        level = after
    level = inserts(level) if turns else level
    return min(v for t, v in level.items() if t in (0, 3))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaux"), st.sampled_from("--t-db")), max_size=14), st.lists(st.integers(1, 5)))
def test_parse_finds_the_cheapest_edits(turns, sizes):
    turns = [("." if i == "x" else i, f) for i, f in turns]
    stack = conversations.Stack.at(conversations.START)
    for i, f in turns:
        stack.push(i + f)
    top = stack.closed()
    audit = "".join(stack.edits(top)) + conversations.CLOSING[top]
    cost = stack.costs()[top][0] + 2 * len(conversations.CLOSING[top])
    assert (cost, audit) == plain_repair(turns)
    # Cut anywhere, the chained chunks give the same edits.
    cuts, left = [], turns
    for n in itertools.cycle(sizes or [3]):
        if not left:
            break
        cuts.append(left[:n])
        left = left[n:]
    tables = []
    for part in cuts:
        flat = []
        for t in range(4):
            stack = conversations.Stack.at(t)
            for i, f in part:
                stack.push(i + f)
            flat += [x for n in stack.costs() for x in (n or (-1, -1))]
        tables.append(flat)
    made = ""
    for part, (before, after) in zip(cuts, conversations._chain(tables) if cuts else []):
        stack = conversations.Stack.at(before)
        for i, f in part:
            stack.push(i + f)
        goal = after if after >= 0 else stack.closed()
        made += "".join(stack.edits(goal)) + (conversations.CLOSING[goal] if after < 0 else "")
    assert made == audit


def talks(spark, rows):
    full = [(*r, 1, "x", 2) for r in rows]
    return spark.createDataFrame(full, "conv_id bigint, turn bigint, role string, text string, chunk int, edit string, side int")


ODD = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (2, None, "system", "s."),
       (2, 3, "tool", "x?"), (2, None, None, None), (3, 0, "user", " \t\n"), (4, 5, "", "a."), (None, 0, "user", "a"),
       (None, None, "assistant", "b."), (5, 0, "assistant", "long " * 30_000 + "."), (6, 0, "user", "a."), (6, 9, "user", "b.")]


def test_long_conversations_are_cut_and_give_the_same(spark):
    rng = random.Random(6)
    texts = ["a.", "b", "c!", " ", "d?", *(f"t{i}." for i in range(40))]
    rows = ODD + [(7, i, rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(texts)) for i in range(300)]
    rows += [(None, i, rng.choice(["user", "assistant"]), rng.choice(texts)) for i in range(90)] + [(8, 1, "user", "same.")] * 60
    frame = talks(spark, rows)
    whole = sorted(map(tuple, conversations.digests(frame).collect()), key=repr)
    cut = sorted(map(tuple, conversations.digests(frame, chunk=25).collect()), key=repr)
    assert whole == cut and len(whole) == 9
    edits = conversations.repair(frame, chunk=25)
    assert edits.select("conv_id", "chunk").distinct().count() > 20
    assert edits.filter("edit <> 'I'").count() == len(rows)
    roles = {}
    for r in edits.orderBy("conv_id", "chunk", "step").filter("role is not null").collect():
        roles[r["conv_id"]] = roles.get(r["conv_id"], "") + r["role"][0]
    import re
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_conversation_counts_on_odd_rows(spark):
    got = {r["conv_id"]: r for r in conversations.digests(talks(spark, ODD)).collect()}
    pick = lambda c: tuple(got[c][x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    assert pick(1) == (0, 0, 1, 0, 1, 3, "KKD")
    # The nameless blank turn comes first, then the system turn; a user is put in before the tool's.
    assert pick(2) == (0, 1, 0, 0, 2, 3 + 2 + 2, "DKIR")
    assert pick(3) == (0, 1, 0, 0, 0, 3, "D")
    assert pick(6) == (8, 0, 0, 0, 1, 2, "KR")
    assert pick(5)[5:] == (2, "IK") and got[None]["truncated"] == 1
    assert conversations.digests(talks(spark, [])).count() == 0
    assert damaged(talks(spark, ODD)).count() > 0


def test_op13_matches_its_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    from meterline.llm.selection_queries import OP13_SQL
    rng = random.Random(9)
    rows = ODD + [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", None, "x"]),
                   rng.choice(["a.", "b", "", None, "c?!", "d. "])) for c in range(60) for _ in range(rng.randint(1, 9))]
    talks(spark, rows).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    res = con.execute(OP13_SQL)
    cols = [d[0] for d in res.description]
    want = sorted(res.fetchall(), key=repr)
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).select(*cols)
    assert sorted(map(tuple, got.collect()), key=repr) == want
