"""Repair of conversations by a generalised LR parse of their roles.

Roles must read ``(s?(ua)+)?``: an optional system turn, then pairs of user and assistant. The
parser's stack tops are START, SYSTEM (after s), USER (after u) and PAIR (after a reduced
``ua``). Every turn may be kept (0), reroled to user or assistant (2) or deleted (3; a blank
or duplicate one must be); an empty user or assistant turn may be inserted anywhere (2); a
truncated turn that stays costs 1 more. The stack is a graph: a level per turn, at most
one node per stack top, as nodes with equal tops are merged into the one of the least (cost,
audit), audit being the initials of its edits. Two nodes of one level never have audits of
which one begins the other (both end with the edit of the same turn), so the order of two
longer audits is that of the nodes they grew from, and no audit is spelled out before the end.
A level depends only on the costs and order of the nodes before it and on the kind of the turn;
these few cases are worked out once and kept.

Conversations are streamed through tasks, sorted, one held at a time. One of more turns than
``CHUNK`` is cut into chunks of consecutive turns: each is parsed from all four tops, and its
4 x 4 costs are chained over the chunks; a text that an earlier chunk holds is looked up by a
join on (text, first chunk). So no conversation, however long, is gathered in one task.

Defined results. The role's first sign is its initial; other initials than s, u, a can only be
reroled or deleted. A null role or text is one blank. Turns are taken by number, those without
one first, then by role and text; equal rows stay side by side. A null conv_id is a
conversation of its own. Blank: only white space. Duplicate: role and text were seen earlier
in the conversation. Truncated: the last visible sign is none of ``.!?``. A turn's first fault
counts. Repeated rows are turns. An empty table gives an empty table. Only conv_id, turn, role
and text are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.cluster import write_and_read
from meterline.llm.texts import over_batches
from meterline.operators.scan import by_chunks

SPACE = " \t\n\x0b\x0c\r"
CHUNK = 20_000
KEYS, ORDER = ["conv_id"], ["turn", "role", "text", "n"]
START, SYSTEM, USER, PAIR = range(4)
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIR, "u"): USER, (USER, "a"): PAIR}
# What may be shifted by an insertion or a new role on each stack top.
WANTED = {START: "u", SYSTEM: "u", PAIR: "u", USER: "a"}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Edits that end the input on each top: the empty conversation and whole pairs are accepted.
CLOSING = {START: "", SYSTEM: "II", USER: "I", PAIR: ""}
Level = tuple  # of four (cost, rank) or None


def _moves(top: int, kind: str) -> list[tuple[int, int, str]]:
    """(next top, cost, edits) of one turn on a stack top; ``kind`` is initial and fault."""
    initial, fault = kind[0], kind[1]
    out, inserted, cost, at = [], "", 0, top
    for _ in range(3):  # a third insertion would come back to a top it has been on
        out.append((at, cost + DELETE, inserted + "D"))
        if fault in "-t":
            stays = cost + (TRUNCATED if fault == "t" else 0)
            if (at, initial) in SHIFT:
                out.append((SHIFT[at, initial], stays, inserted + "K"))
            out.append((SHIFT[at, WANTED[at]], stays + REROLE, inserted + "R"))
        at, inserted, cost = SHIFT[at, WANTED[at]], inserted + "I", cost + INSERT
    return out


class Stack:
    """Graph-structured stack: levels of merged tops with the edges that lead to them."""

    _known: dict[tuple[Level, str], tuple[int, Level, tuple]] = {}

    def __init__(self, tops: Level):
        self.level, self.cost, self.edges = tops, 0, []

    @classmethod
    def at(cls, top: int) -> Stack:
        return cls(tuple((0, 0) if t == top else None for t in range(4)))

    def push(self, kind: str) -> None:
        key = (self.level, kind)
        if key not in self._known:
            self._known[key] = self._work_out(*key)
        more, self.level, edges = self._known[key]
        self.cost += more
        self.edges.append(edges)

    @staticmethod
    def _work_out(level: Level, kind: str) -> tuple[int, Level, tuple]:
        best: list = [None] * 4
        for top, node in enumerate(level):
            for to, cost, edits in _moves(top, kind) if node else ():
                found = (node[0] + cost, node[1], edits, top)
                if best[to] is None or found < best[to]:
                    best[to] = found
        least = min(b[0] for b in best if b)
        order = sorted(b[1:] for b in best if b)
        return (least, tuple(b and (b[0] - least, order.index(b[1:])) for b in best),
                tuple(b and (b[3], b[2]) for b in best))

    def costs(self) -> list[tuple[int, int] | None]:
        """(cost, rank among the tops) of every top."""
        return [n and (n[0] + self.cost, n[1]) for n in self.level]

    def closed(self) -> int:
        """The top from which the input is accepted at the least (cost, audit)."""
        return min((n[0] + INSERT * len(CLOSING[t]), n[1], t) for t, n in enumerate(self.level) if n)[2]

    def edits(self, top: int) -> list[str]:
        """The edits of every turn on the way to ``top``."""
        out = []
        for edges in reversed(self.edges):
            top, edits = edges[top]
            out.append(edits)
        return out[::-1]


def apply(top: int, turns: list[tuple], edits: list[str], closing: str) -> Iterator[tuple]:
    """(index of the turn or None, edit, new role) in order; ``turns`` begin with their role."""
    for i, mine in enumerate([*edits, closing]):
        for edit in mine:
            role = None
            if edit in "IR":
                role, top = NAMES[WANTED[top]], SHIFT[top, WANTED[top]]
            elif edit == "K":
                role, top = turns[i][0], SHIFT[top, turns[i][0][:1]]
            yield (None if edit == "I" else i), edit, role


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, flaw, same): turns in a stated order, all but duplicates found.

    ``flaw`` is b (blank), t (truncated) or -; ``same`` is a key of role and text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    seen = F.rtrim("text", F.lit(SPACE))
    flaw = F.when(F.ltrim("text", F.lit(SPACE)) == "", "b").when(F.right(seen, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    return rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                       F.monotonically_increasing_id().alias("n")).withColumns(
        {"flaw": flaw, "same": F.unhex(F.md5(F.concat_ws("\0", F.length("role"), "role", "text")))})


_STEPS = ("conv_id {conv}, chunk int, step bigint, edit string, fault string, before string, turn {turn}, role string, "
          "text string")
_FAULT = {"b": "blank", "d": "duplicate", "t": "truncated", "-": None}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each (conv_id, chunk) in a sorted stream."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["conv_id"], row["chunk"])
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def _kinds(rows: list[dict], carried: set) -> list[str]:
    """Initial and fault of every turn; ``carried`` are texts of earlier chunks."""
    seen, out = set(carried), []
    for r in rows:
        fault = r["flaw"]
        if fault != "b" and r["same"] in seen:
            fault = "d"
        seen.add(r["same"])
        initial = r["role"][:1]
        out.append((initial if initial in ("s", "u", "a") else ".") + fault)
    return out


def _split(rows: list[dict]) -> tuple[set, int, int, list[dict]]:
    """(texts of earlier chunks, top before, top after, turns) of a chunk's rows."""
    carried = {r["same"] for r in rows if r["side"] == 0}
    known = [r for r in rows if r["side"] == 1]
    before, after = (known[0]["top"], known[0]["goal"]) if known else (START, -1)
    return carried, before, after, [r for r in rows if r["side"] == 2]


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []

    def flushed():
        cols = list(zip(*waiting))
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for (conv, chunk), rows in _chunks(batches):
        carried, before, after, turns = _split(rows)
        kinds, stack = _kinds(turns, carried), Stack.at(before)
        for kind in kinds:
            stack.push(kind)
        # The last chunk of a conversation has no goal: it closes the input.
        goal, closing = (after, "") if after >= 0 else (stack.closed(), None)
        closing = CLOSING[goal] if closing is None else closing
        roles = [(t["role"],) for t in turns]
        for step, (i, edit, role) in enumerate(apply(before, roles, stack.edits(goal), closing)):
            t = turns[i] if i is not None else None
            waiting.append((conv, chunk, step, edit, t and _FAULT[kinds[i][1]], t and t["role"], t and t["turn"], role,
                            t["text"] if t else ""))
            if len(waiting) >= 2000:
                yield flushed()
        if len(waiting) >= 500:
            yield flushed()
    if waiting:
        yield flushed()


def _dealt(rows: DataFrame) -> DataFrame:
    """Chunks whole in one partition, what is known of them before their turns."""
    return rows.repartition("conv_id", "chunk").sortWithinPartitions(
        "conv_id", "chunk", "side", F.col("turn").asc_nulls_first(), "role", "text", "n")


def _edits(part: DataFrame, cut: str | None) -> DataFrame:
    kind = {c: part.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    schema = _STEPS.format(conv=kind["conv_id"], turn=kind["turn"])
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    turns = part.select("conv_id", (F.col(cut) if cut else F.lit(0)).alias("chunk"), F.lit(2).alias("side"), "turn", "role",
                        "text", "n", "flaw", "same", F.lit(None).cast("int").alias("top"),
                        F.lit(None).cast("int").alias("goal"))
    if cut:
        turns = turns.unionByName(_known(turns), allowMissingColumns=True)
    return over_batches(_dealt(turns), lambda batches: _repaired(batches, arrow), schema, 2000)


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The edits of every conversation, in the order of (conv_id, chunk, step).

    ``edit`` is K, R, D or I; ``fault``, ``before`` (role) and ``turn`` are those of the turn,
    null for an insertion; ``role`` is the new one, null for a deletion. Most conversations are
    one chunk.
    """
    return by_chunks(faults(rows), KEYS, ORDER, _edits, chunk)


def digests(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation with turns: counts, cost, audit and hash of the repaired turns."""
    return by_chunks(faults(rows), KEYS, ORDER, lambda part, cut: _digests(_edits(part, cut), cut is None), chunk)


def _known(turns: DataFrame) -> DataFrame:
    """What chunks must know of those before: (side 0) texts seen, (side 1) tops to begin and end on."""
    own = turns.select("conv_id", "chunk", "same").distinct()
    first = own.groupBy("conv_id", "same").agg(F.min("chunk").alias("first"))
    seen = own.withColumnRenamed("conv_id", "c").withColumnRenamed("same", "s").join(
        first, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("s") == F.col("same")) & (F.col("chunk") > F.col("first")))
    seen = write_and_read(seen.select("conv_id", "chunk", "same").withColumn("side", F.lit(0)), "seen")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, chunks, all_costs = [], [], []
        for (conv, chunk), rows in _chunks(batches):
            carried, _, _, mine = _split(rows)
            kinds, flat = _kinds(mine, carried), []
            for top in range(4):
                stack = Stack.at(top)
                for kind in kinds:
                    stack.push(kind)
                flat += [x for n in stack.costs() for x in (n or (-1, -1))]
            convs.append(conv), chunks.append(chunk), all_costs.append(flat)
        yield pa.RecordBatch.from_arrays([pa.array(convs, conv_type), pa.array(chunks, pa.int32()),
                                          pa.array(all_costs, pa.list_(pa.int64()))], names=["conv_id", "chunk", "costs"])

    conv_type = turns.select("conv_id").limit(0).toArrow().schema.field(0).type
    conv = turns.schema["conv_id"].dataType.simpleString()
    dealt = _dealt(turns.unionByName(seen, allowMissingColumns=True))
    tables = over_batches(dealt, costs, f"conv_id {conv}, chunk int, costs array<bigint>")

    def chain(conv: pa.Table) -> pa.Table:
        conv = conv.sort_by("chunk")
        tops = _chain(conv.column("costs").to_pylist())
        return pa.table({"conv_id": conv.column("conv_id"), "chunk": conv.column("chunk"),
                         "top": pa.array([a for a, _ in tops], pa.int32()), "goal": pa.array([b for _, b in tops], pa.int32())})

    # One row of 32 numbers for each chunk of a conversation.
    ends = tables.groupBy("conv_id").applyInArrow(chain, f"conv_id {conv}, chunk int, top int, goal int")
    ends = write_and_read(ends.withColumn("side", F.lit(1)), "tops")
    return seen.unionByName(ends, allowMissingColumns=True)


def _chain(tables: list[list[int]]) -> list[tuple[int, int]]:
    """(top before, top after) of every chunk; -1 after the last, which closes the input."""
    level, ways = [(0, 0), None, None, None], []
    for flat in tables:
        best: list = [None] * 4
        for top, node in enumerate(level):
            for to in range(4) if node else ():
                cost, rank = flat[8 * top + 2 * to:8 * top + 2 * to + 2]
                if cost >= 0:
                    found = (node[0] + cost, node[1], rank, top)
                    best[to] = found if best[to] is None else min(best[to], found)
        order = sorted(b[1:3] for b in best if b)
        level = [b and (b[0], order.index(b[1:3])) for b in best]
        ways.append([b and b[3] for b in best])
    top = min((n[0] + INSERT * len(CLOSING[t]), n[1], t) for t, n in enumerate(level) if n)[2]
    out, after = [], -1
    for way in reversed(ways):
        out.append((way[top], after))
        top = after = way[top]
    return out[::-1]


def _digests(steps: DataFrame, whole: bool) -> DataFrame:
    """Digests of edits; where conversations are whole, they already lie side by side in order.

    A hash runs over a conversation's text from start to end, so the edits of one that was cut
    pass through one task, in order, one batch at a time; only the audit grows with them.
    """
    ordered = steps if whole else steps.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "step")
    conv_type = steps.select("conv_id").limit(0).toArrow().schema.field(0).type
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now:
                        done.append(now.row())
                    now = _Digest(row["conv_id"])
                now.add(row)
            if len(done) >= 500:
                yield made(done)
        if now:
            done.append(now.row())
        if done:
            yield made(done)

    def made(done):
        cols = list(zip(*done))
        done.clear()
        kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    conv = steps.schema["conv_id"].dataType.simpleString()
    return over_batches(ordered, run, f"conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
                                      "illegal bigint, cost bigint, audit string, repaired_sha256 string", 2000)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.first, self.last, self.turns = conv_id, None, None, 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.cost, self.audit, self.initial = 0, 0, [], None
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, r: dict) -> None:
        edit, fault = r["edit"], r["fault"]
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            if fault:
                self.counts[fault] += 1
            self.cost += TRUNCATED if fault == "truncated" and edit != "D" else 0
            initial = r["before"][:1]
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = initial
            if r["turn"] is not None and r["turn"] != self.last:
                self.first = r["turn"] if self.first is None else self.first
                self.last, self.turns = r["turn"], self.turns + 1
        if edit != "D":
            line = f"{r['role']}:{r['text']}"
            self.hash.update((line if self.empty else "\n" + line).encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())
