"""Long JSON documents read by many tasks."""

import json

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from meterline.operators.attribution import Topology
from meterline.sources import elements as E
from meterline.sources import logs as L
from meterline.sources.spec import SpecSource

KEYS = st.sampled_from(["a", "b", "items", 'q"', "x}y", "\\", "é[", ""])
LEAF = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text(alphabet='ab"\\{}[],:é ', max_size=6))
VALUE = st.recursive(LEAF, lambda v: st.lists(v, max_size=4) | st.dictionaries(KEYS, v, max_size=4), max_leaves=12)


def split(text: str, path: str, size: int) -> list | None:
    """The elements as the jobs find them, on one machine; None for a refused document."""
    wanted, fragments = E.steps_of(path), text.encode().split(b"}")
    if not fragments[-1]:
        fragments.pop()
    pieces, held = [], b""
    for f in fragments:
        if held and len(held) >= size:
            pieces.append(held)
            held = b""
        held += f + b"}"
    pieces.append(held)
    rows, inside, depth = [], False, 0
    for n, piece in enumerate(pieces):
        parity, outside, within = E.totals(piece)
        change = within if inside else outside
        left, _ = E.walk(piece, inside, depth, [[None, False, 0, False]] * max(0, min(depth, len(wanted))), len(wanted))
        rows.append(("f", 0, n, len(text.encode()), len(piece), parity, change, inside, depth, json.dumps(left)))
        inside, depth = inside ^ bool(parity), depth + change
    names = ["file", "block", "piece", "length", "bytes", "parity", "change", "inside", "depth", "left"]
    states = E._paths(pd.DataFrame(rows, columns=names))
    if not len(states):
        return None
    parts = {}
    for piece, (_, s) in zip(pieces, states.iterrows()):
        for line, value, _whole in E.elements_of(piece, s["inside"], s["depth"], json.loads(s["stack"]), wanted):
            parts[line] = parts.get(line, b"") + value
    return [json.loads(parts[k]) for k in sorted(parts) if parts[k].strip()]


def at(doc, path):
    for step in E.steps_of(path)[1:]:
        if isinstance(step, int) and isinstance(doc, list) and step < len(doc):
            doc = doc[step]
        elif isinstance(step, str) and isinstance(doc, dict) and step in doc:
            doc = doc[step]
        else:
            return []
    return doc if isinstance(doc, list) else []


@settings(max_examples=400, deadline=None)
@given(VALUE, VALUE, st.lists(VALUE, max_size=5), st.integers(1, 40), st.sampled_from([None, 2]),
       st.sampled_from(["items", "a.items", "b.2.items", "1", "0.items"]))
def test_pieces_of_any_size_give_the_list(before, after, items, size, indent, path):
    doc = items
    for step in reversed(E.steps_of(path)[1:]):
        doc = {"b": before, step: doc, "z": after} if isinstance(step, str) else [before] * step + [doc, after]
    text = json.dumps(doc, indent=indent, ensure_ascii=False)
    assert split(text, path, size) == items == at(doc, path)
    for other in ("items", "b", "z.0", "a.b"):
        assert split(text, other, size) == at(doc, other)


def test_unclosed_and_repeated_documents_are_refused():
    text = json.dumps({"a": [{"n": i} for i in range(9)]})
    assert split(text, "a", 10) == [{"n": i} for i in range(9)] == split(text + "\n", "a", 10)
    for bad in (text[:-1], text[:-2], text[:30], text + "}", text + text, '"' + text, text[:40] + '"' + text[40:]):
        assert split(bad, "a", 10) is None


SPEC = {"provider": "doc", "format": "json", "records": "task.items", "where": {"role": "assistant"},
        "fields": {"ts": "at", "output": "n", "model": "model"}}


def test_split_files_read_like_whole_ones(spark, tmp_path):
    items = [{"role": "assistant" if i % 3 else "user", "at": f"2026-01-01T00:00:{i % 60:02d}Z", "n": i, "model": "m",
              "text": '}{"\\' * (i % 50)} for i in range(3000)]
    for name, doc in (("a", {"task": {"v": [1, {"x": []}], "items": items}}), ("b", {"task": {"items": items[:7]}}),
                      ("c", {"task": {"items": []}}), ("d", {"items": items}), ("e", {"task": {"items": {"0": 1}}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc) + "\n" * (name == "b"))
    (tmp_path / "f.json").write_text(json.dumps({"task": {"items": items}})[:-5])
    (tmp_path / "g.json").write_text("")
    globs = [str(tmp_path / "*.json"), str(tmp_path / "none" / "*")]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        want = L.array_records(L.read_documents(spark, globs), "task.items")
        text = lambda df: sorted(map(tuple, df.selectExpr("file", "line", "to_json(rec)").collect()))
        expected = text(want)
        assert len(expected) == 3007
        for longer_than in (0, 10_000, 1 << 40):
            assert text(E.read_elements(spark, globs, "task.items", longer_than=longer_than, piece=5000)) == expected
        source = SpecSource({**SPEC, "roots": globs}, Topology({"code_roots": ["/x"]}, home="/home/dev"))
        turns = source.load(spark)
        assert sorted((r["turn"], r["output"]) for r in turns.select("turn", "output").collect()) == sorted(
            (k + 1, n) for part in (items, items[:7]) for k, n in enumerate(
                x["n"] for x in part if x["role"] == "assistant" and x["n"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
