"""Edit-aware token counts: a segment tree of counts per document.

A text is cut into leaves at single blanks between visible signs. No pre-token of the
vocabulary's pattern reaches over such a place, so leaves can be encoded apart and their
counts add up to the count of the whole text. Sums stand in a tree. An edit re-encodes the
leaves that it touches, with a neighbour where the sign before or after a cut changes, and
updates the sums above them; all other leaves keep their counts.

Every row is worked on by itself: no shuffle, no skew, memory of one batch of texts.

Defined results. A null or empty text is one leaf without tokens. Edits are (start, end,
replacement) in code points; they are taken in order of start, and one that begins before
the last one's end is ignored. Strings of special tokens in a text are ordinary text.
Repeated rows are counted one by one. An empty table gives an empty table. Only doc_id and
text are read, so further columns may have any name.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.texts import over_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 1024
CUT = re.compile(r"(?<=\S) (?=\S)")
Edit = tuple[int, int, str]

# What a redaction replaces, and by what.
_LOCAL, _DOMAIN = re.compile(r"[\w.+-]+"), re.compile(r"[\w-]+(?:\.[\w-]+)+")
_PRIVATE = (
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<address>", "."),
    (re.compile(r"(?:\b\d )?\(\d{3}\) \d{3}-\d{4}\b"), "<phone>", "("),
    (re.compile(r"\b\d{16}\b"), "<card>", None),
    (re.compile(r"\b(?:[A-Za-z_]*(?:token|key|secret|password)) ?[=:] ?\"[^\"\n]{8,}\""), "<secret>", '"'),
)


@lru_cache(maxsize=4)
def _encoding(data: bytes):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """Tokens of a string. The file is read here, on the driver, and goes along with the tasks."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    return _Counter(data)


class _Counter:
    def __init__(self, data: bytes):
        self.data = data

    def __call__(self, text: str) -> int:
        return len(_encoding(self.data).encode_ordinary(text))


def leaf_ends(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Where the leaves end; each has at least ``leaf_chars`` code points but the last."""
    ends, at = [], leaf_chars
    while at < len(text) and (found := CUT.search(text, at)):
        ends.append(found.start())
        at = found.start() + leaf_chars
    return [*ends, len(text)]


def sums(counts: list[int]) -> list[int]:
    """Tree of n leaves: node k is the sum of 2k and 2k+1, the leaves are n to 2n-1."""
    n = len(counts)
    tree = [0] * n + counts
    for k in range(n - 1, 0, -1):
        tree[k] = tree[2 * k] + tree[2 * k + 1]
    return tree


def total(tree: list[int]) -> int:
    return tree[1]


def apply_edits(text: str, ends: list[int], tree: list[int], edits: list[Edit],
                count: Callable[[str], int]) -> tuple[str, list[int], list[int], int, int]:
    """The edited text with its leaves and tree; how many edits counted, how many leaves were encoded."""
    taken: list[Edit] = []
    for edit in sorted(edits):
        if edit[0] <= edit[1] <= len(text) and edit[0] >= (taken[-1][1] if taken else 0):
            taken.append(edit)
    edits = taken
    cuts, n = ends[:-1], len(ends)
    groups: list[list] = []
    for edit in edits:
        # A cut at c stays a cut if the signs at c - 1, c and c + 1 stay and stay together.
        low, high = bisect_right(cuts, edit[0] - 2), bisect_right(cuts, edit[1])
        if groups and low <= groups[-1][1]:
            groups[-1][1] = max(high, groups[-1][1])
            groups[-1][2].append(edit)
        else:
            groups.append([low, high, [edit]])
    tree, parts, at, moved, new_ends = list(tree), [], 0, 0, list(ends)
    next_leaf = 0
    for low, high, mine in groups:
        start, end = (ends[low - 1] if low else 0), ends[high]
        piece, p = [], start
        for a, b, new in mine:
            piece += [text[p:a], new]
            p = b
        made = "".join([*piece, text[p:end]])
        for i in range(next_leaf, low):
            new_ends[i] += moved
        parts += [text[at:start], made]
        moved += len(made) - (end - start)
        for i in range(low, high + 1):
            new_ends[i] = end + moved
            tree[n + i] = 0
        tree[n + low] = count(made)
        at, next_leaf = end, high + 1
        for i in range(low, high + 1):
            k = (n + i) // 2
            while k:
                tree[k] = tree[2 * k] + tree[2 * k + 1]
                k //= 2
    for i in range(next_leaf, n):
        new_ends[i] += moved
    return "".join([*parts, text[at:]]), new_ends, tree, len(edits), len(groups)


def _mails(text: str) -> Iterator[Edit]:
    """Mail addresses. Each run before an @ and each domain after one is looked at once."""
    done = 0
    for m in _LOCAL.finditer(text) if "@" in text else ():
        start, sign = max(m.start(), done), m.end()
        if start < sign and text[sign:sign + 1] == "@" and (domain := _DOMAIN.match(text, sign + 1)):
            done = domain.end()
            yield start, done, "<email>"


def redactions(text: str) -> list[Edit]:
    """Edits that replace personal data and secrets by placeholders."""
    return [*_mails(text)] + [(m.start(), m.end(), name) for pattern, name, sign in _PRIVATE if sign is None or sign in text
            for m in pattern.finditer(text)]


def build(docs: DataFrame, count: Callable[[str], int] | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, text, ends, tree): every text with its leaves and tree of counts."""
    count = count or counter()
    narrow = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*narrow.schema.fields, T.StructField("ends", ints), T.StructField("tree", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for text in batch.column(1).to_pylist():
                ends = leaf_ends(text, leaf_chars)
                every.append((ends, sums([count(text[a:b]) for a, b in zip([0, *ends], ends)])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([e[i] for e in every], pa.list_(pa.int32())) for i in (0, 1))],
                names=["doc_id", "text", "ends", "tree"])
    return over_batches(narrow, run, schema)


def recount(trees: DataFrame, editor: Callable[[str], list[Edit]],
            count: Callable[[str], int] | None = None) -> DataFrame:
    """``trees`` after the edits that ``editor`` asks for, with the counts before and after."""
    count = count or counter()
    names = ("n_tokens", "n_leaves", "n_edits", "n_tokens_after", "leaves_encoded")
    schema = T.StructType([*trees.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for text, ends, tree in zip(*(c.to_pylist() for c in batch.columns[1:])):
                new = apply_edits(text, ends, tree, editor(text), count)
                every.append((*new[:3], total(tree), len(ends), new[3], total(new[2]), new[4]))
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([e[i] for e in every], k) for i, k in enumerate(kinds))],
                names=["doc_id", "text", "ends", "tree", *names])
    return over_batches(trees, run, schema)
