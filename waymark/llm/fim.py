"""Fill-in-the-middle transformation of whole texts, with ropes.

A text is cut into units (a word with the white space before it; white space at the end is one more). Two of the n + 1 places
between units are drawn by a hash of seed and doc_id; prefix, middle and suffix are what lies before, between and after
them. A document is left plain, or rewritten with sentinels as psm, `<P>`prefix`<S>`suffix`<M>`middle, or as spm,
`<S>`suffix`<P>`prefix`<M>`middle, by the same hash.

The text is a rope: leaves hold up to LEAF units of text, and every node caches how many units and code points
lie below it. Splitting at a unit rank walks down one path and cuts one leaf; the rearranged text is a concatenation of
subtrees and sentinels, and no other leaf is touched. The inverse makes a rope of the output, splits it at the code-point ranks of its
sentinels and concatenates the parts in their old order.

Null and empty texts, and those that hold a sentinel, are plain. A null doc_id draws as an empty number does; repeated rows
share their fate; an empty table gives an empty table; other columns are ignored; texts are taken whole, each row for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
UNIT = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LEAF = 256
_unit = re.compile(UNIT)
_leaf = re.compile(f"(?:{UNIT}){{1,{LEAF}}}")


@dataclass(frozen=True)
class Settings:
    """rate: documents rewritten, of 100; spm: of these, so many of 100 in the form that puts the suffix first."""

    seed: str = "42"
    rate: int = 50
    spm: int = 80


class Leaf:
    """A piece of text with its counts."""

    __slots__ = ("chars", "depth", "text", "units")

    def __init__(self, text: str, units: int):
        self.text, self.units, self.chars, self.depth = text, units, len(text), 0

    def leaves(self) -> Iterator[Leaf]:
        yield self

    def cut(self, units: int | None, chars: int) -> tuple[Leaf, Leaf]:
        """Two leaves, at a unit rank if one is given. Units of pieces cut inside a unit aren't counted anew."""
        if units is not None:
            ends = [m.end() for m in _unit.finditer(self.text)]
            chars = ends[units - 1]
        return Leaf(self.text[:chars], units or 0), Leaf(self.text[chars:], self.units - (units or 0))


class Node:
    """Two ropes, one after the other; counts are sums."""

    __slots__ = ("chars", "depth", "left", "right", "units")

    def __init__(self, left: Leaf | Node, right: Leaf | Node):
        self.left, self.right = left, right
        self.units, self.chars, self.depth = left.units + right.units, left.chars + right.chars, 1 + max(left.depth, right.depth)

    def leaves(self) -> Iterator[Leaf]:
        below: list = [self]
        while below:
            at = below.pop()
            if isinstance(at, Node):
                below += [at.right, at.left]
            else:
                yield at


Rope = Leaf | Node
EMPTY = Leaf("", 0)


def balanced(leaves: list[Leaf]) -> Rope:
    """A rope of leaves, paired level by level."""
    level: list[Rope] = leaves or [EMPTY]
    while len(level) > 1:
        level = [Node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def rope(text: str) -> Rope:
    """The rope of a text: every leaf but the last one has LEAF units."""
    pieces = [m.group() for m in _leaf.finditer(text)]
    return balanced([Leaf(p, LEAF) for p in pieces[:-1]] + [Leaf(p, sum(1 for _ in _unit.finditer(p))) for p in pieces[-1:]])


def concat(*ropes: Rope) -> Rope:
    whole = EMPTY
    for r in ropes:
        whole = r if not whole.chars else Node(whole, r) if r.chars else whole
    return whole


def split(whole: Rope, units: int | None = None, chars: int = 0) -> tuple[Rope, Rope]:
    """What is before and after a unit rank, or else a code-point rank: one path down by the cached counts."""
    rank, count = (chars, "chars") if units is None else (units, "units")
    before: list[Rope] = []
    after: list[Rope] = []
    at = whole
    while True:
        if rank <= 0:
            after.append(at)
            break
        if rank >= getattr(at, count):
            before.append(at)
            break
        if isinstance(at, Leaf):
            one, two = at.cut(rank if units is not None else None, rank)
            before.append(one)
            after.append(two)
            break
        inside = getattr(at.left, count)
        if rank < inside:
            after.append(at.right)
            at = at.left
        else:
            before.append(at.left)
            at, rank = at.right, rank - inside
    return concat(*before), concat(*reversed(after))


def flat(whole: Rope) -> str:
    return "".join(leaf.text for leaf in whole.leaves())


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2**32 for a document."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in (0, 8, 16, 24)]


@dataclass(frozen=True)
class Filled:
    """A document's output: its form, the text as a rope, units of the whole and code points of the parts."""

    form: str
    out: Rope
    n: int
    prefix_chars: int | None = None
    middle_chars: int | None = None


def transform(doc_id: int | None, text: str, settings: Settings = Settings()) -> Filled:
    whole = rope(text)
    n = whole.units
    one, two, plain, form = draws(doc_id, settings.seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or plain % 100 >= settings.rate:
        return Filled("plain", whole, n)
    first, second = sorted((one % (n + 1), two % (n + 1)))
    head, suffix = split(whole, units=second)
    prefix, middle = split(head, units=first)
    p, s, m = (Leaf(x, 0) for x in (PREFIX, SUFFIX, MIDDLE))
    if form % 100 < settings.spm:
        return Filled("spm", concat(s, suffix, p, prefix, m, middle), n, prefix.chars, middle.chars)
    return Filled("psm", concat(p, prefix, s, suffix, m, middle), n, prefix.chars, middle.chars)


def restore(output: str, form: str) -> str:
    """The text that an output and its form come from. Sentinels can't overlap, and texts with one are plain, so each is found once."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    rest, part = rope(output), {}
    ends = [output.index(s) for s in order[1:]] + [len(output)]
    done = 0
    for sentinel, end in zip(order, ends, strict=True):
        piece, rest = split(rest, chars=end - done)
        part[sentinel] = split(piece, chars=len(sentinel))[1]
        done = end
    return flat(concat(part[PREFIX], part[MIDDLE], part[SUFFIX]))


_COUNTS = ("n", "prefix_chars", "middle_chars")


def _transformed(settings: Settings, digest: bool):
    def hashed(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out, outputs, restored = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    filled = transform(doc_id, text or "", settings)
                    output = flat(filled.out)
                    outputs.append(hashed(output) if digest else output)
                    if digest:
                        restored.append(hashed(restore(output, filled.form)))
                    out.append(filled)
                columns = {"doc_id": part.column(0)} | {c: pa.array([getattr(f, c) for f in out], pa.int64()) for c in _COUNTS} | {"form": pa.array([f.form for f in out])}
                columns |= {"output_sha256": pa.array(outputs), "restored_sha256": pa.array(restored)} if digest else {"output": pa.array(outputs)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def fill_in_middle(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, prefix_chars, middle_chars, form, output (the rewritten text) of every row."""
    return _keyed(docs).mapInArrow(_transformed(settings, digest=False), "doc_id bigint, n bigint, prefix_chars bigint, middle_chars bigint, form string, output string")


def restore_texts(filled: DataFrame) -> DataFrame:
    """doc_id, text of every row of filled (doc_id, form, output)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [restore(o, f) for f, o in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return filled.select(F.col("doc_id").cast("bigint").alias("doc_id"), "form", "output").mapInArrow(run, "doc_id bigint, text string")


def fim_digest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, prefix_chars, middle_chars, form, output_sha256, and restored_sha256 of the text rebuilt from the output."""
    schema = "doc_id bigint, n bigint, prefix_chars bigint, middle_chars bigint, form string, output_sha256 string, restored_sha256 string"
    return _keyed(docs).mapInArrow(_transformed(settings, digest=True), schema)


def fim_sql(settings: Settings = Settings()) -> str:
    """DuckDB SQL for fim_digest."""
    draw = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    holds = " OR ".join(f"contains(text, '{s}')" for s in (PREFIX, SUFFIX, MIDDLE))
    part = lambda a, b: f"array_to_string(units[{a}:{b}], '')"
    return f"""WITH base AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{settings.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        cut AS (SELECT *, regexp_extract_all(text, '{UNIT}') AS units FROM base),
        drawn AS (SELECT *, len(units) AS n, least({draw(0)} % (len(units) + 1), {draw(1)} % (len(units) + 1)) AS a, greatest({draw(0)} % (len(units) + 1), {draw(1)} % (len(units) + 1)) AS b,
            CASE WHEN text = '' OR {holds} OR {draw(2)} % 100 >= {settings.rate} THEN 'plain' WHEN {draw(3)} % 100 < {settings.spm} THEN 'spm' ELSE 'psm' END AS form FROM cut),
        parts AS (SELECT doc_id, n, form, text, {part("1", "a")} AS p, {part("a + 1", "b")} AS m, {part("b + 1", "n")} AS s FROM drawn)
        SELECT doc_id, n::BIGINT AS n, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, form,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM parts"""


__all__ = ["Settings", "fill_in_middle", "fim_digest", "fim_sql", "restore", "restore_texts", "transform"]
