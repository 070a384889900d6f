"""Audit of how filters act on each other, for every order of applying them.

One pass over the texts gives each document its failure mask (bit i: it fails
filter i); only (text digest, id, part, mask) leaves that pass, as a written
table.  "Identical to the text of a smaller id" is decided on the SHA-256 of the
whole text: the smallest id of each digest is found with partial aggregation (a
text that a third of all rows share is one row per map task) and joined back on
(digest, id), a key that no copy shares with another.  Rows are then counted per
(part, mask), 2**k masks at most whatever the input.

From these counts each part gets a count-weighted decision diagram: a level per
filter, a pass and a fail child per node, equal subdiagrams stored once, and on
every node the counts of all documents below it.  The orders of the filters are
walked by plain changes, so each is one swap of adjacent levels away from the
one before; a swap touches the nodes of two levels only.  In every order the
path along the pass children gives the steps: the fail child's counts are what
the filter removes there, the pass child's what it keeps.

Edge cases: a null text is empty (no words, no characters: fails A alone, and E
if a smaller id's text is empty too); a null or empty part is the part ''; a
null id neither is a duplicate nor makes one, and has no label; rows that share
an id are documents of their own, and a copy in the same id is no copy of a
smaller id; an id with several label rows is good (toxic) if any of them says
so; texts are read whole; an empty table gives no rows; columns other than id,
text and part (and id, quality, toxic of the labels) are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm import _text
from stockline.llm._store import written

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
COUNTS = ("n", "good", "toxic")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
#: UTF-8 bytes that begin a code point.
_BEGINS = (np.arange(256) & 0xC0) != 0x80

Weight = tuple[int, ...]


def _per_text(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flag, dtype=np.int64))[off])


def failures(part: _text.Slice) -> np.ndarray:
    """The mask of filters A to D that each text of a slice fails (A: bit 0)."""
    data = part.buf.tobytes()
    words = np.empty(part.hi - part.lo, np.int64)
    distinct = np.empty(part.hi - part.lo, np.int64)
    cuts = part.off.tolist()
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        found = data[a:b].split()  # splits bytes at ASCII white space and nothing else
        words[i], distinct[i] = len(found), len(set(found))
    capitals = _per_text(_CAPITAL[part.buf], part.off)
    points = _per_text(_BEGINS[part.buf], part.off)
    symbols = _per_text(_SYMBOL[part.buf], part.off)
    fails = (
        words < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * words,
        100 * capitals > CAPITAL_PERCENT * points,
        symbols > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch.column("text")):
            texts = part.hi - part.lo
            cuts = part.off.tolist()
            digests = [hashlib.sha256(part.buf[a:b]).digest() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(part.lo, texts),
                    batch.column("part").slice(part.lo, texts),
                    pa.array(digests, pa.binary()),
                    pa.array(failures(part), pa.int32()),
                ],
                ["doc_id", "part", "digest", "mask"],
            )


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and failure mask (filters A to E, A: bit 0) of every document."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("string").alias("text"),
    )
    judged = written(rows.mapInArrow(_masked, "doc_id bigint, part string, digest binary, mask int"), "masks")
    first = judged.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    is_copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    copy_bit = F.when(is_copy, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return judged.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + copy_bit).alias("mask"))


def counts(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of each mask, all and labelled."""
    marks = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("bigint").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    return (
        judged.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS[1:]))
    )


class Diagram:
    """Count-weighted decision diagram of failure masks.

    ``order[i]`` is the filter of level i.  A node is a number; ``kids`` has its
    pass and fail child, ``weight`` the counts of all documents below it.  Node 0
    holds no document and stands at any level.  ``levels[i]`` finds a node of
    level i by its children, so equal subdiagrams are one node; nodes of the last
    level have leaves as children, which are found by their counts.
    """

    def __init__(self, weights: dict[int, Weight], filters: int):
        self.order = list(range(filters))
        self.zero = tuple(0 for _ in next(iter(weights.values()), (0,)))
        self.kids: dict[int, tuple[int, int]] = {}
        self.weight: dict[int, Weight] = {0: self.zero}
        self.leaves: dict[Weight, int] = {self.zero: 0}
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in self.order]
        self.last = 0
        self.root = self._built(weights, 0, 0)

    def _node(self) -> int:
        self.last += 1
        return self.last

    def _built(self, weights: dict[int, Weight], level: int, mask: int) -> int:
        if level == len(self.order):
            counts = weights.get(mask, self.zero)
            if counts not in self.leaves:
                self.leaves[counts] = self._node()
                self.weight[self.leaves[counts]] = counts
            return self.leaves[counts]
        return self.make(level, self._built(weights, level + 1, mask), self._built(weights, level + 1, mask | 1 << level))

    def make(self, level: int, passed: int, failed: int) -> int:
        """The node of a level with these children."""
        if not passed and not failed:
            return 0
        key = passed, failed
        if key not in self.levels[level]:
            node = self.levels[level][key] = self._node()
            self.kids[node] = key
            self.weight[node] = tuple(map(int.__add__, self.weight[passed], self.weight[failed]))
        return self.levels[level][key]

    def swap(self, level: int) -> None:
        """Exchange a level with the next; nodes of the upper level keep number, meaning and weight."""
        upper, lower = self.levels[level], self.levels[level + 1]
        old = {node: self.kids.pop(node) for node in lower.values()} | {0: (0, 0)}
        self.levels[level], self.levels[level + 1] = {}, {}
        for (passed, failed), node in upper.items():
            (pp, pf), (fp, ff) = old[passed], old[failed]
            key = self.make(level + 1, pp, fp), self.make(level + 1, pf, ff)
            self.levels[level][key] = node
            self.kids[node] = key
        for node in lower.values():
            del self.weight[node]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """(filter, counts kept, counts removed) along the path of documents that pass."""
        out, node = [], self.root
        for name in self.order:
            passed, failed = self.kids.get(node, (0, 0))
            out.append((name, self.weight[passed], self.weight[failed]))
            node = passed
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Positions of adjacent swaps that walk through all n! orders, each once."""
    if n < 2:
        return
    down = True
    for step in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if step is not None:
            yield step + down
        down = not down


def orders(weights: dict[int, Weight], names: str = FILTERS) -> list[dict]:
    """One row per order of the filters and step, from the counts of each mask."""
    diagram = Diagram(weights, len(names))
    walk = [diagram.steps()]
    for level in plain_changes(len(names)):
        diagram.swap(level)
        walk.append(diagram.steps())
    failing, alone, total = {}, {}, dict.fromkeys(range(len(names)), 0)
    for steps in walk:
        failing[steps[0][0]] = steps[0][2][0]  # first in the order: all that fail it
        alone[steps[-1][0]] = steps[-1][2][0]  # last: those that fail nothing else
        for name, _, removed in steps:
            total[name] += removed[0]
    return [
        {
            "filter_order": "".join(names[s[0]] for s in steps),
            "step": i + 1,
            "kept": kept[0],
            "removed": removed[0],
            "redundant": failing[name] - removed[0],
            "unique_fails": alone[name],
            "good_lost": removed[1],
            "toxic_lost": removed[2],
            "shapley": total[name],
        }
        for steps in walk
        for i, (name, kept, removed) in enumerate(steps)
    ]


_SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)
_ARROW = pa.schema(
    [(f.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.split()[1]]) for f in _SCHEMA.split(", ")]
)


def _audited(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    weights = {r["mask"]: tuple(r[c] for c in COUNTS) for r in rows}
    return pa.Table.from_pylist([{"part": rows[0]["part"], **r} for r in orders(weights)], _ARROW)


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """part, filter_order, step and what the filter does there (see the module text)."""
    judged = masks(docs, id_col, text_col, part_col)
    return counts(judged, labels, id_col).groupBy("part").applyInArrow(_audited, _SCHEMA)
