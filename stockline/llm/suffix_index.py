"""A stored family of suffix arrays: byte deduplication batch by batch.

``SuffixIndex.add`` takes a new batch of documents and returns what
``suffix_dedup.remove_repeated_bytes`` returns for it, judged against the batch
itself and against every batch added before, which is not read again as a whole:

1. The batch gets its suffix array: the suffixes that begin at content-defined
   anchors (``_anchored``; every ``length``-byte string holds one, at a place
   that its content alone decides), in lexicographic order of their first
   ``gram`` bytes, range-partitioned and sorted.
2. The array is merge-scanned against each stored level, which is in the same
   order.  Suffixes with equal beginnings are candidates of long matches; the
   texts they stand in are fetched from the level and extended: one run over
   these and the batch finds every string that starts earlier.
3. Suffixes of the batch that begin something new become a level; a passage that
   the index has already is not stored again, so what a third of all rows share
   is one entry.  While the last two levels are of about equal size they are
   merged into one, so n batches leave at most log2(n) levels of sizes that at
   least halve, and each suffix is rewritten log2(n) times.

Levels are folders (``suffixes`` and the ``texts`` they stand in); a numbered
state file names the current ones and is created only if it does not exist, so
of two batches added at once one fails and can be added again, and a job that dies
leaves the index as it was.

Order: documents of earlier batches come before those of later ones whatever
their ids; inside a batch, and for all edge cases, as in ``suffix_dedup``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.llm import _anchored, _text, suffix_dedup
from stockline.llm._anchored import Windows
from stockline.llm._store import written
from stockline.sources.stores import children, create_new

#: Stands for a null id inside the batch: after the earlier batches, before every other id.
FIRST_ID = -(1 << 63) + 1


@dataclass(frozen=True)
class Level:
    name: str
    suffixes: int


def _arrays(batches: Iterator[pa.RecordBatch], windows: Windows, new_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows (prefix, uid, pos) of the anchored suffixes; with ``new_only`` of those that begin a string found for the first time."""
    for batch in batches:
        uid = batch.column("uid").to_numpy()
        for part in _text.slices(batch.column("text")):
            _, first, at, lo, hi, _, text = windows.anchors(part)
            if not len(at):
                continue
            if new_only:
                gone = _starts(batch.column("gone").slice(part.lo, part.hi - part.lo), first)
                before = np.append(0, np.cumsum(gone))
                new = before[hi + 1] - before[lo] < hi - lo + 1
                at, text = at[new], text[new]
            cut = part.buf[at[:, None] + np.arange(windows.base)]
            off = (windows.base * np.arange(len(at) + 1)).astype(np.int32)
            prefix = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(cut))])
            yield pa.RecordBatch.from_arrays([prefix, pa.array(uid[part.lo + text]), pa.array(at - first[text])], ["prefix", "uid", "pos"])


def _starts(gone: pa.Array, first: np.ndarray) -> np.ndarray:
    """Which positions of a slice's texts begin a removed string."""
    return _anchored.removed_items(gone, first, 1)


class SuffixIndex:
    """The levels under ``root``, a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str, length: int = suffix_dedup.LENGTH, gram: int = suffix_dedup.GRAM):
        self.spark, self.root = spark, root.rstrip("/")
        self.windows = Windows(words=False, window=length, base=min(gram, length))

    def _number(self) -> int:
        names = [n for n in children(self.spark, f"{self.root}/state") if n.endswith(".json")]
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def levels(self) -> list[Level]:
        """The current levels, largest first."""
        number = self._number()
        if not number:
            return []
        (row,) = self.spark.read.text(f"{self.root}/state/{number:012d}.json", wholetext=True).collect()
        return [Level(**level) for level in json.loads(row["value"])]

    def _table(self, level: Level, name: str) -> DataFrame:
        schema = {"suffixes": "prefix binary, uid bigint, pos bigint", "texts": "uid bigint, text string"}[name]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{level.name}/{name}")

    def _write(self, suffixes: DataFrame, texts: DataFrame) -> Level:
        """A new level: suffixes in lexicographic order, and the texts that they stand in."""
        name = f"level-{uuid.uuid4().hex[:12]}"
        ordered = suffixes.repartitionByRange("prefix", "uid", "pos").sortWithinPartitions("prefix", "uid", "pos")
        ordered.write.parquet(f"{self.root}/{name}/suffixes")
        level = Level(name, self._table(Level(name, 0), "suffixes").count())
        held = self._table(level, "suffixes").select("uid").distinct()
        texts.join(held, "uid", "left_semi").dropDuplicates(["uid"]).write.parquet(f"{self.root}/{name}/texts")
        return level

    def _merged(self, a: Level, b: Level) -> Level:
        both = [self._table(a, name).unionByName(self._table(b, name)) for name in ("suffixes", "texts")]
        return self._write(*both)

    def _matched(self, array: DataFrame, levels: list[Level]) -> DataFrame | None:
        """Stored texts with a suffix that begins like one of the batch."""
        asked = array.select("prefix").distinct()
        out = None
        for level in levels:
            uids = self._table(level, "suffixes").join(asked, "prefix", "left_semi").select("uid").distinct()
            texts = self._table(level, "texts").join(uids, "uid", "left_semi").select("text")
            out = texts if out is None else out.unionByName(texts)
        return out

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch against itself and the index, and add it: doc_id, n_bytes, n_removed, n_spans, kept."""
        number, levels = self._number(), self.levels()
        ids = F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST_ID))
        batch = docs.select(ids.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        texts = written(_anchored.identified(batch, "doc_id", "text"), "batch")
        windows = self.windows
        array = texts.select("text", "uid").mapInArrow(lambda b: _arrays(b, windows, False), "prefix binary, uid bigint, pos bigint")
        everything = texts
        if levels:
            earlier = self._matched(written(array.repartitionByRange("prefix").sortWithinPartitions("prefix"), "array"), levels)
            # a null id comes first in the order
            before = earlier.select(F.lit(None).cast("bigint").alias("doc_id"), "text")
            everything = written(texts.unionByName(_anchored.identified(before, "doc_id", "text")), "matched")
        gone = written(suffix_dedup.repeated_runs(everything, windows), "gone")
        judged = texts.join(gone, "uid", "left")
        new = judged.select("text", "uid", "gone").mapInArrow(lambda b: _arrays(b, windows, True), "prefix binary, uid bigint, pos bigint")
        # rows equal in id and text are one row listed several times
        level = self._write(new.dropDuplicates(["uid", "pos"]), texts.select("uid", "text"))
        if level.suffixes:
            levels = [*levels, level]
        while len(levels) > 1 and 2 * levels[-1].suffixes > levels[-2].suffixes:
            last = levels.pop()
            levels.append(self._merged(levels.pop(), last))
        state = json.dumps([{"name": v.name, "suffixes": v.suffixes} for v in levels])
        if not create_new(self.spark, f"{self.root}/state/{number + 1:012d}.json", state):
            raise RuntimeError(f"another batch was added to {self.root} meanwhile; add this one again")
        kept = suffix_dedup.kept_bytes(judged, windows.window)
        return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(FIRST_ID)))
