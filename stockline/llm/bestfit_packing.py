"""Packing of tokenised documents into sequences of bounded length, online best fit.

A task tokenises its texts one after the other and places each piece at once: a
document's ids (its end id behind them) are one piece, only a longer one is cut
into pieces of ``capacity`` ids.  Open bins are keyed by their free space in a
bitset (bit f: some open bin has f free places), so the bin that a piece fills
best is the lowest set bit from the piece's length on.  At most ``open_bins``
are open: beyond them the fullest closes, so a task holds that many sequences
however many rows it reads, and no text leaves the task for another.

What is open when a task ends: bins with a share of ``SLACK`` or less free close
as they are.  The pieces of the others, at most ``open_bins`` sequences a task, are
the leftovers; they are few against the input, are dealt to as many tasks as
hold them in open bins, and are placed once more there, longest first.  The
first round is a written table: a lost executor costs a reread, and no text is
tokenised twice.

A sequence is one row: ``sequence_id``, ``n_tokens``, ``width`` (bytes an id: 2
if the vocabulary fits), ``ids`` (little endian), and ``parts``, one (doc_id,
piece, start, length, offset) for each piece, in place order and gapless from 0.
Sequence ids are unique, not consecutive.

Edge cases: a null or empty text is its end id alone; null ids and rows that
share an id are pieces of their own (repeated rows are interchangeable); texts
are read whole; an empty table gives no sequence; only the id and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm import _text
from stockline.llm._store import written
from stockline.llm.token_pack import TABLE_CHUNKS, Encoder

CAPACITY = 4096
OPEN_BINS = 1024
#: A bin with this share of its capacity free, or less, is as good as full.
SLACK = 1 / 256
#: Rows of sequences that a task holds before it sends them on.
BATCH_ROWS = 64

_PART = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, offset: bigint>"
SCHEMA = f"sequence_id bigint, n_tokens bigint, width int, ids binary, parts array<{_PART}>"
_ROUND = f"{SCHEMA}, settled boolean"
_ARROW_PART = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
_ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("width", pa.int32()),
        ("ids", pa.binary()),
        ("parts", pa.list_(_ARROW_PART)),
        ("settled", pa.bool_()),
    ]
)

#: doc_id, piece, start, ids
Piece = tuple[int | None, int, int, bytes]


class OpenBins:
    """A bounded number of open bins, found by free space through a bitset."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits = self.count = 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        same = self.by_free[free]
        one = same.pop()
        if not same:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return one

    def place(self, size: int, item) -> list | None:
        """Put an item of 1 .. capacity units away; returns the bin that closes by it, if one does."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            one = self._take(free)
        else:
            free, one = self.capacity, []
        one.append(item)
        free -= size
        if not free:
            return one
        self.by_free.setdefault(free, []).append(one)
        self.bits |= 1 << free
        self.count += 1
        return self._take((self.bits & -self.bits).bit_length() - 1) if self.count > self.limit else None

    def rest(self) -> Iterator[tuple[int, list]]:
        """(free space, bin) of all bins still open, fullest first."""
        for free in sorted(self.by_free):
            for one in self.by_free[free]:
                yield free, one


class _Sequences:
    """Rows of closed bins, sent on in batches."""

    def __init__(self, width: int, last: bool):
        # two rounds number their sequences apart
        self.number = 2 * (TaskContext.get().partitionId() << 32) + last
        self.width, self.rows = width, []

    def add(self, one: list[Piece], settled: bool) -> None:
        parts, at = [], 0
        for doc_id, piece, start, ids in one:
            n = len(ids) // self.width
            parts.append({"doc_id": doc_id, "piece": piece, "start": start, "length": n, "offset": at})
            at += n
        row = {"sequence_id": self.number, "n_tokens": at, "width": self.width, "ids": b"".join(p[3] for p in one), "parts": parts, "settled": settled}
        self.number += 2
        self.rows.append(row)

    def sent(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _first_round(batches: Iterator[pa.RecordBatch], encoder: Encoder, end_id: int, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    bins = OpenBins(capacity, open_bins)
    kind = "<u2" if max(end_id, (1 << encoder.bits) - 1) < 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    out = _Sequences(width, False)
    end = np.array([end_id], "<i4").tobytes()
    for batch in batches:
        names = batch.column(0).to_pylist()
        for part in _text.slices(batch.column(1)):
            texts = batch.column(1).slice(part.lo, part.hi - part.lo).to_pylist()
            for i, data in enumerate(encoder.encode([t or "" for t in texts])):
                ids = np.frombuffer(data + end, "<i4").astype(kind).tobytes()
                n = len(ids) // width
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    closed = bins.place(size, (names[part.lo + i], piece, start, ids[start * width : (start + size) * width]))
                    if closed:
                        out.add(closed, True)
            yield from out.sent(BATCH_ROWS)
    for free, one in bins.rest():
        out.add(one, free <= SLACK * capacity)
        yield from out.sent(BATCH_ROWS)
    yield from out.sent()


def _second_round(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    bins, out = OpenBins(capacity, open_bins), None
    for batch in batches:
        for row in batch.to_pylist():
            out = out or _Sequences(row["width"], True)
            closed = bins.place(row["length"], (row["doc_id"], row["piece"], row["start"], row["ids"]))
            if closed:
                out.add(closed, True)
                yield from out.sent(BATCH_ROWS)
    if out:
        for _, one in bins.rest():
            out.add(one, True)
            yield from out.sent(BATCH_ROWS)
        yield from out.sent()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_chunks: int = TABLE_CHUNKS,
) -> DataFrame:
    """Sequences of at most ``capacity`` ids that hold every piece of every document once."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = written(
        texts.mapInArrow(lambda batches: _first_round(batches, Encoder.load(shared.value, table_chunks), end_id, capacity, open_bins), _ROUND),
        "sequences",
    )
    left = first.where("NOT settled")
    tokens = left.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # a task's leftovers fit its open bins with room to spare, so that none closes early
    tasks = max(1, -(-2 * tokens // (open_bins * capacity)))
    pieces = left.select("width", "ids", F.explode("parts").alias("p")).select(
        "width", "p.*", F.expr("substring(ids, int(p.offset * width) + 1, int(p.length * width))").alias("ids")
    )
    again = pieces.repartition(tasks).sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids")
    placed = again.mapInArrow(lambda batches: _second_round(batches, capacity, open_bins), _ROUND)
    return first.where("settled").unionByName(placed).drop("settled")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            parts = row["parts"]
            columns = {c: [p[c] for p in parts] for c in ("doc_id", "piece", "start", "length", "offset")}
            content = [ids[p["offset"] : p["offset"] + p["length"]].tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns["doc_id"], pa.int64()),
                    pa.array(columns["piece"], pa.int32()),
                    pa.array(columns["start"], pa.int64()),
                    pa.array(columns["length"], pa.int64()),
                    pa.array(content, pa.binary()),
                    pa.array([row["sequence_id"]] * len(parts), pa.int64()),
                    pa.array(columns["offset"], pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece, its ids as little-endian unsigned 32-bit integers, and its place."""
    return sequences.select("sequence_id", "width", "ids", "parts").mapInArrow(
        _pieces, "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
    )
