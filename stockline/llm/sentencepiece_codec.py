"""SentencePiece encoding and decoding through a table of distinct chunks.

The model turns spaces into markers and puts one in front of a text.  If no
piece holds a marker after another character (checked on the vocabulary when
the model is loaded), no merge can cross the border before a run of markers, so
a text is encoded chunk by chunk (markers and what follows up to the next
marker).  Each distinct chunk is segmented once, with the library, and its ids
are joined back by position.  Decoding is the library's own, whole rows of ids
at a time: a table of chunks there took five times as long.  The table lives as long as
its task, in two generations of ``table_chunks`` / 2 chunks: when the young one is
full it becomes the old one, and an old chunk that is met again moves back, so
frequent chunks stay, memory is bounded, and no result depends on it.

Models whose normaliser rewrites characters, or whose pieces cross markers, are
refused; ``verify`` encodes test strings both ways.

Edge cases: null counts as the empty text, which has no ids and decodes to the
empty text; rows are independent, so ties and repeated rows need no rule; very
long texts are processed whole; only the id and text columns are read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_CHUNKS = 200_000
BATCH_BYTES = 1 << 19
_CHUNKS = re.compile(" +[^ ]*")
_PROBES = ("", " ", "  two  spaces ", "a\tb\nc", f"x{MARK}y {MARK} z", "café 中文 \U0001f600\u0000", "ﬁ é 　 ​")


class Table:
    """What distinct chunks came to, in two generations of bounded size."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, used: set, make) -> dict:
        """A table that holds all of ``used``; ``make`` works out a list of new ones."""
        if len(self.young) + len(used) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        absent = used - young.keys()
        known = absent & old.keys()
        young.update((c, old[c]) for c in known)
        if new := list(absent - known):
            young.update(zip(new, make(new)))
        return young

    def clear(self) -> None:
        self.young, self.old = {}, {}


class Codec:
    """One loaded model with its tables of distinct chunks.

    Ids travel as little-endian 32-bit integers, which is also Arrow's layout.
    """

    _loaded: dict[tuple[int, int], Codec] = {}

    def __init__(self, model: bytes, table_chunks: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces cross whitespace markers: chunks cannot be encoded one by one")
        self.lone = self.sp.piece_to_id(MARK)
        self.ids = Table(table_chunks // 2)
        self.verify(_PROBES)

    @classmethod
    def load(cls, model: bytes, table_chunks: int = TABLE_CHUNKS) -> Codec:
        key = (hash(model), table_chunks)
        if key not in cls._loaded:
            cls._loaded = {key: cls(model, table_chunks)}
        return cls._loaded[key]

    def verify(self, texts) -> None:
        for t in texts:
            ids = self.sp.encode(t)
            if np.frombuffer(self.encode([t])[0], "<i4").tolist() != ids or self.decode([np.array(ids, "<i4")]) != [self.sp.decode(ids)]:
                raise ValueError(f"the model does not encode chunk by chunk: {t!r}")

    def clear(self) -> None:
        """Give memory back when a task ends; its worker may stay for other work."""
        self.ids.clear()
        pa.default_memory_pool().release_unused()

    def _segment(self, chunks: list[str]) -> list[bytes]:
        # chunks come without their first marker, which the library puts in front itself
        return [array("i", ids if c else [self.lone]).tobytes() for c, ids in zip(chunks, self.sp.encode(chunks, num_threads=1))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: new chunks are segmented together, then all are joined by position."""
        chunked = []
        for text in texts:
            text = text.replace(MARK, " ")
            chunks = text.split(" ") if text else []
            if "" in chunks:  # runs of markers belong to the chunk behind them
                chunks = [c[1:] for c in _CHUNKS.findall(" " + text)]
            chunked.append(chunks)
        table = self.ids.get(set().union(*chunked), self._segment)
        return [b"".join(map(table.__getitem__, chunks)) for chunks in chunked]

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The text of each row of ids."""
        return self.sp.decode([ids.tolist() for ids in rows], num_threads=1) if rows else []


def _parts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``limit``; one row at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """doc_id and ``ids``, the text's piece ids (no begin or end id)."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(shared.value, table_chunks)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(sizes, BATCH_BYTES):
                data = codec.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                off = np.append(0, np.cumsum([len(x) // 4 for x in data])).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(data), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])
        codec.clear()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and ``decoded``, the text of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(sizes, BATCH_BYTES):
                part = batch.slice(lo, hi - lo)
                flat = part.column(1).flatten().to_numpy()
                ends = np.cumsum(sizes[lo:hi])
                texts = pa.array(codec.decode([flat[b - n : b] for b, n in zip(ends.tolist(), sizes[lo:hi].tolist())]), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """doc_id, ids and ``decoded``: ``decode(encode(docs))`` in one pass, so that ids cross to Python once."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(shared.value, table_chunks)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(sizes, BATCH_BYTES):
                data = codec.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                off = np.append(0, np.cumsum([len(x) // 4 for x in data])).astype(np.int32)
                flat = np.frombuffer(b"".join(data), "<i4")
                texts = codec.decode([flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
        codec.clear()

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
