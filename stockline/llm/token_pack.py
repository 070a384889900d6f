"""Token ids in a fixed-width bit-packed binary format with block offsets.

Texts are dealt to shards by ranges of their id and sorted in each, tokenised
once, and written as blocks.  A block is one row of a Parquet table (any store
that Spark writes to will do): shard, block number, ``start`` (ids before it in
the shard), ``n_tokens``, the ids and lengths of its texts, ``bits`` and
``payload``.  In the payload every id takes ``bits`` bits, the fewest that hold
the vocabulary; 64 ids fill ``bits`` little-endian 64-bit words, so any group
of 64 is found by arithmetic and unpacked with numpy shifts, no loop over ids.
A block holds whole texts, ``BLOCK_TOKENS`` ids or one longer text.  The shards'
lengths (one number each) give every block its global offset.

White space ends tokens in the tokenizer used here, so each distinct
white-space-delimited chunk is tokenised once and its ids are joined back by
position.  A new chunk of printable Latin-1 characters is cut into the
tokenizer's pre-tokens, and the library's model segments each distinct one; any
other chunk goes through the whole tokenizer.  ``verify`` compares test strings
with the library's own result and refuses tokenizers that work otherwise.

Edge cases: null texts are empty and hold the end id alone; null ids come first;
rows that share an id are ordered by text, so equal rows are interchangeable;
an empty table writes no block; only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockline.llm import _text

BLOCK_TOKENS = 1 << 16
TABLE_CHUNKS = 300_000
GROUP = 64
SCHEMA = (
    "shard int, block int, start bigint, n_tokens bigint, ids array<bigint>, lengths array<bigint>, bits int, payload binary"
)
_SPACES = "\t\n\x0b\x0c\r"
#: The tokenizer's pre-tokens among lower-cased printable Latin-1 characters (where NFC changes nothing).
_PRE_TOKEN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+"
)
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
#: The byte-level symbols of a pre-token's bytes: printable Latin-1 as itself, the others from U+0100 on.
_AS_ITSELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SYMBOLS = {b: 0x100 + i for i, b in enumerate(sorted({*range(256)} - _AS_ITSELF))}
_PROBES = ("", "  A b\tC\r\nd ", "don't it's x'LL", "é ́x Å", "a b　c d\x85e\x1cf", "<|endoftext|>x <|startoftext|> y", "中文 \U0001f600!?", "1 22 333 ΣΣ İ", "Ünï-Çødé÷x, 'TIS ½x²! it'S_x")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each; padded with zeros to a whole group of 64."""
    rows = -(-len(ids) // GROUP)
    grid = np.zeros(rows * GROUP, np.uint64)
    grid[: len(ids)] = ids
    grid = grid.reshape(rows, GROUP)
    out = np.zeros((rows, bits), np.uint64)
    for j in range(GROUP):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= grid[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count of a payload; only their groups are touched."""
    lo, hi = start // GROUP, -(-(start + count) // GROUP)
    words = np.frombuffer(payload, "<u8", (hi - lo) * bits, lo * bits * 8).reshape(hi - lo, bits)
    out = np.empty((hi - lo, GROUP), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(GROUP):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)[start - lo * GROUP : start - lo * GROUP + count]


class _Table(dict):
    """Ids of distinct strings; a missing one is made once."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        self[key] = made = self.make(key)
        return made

    def trim(self, limit: int) -> None:
        """Empty a table that has outgrown its bound; what is needed is made again."""
        if len(self) > limit:
            self.clear()


class Encoder:
    """One loaded tokenizer with its tables of distinct chunks and pre-tokens."""

    _loaded: dict[tuple[int, int], Encoder] = {}

    def __init__(self, model: str, table_chunks: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.model = self.tokenizer.model
        self.limit = table_chunks
        self.chunks, self.pieces = _Table(self._chunk), _Table(self._piece)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.verify(_PROBES)

    @classmethod
    def load(cls, model: str, table_chunks: int = TABLE_CHUNKS) -> Encoder:
        key = (hash(model), table_chunks)
        if key not in cls._loaded:
            cls._loaded = {key: cls(model, table_chunks)}
        return cls._loaded[key]

    def verify(self, texts) -> None:
        for t in texts:
            if np.frombuffer(self.encode([t])[0], "<i4").tolist() != self.tokenizer.encode(t, add_special_tokens=False).ids:
                raise ValueError(f"the tokenizer does not encode chunk by chunk: {t!r}")

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SYMBOLS)
        return array("i", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of one white-space-delimited chunk."""
        if chunk.isascii() and chunk.isalpha():  # one pre-token
            return self.pieces[chunk.lower()]
        if not chunk.isascii() and _BEYOND_LATIN.search(chunk) or not chunk.isprintable() or "<|" in chunk:
            return array("i", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        low = chunk.lower()
        if low.isalpha():
            return self.pieces[low]
        return b"".join(map(self.pieces.__getitem__, _PRE_TOKEN.findall(low)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        self.chunks.trim(self.limit)
        self.pieces.trim(2 * self.limit)
        out, of = [], self.chunks.__getitem__
        for text in texts:
            # lower case is chunk by chunk among Latin-1 characters, and chunks that differ in case alone are one
            if "<|" not in text and (text.isascii() or not _BEYOND_LATIN.search(text)):
                text = text.lower()
            for c in _SPACES:
                text = text.replace(c, " ")
            out.append(b"".join(map(of, text.split(" "))))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], encoder: Encoder, end_id: int) -> Iterator[pa.RecordBatch]:
    shard, block, start = TaskContext.get().partitionId(), 0, 0
    ids: list[int | None] = []
    parts: list[np.ndarray] = []
    held = 0
    end = np.array([end_id], "<i4").tobytes()

    def flush():
        nonlocal block, start, held
        flat = np.concatenate(parts)
        lengths = [len(p) for p in parts]
        row = {"shard": shard, "block": block, "start": start, "n_tokens": held, "ids": list(ids), "lengths": lengths, "bits": encoder.bits, "payload": pack(flat, encoder.bits)}
        block, start, held = block + 1, start + held, 0
        ids.clear()
        parts.clear()
        return pa.RecordBatch.from_pylist([row], _ARROW)

    for batch in batches:
        names = batch.column(0).to_pylist()
        for part in _text.slices(batch.column(1)):
            texts = batch.column(1).slice(part.lo, part.hi - part.lo).to_pylist()
            for i, data in enumerate(encoder.encode([t or "" for t in texts])):
                one = np.frombuffer(data + end, "<i4")
                if held and held + len(one) > BLOCK_TOKENS:
                    yield flush()
                ids.append(names[part.lo + i])
                parts.append(one)
                held += len(one)
    if held:
        yield flush()


_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("bits", pa.int32()),
        ("payload", pa.binary()),
    ]
)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", table_chunks: int = TABLE_CHUNKS) -> None:
    """Write the ids of every text, its end id behind it, in ascending id order."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(lambda batches: _blocks(batches, Encoder.load(shared.value, table_chunks), end_id), SCHEMA).write.option(
        "compression", "uncompressed"
    ).parquet(out)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start`` as a global offset.

    The lengths of shards (one row per written shard, so their number is that of
    the writing tasks) are summed up in order and broadcast.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ``ids``, little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = unpack(row["payload"], row["bits"], 0, row["n_tokens"]).astype("<u4")
                n = np.array(row["lengths"], np.int64)
                ends = np.append(0, np.cumsum(n))
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(flat)])
                columns = [pa.array(row["ids"], pa.int64()), pa.array(row["start"] + ends[:-1]), pa.array(n), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    rows = read_blocks(spark, path).select("start", "n_tokens", "ids", "lengths", "bits", "payload")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count of the whole table, from the blocks that hold them."""
    wanted = read_blocks(spark, path).where((F.col("start") < start + count) & (F.col("start") + F.col("n_tokens") > start))
    out = []
    for row in sorted(wanted.select("start", "n_tokens", "bits", "payload").collect(), key=lambda r: r["start"]):
        lo = max(start - row["start"], 0)
        hi = min(start + count - row["start"], row["n_tokens"])
        out.append(unpack(bytes(row["payload"]), row["bits"], lo, hi - lo))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
