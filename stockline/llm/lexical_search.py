"""Ranked lexical search over whole tables with hashed max-sketches and exact scores.

A term's share in a document's score is w * impact: w depends on how many
documents hold the term, the impact on the term's occurrences and the document's
length.  The impact grows with the occurrences, so a document's sketch keeps, in
each hashed coordinate, the maximum over the terms that fall there (a one-byte
code of the occurrences, rounded up).  It does so under ``HASHES`` hash
functions, each with ``SLOTS`` to 2 * ``SLOTS`` coordinates per distinct term (and
2**``LEAST_LOG_SLOTS`` at least); a lookup takes the least of a term's maxima,
which another term raises only by falling together with it under all of them.
A sketch is stored as a bitmap of the coordinates in use and their codes.

1. One pass over the texts writes the sketches, each under the SHA-256 of its
   text, with the number of documents and terms and, for the terms of the
   queries, of documents that hold them (exact: terms are compared as bytes).
2. A pass over the sketches looks all query terms up in all sketches of a block
   at once: the sum of w * impact is an upper bound of each score.  The ``k``
   highest bounds of each query are rescored exactly from their texts; their
   k-th score is the query's threshold.
3. A second pass over the sketches keeps the documents whose bound reaches a
   threshold; these alone are rescored from their texts, in order of descending
   bound until the bound falls below the k-th score so far, and the k best of
   each task that reach the threshold are ranked.  Up to ``BROADCAST_TEXTS`` of
   them are counted and broadcast, so that no text is shuffled; beyond that the
   texts are joined with them.

No document that reaches the ranking is left out: a bound is never below the
score, and equal texts have one sketch and one score, whatever their number.
Queries run in blocks of ``BLOCK_QUERIES`` items or ``BLOCK_CHARS`` characters
(one longer item is a block), all documents against each block; a block's terms
and weights are what is broadcast.  What a task holds or sends on is k rows a
query, never all candidates of a query.

Edge cases: a null or empty document has no term, is not counted, and is never
listed; a null or empty item lists nothing; rows that share an id, and repeated
rows, are documents of their own; null ids come first among equal scores; items
that share an id are queries of their own; texts are read whole; an empty table
on either side gives no rows; only id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappushpop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockline.llm import _text
from stockline.llm._store import written

K = 50
HASHES = 4
SLOTS = 8
LEAST_LOG_SLOTS = 8
BLOCK_QUERIES = 1024
BLOCK_CHARS = 16 << 20
#: Texts to be rescored that are broadcast (their digests); more are joined by digest.
BROADCAST_TEXTS = 200_000
#: Documents whose bounds are computed at once.
ROWS = 128
#: Cells of one lookup (documents x query terms).
CELLS = 1 << 21

#: Bytes that are no part of a term become spaces, A-Z become lower case.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: The occurrences that a code stands for, rounded up: exact to 128, then four steps a doubling.
_OCCURRENCES = np.array([*range(129), *(math.ceil(128 * 2 ** (i / 4)) for i in range(1, 97))], np.float64)

#: Odd multipliers; a coordinate is the upper bits of a 32-bit product.
_HASH = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)[:HASHES]

Arrow = Iterator[pa.RecordBatch]


def slots(hashes: np.ndarray, log_slots: np.ndarray | int) -> np.ndarray:
    """Coordinate of each term under each hash function (a row each), inside the sketch."""
    # every function has coordinates of its own, one after the other
    own = (_HASH[:, None] * hashes.astype(np.uint32)) >> (32 - np.asarray(log_slots)).astype(np.uint32)
    return own.astype(np.int64) + (np.arange(HASHES)[:, None] << np.asarray(log_slots))


def terms(text: bytes) -> list[bytes]:
    """The lower-cased terms of a text, repeats included."""
    return text.translate(_TABLE).split()


def impact(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def length_norm(n, documents: int, total: int):
    """m of a document of n terms among ``documents`` with ``total`` terms."""
    return 50 + 50 * n * documents // total


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


_INDEX = "keys array<binary>, n array<bigint>, log_slots binary, used binary, codes binary, documents bigint, total bigint, term array<int>, holding array<bigint>"
_INDEX_ARROW = pa.schema(
    [
        ("keys", pa.list_(pa.binary())),
        ("n", pa.list_(pa.int64())),
        ("log_slots", pa.binary()),
        ("used", pa.binary()),
        ("codes", pa.binary()),
        ("documents", pa.int64()),
        ("total", pa.int64()),
        ("term", pa.list_(pa.int32())),
        ("holding", pa.list_(pa.int64())),
    ]
)


def _sketched(batches: Arrow, vocabulary: dict[bytes, int]) -> Arrow:
    """One row of sketches per slice of texts, and one row of counts per task."""
    documents = total = 0
    holding: Counter[bytes] = Counter()
    wanted = vocabulary.keys()
    for batch in batches:
        for part in _text.slices(batch.column(0)):
            data, cuts = part.buf.tobytes(), part.off.tolist()
            keys, sizes, counted = [], [], []
            for a, b in zip(cuts, cuts[1:]):
                found = terms(data[a:b])
                if found:
                    tf = Counter(found)
                    holding.update(wanted & tf.keys())
                    keys.append(hashlib.sha256(data[a:b]).digest())
                    sizes.append(len(found))
                    counted.append(tf)
            if not keys:
                continue
            documents += len(keys)
            total += sum(sizes)
            distinct = np.array([len(tf) for tf in counted])
            log_slots = np.maximum(np.ceil(np.log2(SLOTS * distinct)), LEAST_LOG_SLOTS).astype(np.int64)
            ends = np.cumsum(HASHES << log_slots)
            h = np.fromiter(map(crc32, chain.from_iterable(counted)), np.uint32, int(distinct.sum()))
            tf = np.fromiter(chain.from_iterable(c.values() for c in counted), np.int64, len(h))
            code = np.searchsorted(_OCCURRENCES, tf).astype(np.uint8)
            codes = np.zeros(int(ends[-1]), np.uint8)
            for at in slots(h, np.repeat(log_slots, distinct)) + np.repeat(ends - (HASHES << log_slots), distinct):
                np.maximum.at(codes, at, code)
            used = np.packbits(codes > 0)  # a sketch is a whole number of bytes
            row = {"keys": keys, "n": sizes, "log_slots": log_slots.astype(np.uint8).tobytes(), "used": used.tobytes(), "codes": codes[codes > 0].tobytes()}
            yield pa.RecordBatch.from_pylist([row], _INDEX_ARROW)
    if documents:
        row = {"documents": documents, "total": total, "term": [vocabulary[t] for t in holding], "holding": list(holding.values())}
        yield pa.RecordBatch.from_pylist([row], _INDEX_ARROW)


class Queries:
    """A block of queries: their items, terms and weights, and all lookups of theirs."""

    def __init__(self, items: list, queries: list[list[bytes]], vocabulary: dict[bytes, int], index: DataFrame):
        sums = index.agg(F.sum("documents").alias("documents"), F.sum("total").alias("total")).first()
        self.items, self.documents, self.total = items, sums["documents"] or 0, sums["total"] or 0
        counts = index.select(F.explode(F.arrays_zip("term", "holding")).alias("x")).groupBy("x.term").agg(F.sum("x.holding").alias("n"))
        holding = {r["term"]: r["n"] for r in counts.collect()}  # a number per term of the block
        # a term that no document holds adds nothing
        self.weights = [{t: weight(self.documents, holding[vocabulary[t]]) for t in q if vocabulary[t] in holding} for q in queries]
        lookups = [(i, t, w) for i, own in enumerate(self.weights) for t, w in own.items()]
        known = sorted({t for _, t, _ in lookups})
        column = {t: i for i, t in enumerate(known)}
        #: Hash of each distinct term; per lookup its column and weight, lookups of a query together.
        self.hashes = np.array([crc32(t) for t in known], np.uint32)
        self.columns = np.array([column[t] for _, t, _ in lookups], np.int64)
        self.w = np.array([w for _, _, w in lookups], np.float32)
        #: Queries with a lookup, and where their lookups begin.
        self.asked = np.array(sorted({i for i, _, _ in lookups}), np.int64)
        self.begin = np.searchsorted(np.array([i for i, _, _ in lookups]), self.asked)

    def norm(self, n):
        return length_norm(n, self.documents, self.total)

    def bounds(self, n: np.ndarray, log_slots: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, bounds of rows x asked queries) of all sketches of a block, few rows at a time."""
        begin = np.cumsum(HASHES << log_slots) - (HASHES << log_slots)
        step = max(1, min(ROWS, CELLS // max(1, len(self.columns))))
        for size in np.unique(log_slots).tolist():
            own = np.flatnonzero(log_slots == size)
            places = slots(self.hashes, size)
            for lo in range(0, len(own), step):
                rows = own[lo : lo + step]
                code = codes[begin[rows, None] + places[0]]
                for other in places[1:]:
                    np.minimum(code, codes[begin[rows, None] + other], out=code)
                tf = _OCCURRENCES[code]
                share = (1e6 * tf / (tf + 0.02 * self.norm(n[rows])[:, None])).astype(np.float32)
                sums = np.add.reduceat(share[:, self.columns] * self.w, self.begin, axis=1, dtype=np.float64)
                yield rows, sums * (1 + 1e-6)  # above what single precision may lose

    def score(self, query: int, tf: dict[bytes, int], m: int) -> int:
        own = self.weights[query]
        return sum(own[t] * impact(tf[t], m) for t in own.keys() & tf.keys())


def _blocks(batches: Arrow, queries: Queries) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(keys, rows, bounds) of the sketches of a task."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = batch.column("keys")[i].as_py()
            n = batch.column("n")[i].values.to_numpy()
            log_slots = np.frombuffer(batch.column("log_slots")[i].as_buffer(), np.uint8).astype(np.int64)
            used = np.unpackbits(np.frombuffer(batch.column("used")[i].as_buffer(), np.uint8)).view(bool)
            codes = np.zeros(len(used), np.uint8)
            codes[used] = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint8)
            for rows, bounds in queries.bounds(n, log_slots, codes):
                yield keys, rows, bounds


_BOUND = "query int, key binary, bound double"


def _highest(batches: Arrow, queries: Queries, k: int) -> Arrow:
    """The k highest bounds of each query among the distinct texts of a task."""
    best: list[dict[bytes, float]] = [{} for _ in queries.asked]
    least = np.zeros(len(queries.asked))
    for keys, rows, bounds in _blocks(batches, queries):
        for row, q in zip(*(x.tolist() for x in np.nonzero(bounds > least))):
            own = best[q]
            own[keys[rows[row]]] = bounds[row, q]
            if len(own) >= 2 * k:
                best[q] = own = dict(sorted(own.items(), key=lambda x: -x[1])[:k])
                least[q] = min(own.values())
    for q, own in zip(queries.asked.tolist(), best):
        top = sorted(own.items(), key=lambda x: -x[1])[:k]
        if top:
            yield pa.RecordBatch.from_arrays(
                [pa.array([q] * len(top), pa.int32()), pa.array([x[0] for x in top], pa.binary()), pa.array([x[1] for x in top])],
                ["query", "key", "bound"],
            )


_ASKED = "key binary, queries array<int>, bounds array<double>"


def _reaching(batches: Arrow, queries: Queries, thresholds: np.ndarray) -> Arrow:
    """Every text with a bound that reaches its query's threshold, with those queries."""
    least = thresholds[queries.asked]
    for keys, rows, bounds in _blocks(batches, queries):
        hit = bounds >= least
        out = [(keys[rows[i]], queries.asked[hit[i]].tolist(), bounds[i][hit[i]].tolist()) for i in np.flatnonzero(hit.any(axis=1)).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                ["key", "queries", "bounds"],
            )


_SCORED = "query int, doc_id bigint, score bigint"


def _rescored(batches: Arrow, queries: Queries, thresholds: np.ndarray, k: int) -> Arrow:
    """The k best (score, smaller id) of each query among a task's texts, exact, from the threshold on."""
    best: dict[int, list[tuple[int, float]]] = {}
    nothing = float("inf")  # a null id comes first
    for batch in batches:
        for part in _text.slices(batch.column("text")):
            ids = batch.column("doc_id").slice(part.lo, part.hi - part.lo).to_pylist()
            asked = batch.column("queries").slice(part.lo, part.hi - part.lo).to_pylist()
            bounds = batch.column("bounds").slice(part.lo, part.hi - part.lo).to_pylist()
            data, cuts = part.buf.tobytes(), part.off.tolist()
            held: dict[int, tuple[Counter, int]] = {}
            pairs = [(bound, i, q) for i in range(len(ids)) for bound, q in zip(bounds[i], asked[i])]
            for bound, i, q in sorted(pairs, reverse=True):
                own = best.setdefault(q, [])
                if len(own) == k and bound < own[0][0]:
                    continue  # and so for the query's other texts of this slice
                if i not in held:
                    found = terms(data[cuts[i] : cuts[i + 1]])
                    held[i] = Counter(found), queries.norm(len(found))
                score = queries.score(q, *held[i])
                if score >= thresholds[q]:
                    one = score, nothing if ids[i] is None else -ids[i]
                    if len(own) < k:
                        heappush(own, one)
                    else:
                        heappushpop(own, one)
    for q, own in best.items():
        if own:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q] * len(own), pa.int32()),
                    pa.array([None if x[1] == nothing else -x[1] for x in own], pa.int64()),
                    pa.array([x[0] for x in own], pa.int64()),
                ],
                ["query", "doc_id", "score"],
            )


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(texts: DataFrame, items: list, queries: list[list[bytes]], k: int) -> DataFrame | None:
    """The ranking of one block of queries: item (its number), rank, doc_id, score."""
    spark = texts.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(queries))))}
    shared = spark.sparkContext.broadcast(vocabulary)
    index = written(texts.select("text").mapInArrow(lambda batches: _sketched(batches, shared.value), _INDEX), "sketches")
    block = Queries(items, queries, vocabulary, index.where("documents IS NOT NULL"))
    if not len(block.asked):
        return None
    known = spark.sparkContext.broadcast(block)
    sketches = index.where("keys IS NOT NULL").select("keys", "n", "log_slots", "used", "codes")
    named = texts.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("key"))
    thresholds = np.ones(len(items), np.int64)  # only scores above 0 count

    def rescored(asked: DataFrame) -> DataFrame:
        found = named.join(asked, "key").select("doc_id", "text", "queries", "bounds")
        least = thresholds.copy()
        return _ranked(found.mapInArrow(lambda batches: _rescored(batches, known.value, least, k), _SCORED), k)

    # a text may be among the highest of several tasks
    bounds = sketches.mapInArrow(lambda batches: _highest(batches, known.value, k), _BOUND).groupBy("query", "key").agg(F.max("bound").alias("bound"))
    order = Window.partitionBy("query").orderBy(F.col("bound").desc(), "key")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    asked = first.groupBy("key").agg(F.collect_list(F.struct("query", "bound")).alias("x"))  # a row per query at most
    asked = asked.select("key", F.col("x.query").alias("queries"), F.col("x.bound").alias("bounds"))
    # k texts a query at most: fit to broadcast
    for row in rescored(F.broadcast(asked)).where(F.col("rank") == k).select("query", "score").collect():  # a number per query
        thresholds[row["query"]] = row["score"]

    least = thresholds.copy()
    reaching = sketches.mapInArrow(lambda batches: _reaching(batches, known.value, least), _ASKED)
    reaching = written(reaching.dropDuplicates(["key"]), "reaching")
    return rescored(F.broadcast(reaching) if reaching.count() <= BROADCAST_TEXTS else reaching)


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest scores above 0 of every item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-size["n"] // block_queries), -(-size["chars"] // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        queries = [sorted(set(terms(r["text"].encode()))) for r in own]
        ranked = _block(texts, own, queries, k) if own else None
        if ranked is None:
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"query int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        one = ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        one = written(one, "ranking") if blocks > 1 else one
        out = one if out is None else out.unionByName(one)
    if out is None:
        kind = asked.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out
