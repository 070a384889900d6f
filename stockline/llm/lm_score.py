"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The filter is spread over the workers by ranges of the n-gram hash (buckets) and
is never gathered: lookups travel to it, in one pass over the texts.

1. Texts are dealt to groups of about ``GROUP_BYTES``.  A group sends each of its
   distinct unigrams and bigrams once, with its count in training texts (0 if it
   is found in held-out texts only), packed into one row per bucket.  So an
   n-gram that a third of all rows share is one entry per group.
2. A bucket's task adds the counts up, all of them, also of bigrams seen once
   (``MIN_BIGRAM`` is 1): the counts of v's bigrams add up to n(v), so P(. | v)
   adds up to 1.  It enters them into its segment of the filter: quantised, an
   n-gram of count c with levels 1 .. q(c), q growing with log2 of c.  Then it
   probes the segment for every n-gram that a group asks for: level 1, 2, ...
   until one is missing; the answer is the last level found, one byte an n-gram,
   in the order of the question.  All four bits of an entry lie in one 64-bit
   word.  Tokens get their exact training count beside it.
3. Answers return to their groups, where each text's terms are added up:

    P(t | v) = (n(v t) + MU * P1(t)) / (n(v) + MU)

n(v t) and n(v) are the middles of the levels found; P1(t), like the base score,
is the smoothed unigram estimate from exact counts.  Every bucket answers every
group with its own number of tokens and of types, so a group has both totals
without a pass of their own.

Memory: a task holds one group's distinct n-grams or one bucket's, both bounded
by the two sizes above; the number of groups and buckets grows with the corpus.
Rows equal in id and text are dealt apart by the partition they are read in.

Edge cases: a null text is empty and holds the end token alone; a null id is a
training text; with no training text at all every count is 0; repeated rows are
scored and counted as often as they are listed; texts are read whole; an empty
table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm import _text
from stockline.llm._anchored import groups

FOLDS, HELD_OUT = 5, 1
MIN_BIGRAM = 1
MU = 1000.0
BITS_PER_ENTRY = 12
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
END = np.uint64(0x5BD1E995A1B2C3D4 & ~1)
BEGIN = np.uint64(0x27D4EB2F16567890 & ~1)
_ONE = np.uint64(1)

Arrow = Iterator[pa.RecordBatch]


def tokens(part: _text.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys (even) with an end token behind each text, each one's predecessor, and where texts begin."""
    buf = _text.LOWER[part.buf]
    s, e, first = _text.spans(buf, part.off, _text.NOT_SPACE)
    n = part.hi - part.lo
    begin = first + np.arange(n + 1)
    out = np.full(len(s) + n, END, np.uint64)
    out[np.arange(len(s)) + np.repeat(np.arange(n), np.diff(first))] = _text.word_hashes(buf, s, e) & ~_ONE
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[begin[:-1]] = BEGIN
    return out, before, begin


def bigrams(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys (odd) of pairs of tokens."""
    return _text.mix(before * np.uint64(_text._P) + _text.mix(token)) | _ONE


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: upper planes are zeros that compress away."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


class _Group:
    """The tokens and distinct n-grams of one group's texts."""

    def __init__(self, texts: pa.ChunkedArray):
        parts = [tokens(p) for p in _text.slices(texts.combine_chunks())]
        sizes = [len(p[0]) for p in parts]
        at = np.cumsum([0, *sizes[:-1]])
        self.token, self.before = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        #: Where each text's tokens begin; every text has its end token at least.
        self.begin = np.concatenate([p[2][:-1] + a for p, a in zip(parts, at)])
        asked = np.concatenate((self.token, bigrams(self.before, self.token), [BEGIN]))
        #: Distinct keys in order; the place of each token, of each pair, and of BEGIN among them.
        self.keys, back = np.unique(asked, return_inverse=True)
        n = len(self.token)
        self.of_token, self.of_pair, of_begin = back[:n], back[n : 2 * n], back[-1]
        self.of_before = np.empty(n, back.dtype)
        self.of_before[1:] = self.of_token[:-1]
        self.of_before[self.begin] = of_begin

    def counts(self, trained: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts that ``trained`` marks."""
        size = np.diff(np.append(self.begin, len(self.token)))
        own = np.repeat(trained, size)
        n = np.bincount(self.of_token[own], minlength=len(self.keys)) + np.bincount(self.of_pair[own], minlength=len(self.keys))
        n[np.searchsorted(self.keys, BEGIN)] += int(trained.sum())
        return n


def _cuts(keys: np.ndarray, log_buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted keys; one entry more than buckets."""
    if not log_buckets:
        return np.array([0, len(keys)])
    edges = np.arange(1 << log_buckets, dtype=np.uint64) << np.uint64(64 - log_buckets)
    return np.append(np.searchsorted(keys, edges), len(keys))


_ASKED = "bucket int, group bigint, keys binary, counts binary"


def _questions(table: pa.Table, log_buckets: int) -> pa.Table:
    """Rows (bucket, group, keys, counts) of one group, for every bucket."""
    group = _Group(table.column("text"))
    counts = group.counts(~table.column("held_out").to_numpy()).astype("<u4")
    cuts = _cuts(group.keys, log_buckets).tolist()
    pairs = list(zip(cuts, cuts[1:]))
    return pa.table(
        {
            "bucket": pa.array(range(len(pairs)), pa.int32()),
            "group": pa.array([table.column("group")[0].as_py()] * len(pairs), pa.int64()),
            "keys": pa.array([_pack(group.keys[a:b]) for a, b in pairs], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in pairs], pa.binary()),
        }
    )


def level(counts: np.ndarray, least: int) -> np.ndarray:
    """Quantised count: 1 for least .. 2 * least - 1, 2 for the next doubling, and so on."""
    return (np.floor(np.log2(counts / least)) + 1).astype(np.uint8)


def middle(levels: np.ndarray, least: int) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    low = least * 2.0 ** (levels.astype(np.float64) - 1)
    return np.where(levels > 0, (3 * low - 1) / 2, 0.0)


class Filter:
    """A segment of the filter: the quantised counts of one bucket's n-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY):
        pair = (keys & _ONE).astype(bool)
        own = counts >= np.where(pair, MIN_BIGRAM, 1)
        keys, pair = keys[own], pair[own]
        levels = np.where(pair, level(counts[own], MIN_BIGRAM), level(counts[own], 1))
        self.table = np.zeros(max(1, -(-int(levels.sum(dtype=np.int64)) * bits_per_entry // 64)), np.uint64)
        for lev in range(1, int(levels.max(initial=0)) + 1):
            word, mask = self._place(keys[levels >= lev], lev)
            np.bitwise_or.at(self.table, word, mask)

    def _place(self, keys: np.ndarray, lev: int) -> tuple[np.ndarray, np.ndarray]:
        """Word and bit mask of an entry (key, level)."""
        h = _text.mix(keys + np.uint64((lev * 0xA24BAED4963EE407) & 0xFFFFFFFFFFFFFFFF))
        word = ((h >> np.uint64(32)) * np.uint64(len(self.table))) >> np.uint64(32)
        six = np.uint64(63)
        mask = _ONE << (h & six) | _ONE << ((h >> np.uint64(6)) & six) | _ONE << ((h >> np.uint64(12)) & six) | _ONE << ((h >> np.uint64(18)) & six)
        return word.astype(np.int64), mask

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which every level is a member."""
        out = np.zeros(len(keys), np.uint8)
        live = np.arange(len(keys))
        lev = 0
        while len(live) and lev < 255:
            lev += 1
            word, mask = self._place(keys[live], lev)
            live = live[(self.table[word] & mask) == mask]
            out[live] = lev
        return out


_ANSWERED = "group bigint, bucket int, levels binary, counts binary, total bigint, types bigint"


def _answers(batches: Arrow, bits_per_entry: int) -> Arrow:
    """Per question: levels from the bucket's segment, exact counts of tokens, and the bucket's totals."""
    for batch in groups(batches, "bucket"):
        bucket = batch.column("bucket").to_numpy()
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        for lo, hi in zip(cut, [*cut[1:], len(bucket)]):
            asked = [_unpack(x.as_buffer()) for x in batch.column("keys").slice(lo, hi - lo)]
            seen = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("counts").slice(lo, hi - lo)]
            keys, back = np.unique(np.concatenate(asked), return_inverse=True)
            n = np.bincount(back, np.concatenate(seen), len(keys)).astype(np.int64)
            levels = Filter(keys, n, bits_per_entry).levels(keys)
            token = (keys & _ONE == 0) & (keys != BEGIN)
            ends = np.cumsum([len(x) for x in asked]).tolist()
            own = [back[a:b] for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("group").slice(lo, hi - lo),
                    pa.array([int(bucket[lo])] * len(own), pa.int32()),
                    pa.array([levels[x].tobytes() for x in own], pa.binary()),
                    pa.array([n[x][(k & _ONE) == 0].astype("<i8").tobytes() for x, k in zip(own, asked)], pa.binary()),
                    pa.array([int(n[token].sum())] * len(own), pa.int64()),
                    pa.array([int((n[token] > 0).sum())] * len(own), pa.int64()),
                ],
                ["group", "bucket", "levels", "counts", "total", "types"],
            )


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The scores of one group's texts from the answers of all buckets."""
    answers = answers.sort_by("bucket")
    group = _Group(table.column("text"))
    joined = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in answers.column(name)])
    levels, counts = joined("levels", np.uint8), joined("counts", "<i8")
    token = (group.keys & _ONE) == 0
    if len(levels) != len(group.keys) or len(counts) != int(token.sum()):
        raise ValueError("the texts of a group have changed between question and answer")
    exact = np.zeros(len(levels), np.int64)
    exact[token] = counts
    total, types = (sum(answers.column(c).to_pylist()) for c in ("total", "types"))
    scale = total + 0.5 * (types + 1)
    n = np.where(token, middle(levels, 1), middle(levels, MIN_BIGRAM))
    c = exact[group.of_token]
    p1 = (c + 0.5) / scale
    terms = np.log10(n[group.of_pair] + MU * p1) - np.log10(n[group.of_before] + MU)
    texts = table.num_rows
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "held_out": table.column("held_out"),
            "n_tokens": np.diff(np.append(group.begin, len(c))),
            "n_known": np.add.reduceat((c > 0).astype(np.int64), group.begin),
            "train_tokens": np.full(texts, total, np.int64),
            "base_score": np.add.reduceat(np.log10(p1), group.begin),
            "score": np.add.reduceat(terms, group.begin),
        }
    )


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int = GROUP_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    bits_per_entry: int = BITS_PER_ENTRY,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    The model is trained on the texts whose crc32(id as text) mod FOLDS is not HELD_OUT.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    n_groups = max(1, -(-size // group_bytes))
    log_buckets = max(0, -(-size // bucket_bytes) - 1).bit_length()
    group = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_groups))
    texts = texts.select(group.alias("group"), "doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "text")
    asked = texts.groupBy("group").applyInArrow(lambda table: _questions(table, log_buckets), _ASKED)
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    answered = dealt.mapInArrow(lambda batches: _answers(batches, bits_per_entry), _ANSWERED)
    return texts.groupBy("group").cogroup(answered.groupBy("group")).applyInArrow(_scores, _SCORED)
