"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (character classes, word and line repetition, lengths)
are computed batch by batch over the Arrow buffer.  The trees are fitted on the
driver on a bounded sample of labelled rows (``TRAIN_ROWS``, those with the
smallest hash of their id): every statistic is cut into at most ``BINS``
quantile bins, and a level of a tree is grown from one histogram of gradients
per (node, statistic, bin).  The fitted forest is a handful of flat arrays
(statistic, threshold, children, value); scoring walks all rows down a tree
together with numpy indexing.  Only the arrays are broadcast (their size is set
by TREES and DEPTH, not by the data), and scoring needs no shuffle.

Labels come only from rows whose crc32(id as text) mod FOLDS is not HELD_OUT;
ids, labels, language and source are no inputs of a score.

Edge cases: a null text counts as empty, and an empty text has a score like any
other; a null id is not held out; several labels of one id count as the largest;
without labels, or with labels of one class only, every score is the smoothed
share of label 1; repeated rows are scored alike; only the id and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.llm import _text

TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
TREES, DEPTH, BINS = 100, 4, 64
RATE, L2, MIN_HESSIAN = 0.15, 1.0, 2.0

Arrow = Iterator[pa.RecordBatch]

_CLASSES = ("space", "newline", "lower", "upper", "digit", "stop", "comma", "shout", "pipe", "symbol", "other_ascii", "non_ascii")
_CLASS = np.full(256, 10, np.int64)
_CLASS[[0x20, 9, 11, 12, 13]] = 0
_CLASS[10] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
for _chars, _code in ((".?", 5), (",;:", 6), ("!", 7), ("|", 8), ("#*$%&<>@=+^~_\\/{}[]", 9)):
    _CLASS[list(_chars.encode())] = _code
_CLASS[128:] = 11
_WIDTH = 16

STATISTICS = (
    *(f"{c} per byte" for c in _CLASSES),
    "log bytes", "log words", "log lines", "bytes per word", "longest word", "words per line",
    "distinct words", "top word share", "equal neighbours", "repeated 3-grams", "distinct lines", "repeated line words",
    "shouts per word", "pipes per word", "symbols per word",
)


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest repetition of one, per text."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    if not len(v):
        return np.zeros(n), np.zeros(n)
    begin = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])))
    size = np.diff(np.append(begin, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, t[begin], size)
    return np.bincount(t[begin], minlength=n).astype(float), top


def statistics(part: _text.Slice) -> np.ndarray:
    """One row of STATISTICS per text of a slice."""
    n = part.hi - part.lo
    size = np.diff(part.off).astype(float)
    text = np.repeat(np.arange(n) * _WIDTH, np.diff(part.off))
    classes = np.bincount(text + _CLASS[part.buf], minlength=n * _WIDTH).reshape(n, _WIDTH)[:, : len(_CLASSES)].astype(float)
    s, e, first = _text.spans(part.buf, part.off, _text.NOT_SPACE)
    sums = _text.prefix(part.buf.astype(np.uint64) + np.uint64(1))
    word = _text.ranges(sums, s, e)
    words = np.diff(first).astype(float)
    longest = np.zeros(n)
    owner = np.repeat(np.arange(n), np.diff(first))
    np.maximum.at(longest, owner, e - s)
    distinct, top = _distinct(word, first)
    same = np.bincount(owner[1:][(word[1:] == word[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(word) else np.zeros(n)
    ok = np.flatnonzero(_text.starts_within(first, 3, len(word)))
    gram = _text.grams(word, 3)[ok] if len(ok) else np.zeros(0, np.uint64)
    at = np.searchsorted(ok, first)
    different, _ = _distinct(gram, at)
    grams = np.diff(at).astype(float)
    not_line = np.ones(256, bool)
    not_line[10] = False
    ls, le, lfirst = _text.spans(part.buf, part.off, not_line)
    lines = np.diff(lfirst).astype(float)
    line_kinds, top_line = _distinct(_text.ranges(sums, ls, le), lfirst)
    d = lambda a, b: a / np.maximum(b, 1.0)
    return np.column_stack(
        [
            *(d(classes[:, k], size) for k in range(len(_CLASSES))),
            np.log1p(size), np.log1p(words), np.log1p(lines), d(size - classes[:, 0] - classes[:, 1], words), longest, d(words, lines),
            d(distinct, words), d(top, words), d(same, words), d(grams - different, grams), d(line_kinds, lines), d(top_line, lines),
            d(classes[:, 7], words), d(classes[:, 8], words), d(classes[:, 9], words),
        ]
    )


@dataclass
class Forest:
    """All trees end to end: at a node with left child < 0 the value counts."""

    prior: float
    roots: np.ndarray
    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.left[node] >= 0
                below = x[rows, self.statistic[node]] <= self.threshold[node]
                node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost TREES trees of depth DEPTH on the logistic loss."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    prior = float(np.log(share / (1 - share)))
    arrays: tuple[list, ...] = ([], [], [], [], [])
    statistic, threshold, left, right, value = arrays
    roots: list[int] = []

    def node() -> int:
        for a, v in zip(arrays, (0, 0.0, -1, -1, 0.0)):
            a.append(v)
        return len(value) - 1

    if len(y) and 0 < y.sum() < len(y):
        columns = x.shape[1]
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(columns)]
        binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(columns)])
        slot = binned + np.arange(columns) * BINS
        logit = np.full(len(y), prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-logit))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(node())
            level, where = [roots[-1]], np.zeros(len(y), np.int64)
            for depth in range(DEPTH + 1):
                width = len(level)
                live = where >= 0
                g = np.bincount(where[live], grad[live], width)
                h = np.bincount(where[live], hess[live], width)
                for k, at in enumerate(level):
                    value[at] = -RATE * g[k] / (h[k] + L2)
                if depth == DEPTH:
                    break
                index = (where[live, None] * (columns * BINS) + slot[live]).reshape(-1)
                shape = (width, columns, BINS)
                gl = np.bincount(index, np.repeat(grad[live], columns), width * columns * BINS).reshape(shape).cumsum(axis=2)
                hl = np.bincount(index, np.repeat(hess[live], columns), width * columns * BINS).reshape(shape).cumsum(axis=2)
                gr, hr = g[:, None, None] - gl, h[:, None, None] - hl
                gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - (g**2 / (h + L2))[:, None, None]
                gain[(hl < MIN_HESSIAN) | (hr < MIN_HESSIAN)] = -1.0
                for f in range(columns):
                    gain[:, f, len(edges[f]) :] = -1.0
                best = gain.reshape(width, -1).argmax(axis=1)
                following, moved = [], np.full(len(y), -1)
                for k, at in enumerate(level):
                    f, b = divmod(int(best[k]), BINS)
                    if gain[k, f, b] <= 1e-6:
                        continue
                    statistic[at], threshold[at] = f, float(edges[f][b])
                    left[at], right[at] = node(), node()
                    mine = where == k
                    moved[mine] = np.where(binned[mine, f] <= b, len(following), len(following) + 1)
                    following += [left[at], right[at]]
                level, where = following, moved
                if not level:
                    break
            tree = Forest(0.0, np.array(roots[-1:]), *(np.array(a) for a in arrays))
            s = tree.score(x)
            logit += np.log(s / (1 - s))
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Forest(prior, np.array(roots, np.int64), *(np.array(a, k) for a, k in zip(arrays, kinds)))


def _held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _described(batches: Arrow) -> Arrow:
    for batch in batches:
        for part in _text.slices(batch.column("text")):
            x = statistics(part)
            flat = pa.array(x.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array((x.shape[1] * np.arange(len(x) + 1)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(part.lo, len(x)), lists], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fit on at most ``rows`` labelled texts outside the held-out fold."""
    own = labels.where(~_held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    sample = own.where("label IS NOT NULL AND label_id IS NOT NULL").orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    # the sample is bounded by ``rows``, whatever the table
    joined = texts.join(F.broadcast(sample), F.col("text_id") == F.col("label_id")).select(F.col("label").cast("int").alias("label"), "text")
    table = joined.mapInArrow(_described, "label int, x array<double>").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    y = table.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same forest whatever order rows came in
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 at THRESHOLD or more) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Arrow) -> Arrow:
        for batch in batches:
            for part in _text.slices(batch.column("text")):
                n = part.hi - part.lo
                value = pa.array(shared.value.score(statistics(part)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.lo, n), batch.column("held_out").slice(part.lo, n), value], ["doc_id", "held_out", "score"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scored = texts.select("doc_id", _held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
