"""Byte-level deduplication with a logarithmic family of suffix arrays.

Every byte covered by a ``length``-byte string that also starts earlier (smaller
id, or the same text further left) is removed.

The index is spread over buckets by a gram of the suffix (``_anchored``): a
string and its earlier occurrence always share a bucket, and only strings whose
gram repeats in the corpus travel at all.  In its bucket a task takes the texts
in order, batch by batch.  A new batch gets a suffix array: the starts of its
candidate strings, ordered by a fingerprint of the ``length`` bytes that follow
(the scan asks for equal prefixes of that length only, so any fixed order of
prefixes serves).  The array is merge-scanned against the existing levels; a
suffix found there has an earlier match, one equal to its neighbour in the new
array has an earlier match in the batch.  Fingerprints only bring candidates
together: their bytes are compared, and strings that share a fingerprint but
differ are told apart by content.  What is new becomes a level, a suffix array
with the bytes that it points into, and while the last two levels are of about
equal size they are merged, so n batches leave at most log2(n) levels and each
suffix is merged log2(n) times.

Edge cases: null texts are empty; texts shorter than ``length`` stay whole; null
ids come first; rows equal in id and text count as one row listed several times
(all get its result), rows with one id but other texts are ordered by a hash of
the text; a removed run may end inside a character, so what stays is bytes; only
the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm import _anchored, _text
from stockline.llm._anchored import Arrow, Windows

LENGTH = 100
GRAM = 24
HELD_BYTES = 12 << 20


def _fingerprints(text: np.ndarray, length: int) -> np.ndarray:
    return _text.grams(text.astype(np.uint64) + np.uint64(1), length)


@dataclass
class Level:
    """A suffix array: fingerprints in order, where each suffix starts, and the bytes it starts in."""

    prints: np.ndarray
    at: np.ndarray
    text: np.ndarray

    def merged(self, later: Level) -> Level:
        prints = np.concatenate((self.prints, later.prints))
        order = np.argsort(prints, kind="stable")  # merges the two runs
        at = np.concatenate((self.at, later.at + len(self.text)))
        return Level(prints[order], at[order], np.concatenate((self.text, later.text)))


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes of ``a`` from each of ``at`` are those of ``b`` from ``to``."""
    unit = min(length, 8)
    kind = np.dtype((np.void, unit)) if unit < 8 else np.dtype("<u8")
    wide_a, wide_b = (np.ndarray((max(len(x) - unit + 1, 0),), kind, np.ascontiguousarray(x), strides=(1,)) for x in (a, b))
    out = np.ones(len(at), bool)
    for step in {*range(0, length - unit, unit), length - unit}:
        out &= wide_a[at + step] == wide_b[to + step]
    return out


class SuffixFamily:
    """Levels of suffixes, equal ones once, whose sizes shrink geometrically."""

    def __init__(self, length: int, prints: Callable[[np.ndarray, int], np.ndarray] = _fingerprints):
        self.length, self.prints = length, prints
        self.levels: list[Level] = []
        #: strings whose fingerprint belongs to another string
        self.others: set[bytes] = set()

    def add(self, text: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Take in the suffixes of a batch that start at ``where``, in text order; which have an earlier equal one."""
        prints = self.prints(text, self.length)[where]
        order = np.argsort(prints, kind="stable")
        array = prints[order]
        lead = np.append(True, array[1:] != array[:-1]) if len(array) else np.zeros(0, bool)
        distinct, first = array[lead], where[order[lead]]
        group = np.empty(len(prints), np.int64)
        group[order] = np.cumsum(lead) - 1
        known = np.zeros(len(distinct), bool)
        same = np.ones(len(prints), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level.prints, distinct), len(level.prints) - 1)
            here = level.prints[at] == distinct
            known |= here
            mine = np.flatnonzero(here[group])
            same[mine] = _equal(text, where[mine], level.text, level.at[at[group[mine]]], self.length)
        earlier = known[group]
        follows = np.ones(len(prints), bool)
        follows[order[lead]] = False
        mine = np.flatnonzero(follows & ~earlier)
        same[mine] = _equal(text, where[mine], text, first[group[mine]], self.length)
        earlier = (earlier | follows) & same
        for i in np.flatnonzero(~same).tolist():
            string = text[where[i] : where[i] + self.length].tobytes()
            earlier[i] = string in self.others
            self.others.add(string)
        self._push(distinct[~known], first[~known], text)
        return earlier

    def _push(self, prints: np.ndarray, at: np.ndarray, text: np.ndarray) -> None:
        if len(prints):
            # of the batch's bytes those that a new suffix covers
            step = np.zeros(len(text) + 1, np.int64)
            step[at] += 1
            np.subtract.at(step, at + self.length, 1)
            held = np.cumsum(step[:-1]) > 0
            self.levels.append(Level(prints, (np.cumsum(held) - 1)[at], text[held]))
        while len(self.levels) > 1 and 2 * len(self.levels[-1].prints) > len(self.levels[-2].prints):
            last = self.levels.pop()
            self.levels.append(self.levels.pop().merged(last))


def _resolve(batches: Arrow, length: int) -> Arrow:
    family, before = SuffixFamily(length), None
    for batch in batches:
        batch, uid, start = _anchored.settled(batch)
        own, doc, at = (batch.column(c).to_numpy() for c in ("uid", "doc_id", "start"))
        route = batch.column("route").to_numpy()
        if len(own):
            # a row that is listed twice is one row
            here = np.stack((doc, own, at, route), axis=1)
            again = np.append(before is not None and np.array_equal(here[0], before), (here[1:] == here[:-1]).all(axis=1))
            before = here[-1]
            if again.any():
                batch = batch.filter(pa.array(~again))
                own, at = own[~again], at[~again]
        buf, size = _anchored.lengths(batch.column("body"))
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):  # bounded pieces of the batch, each a new batch of the index
            base = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + _text.SLICE_BYTES, side="right")))
            count = size[lo:hi] - length + 1
            where = _text.expand(np.append(0, ends[lo : hi - 1] - base), count)
            earlier = family.add(buf[base : int(ends[hi - 1])], where)
            found[0].append(np.repeat(own[lo:hi], count)[earlier])
            found[1].append(_text.expand(at[lo:hi], count)[earlier])
            lo = hi
        yield from _anchored.runs(np.concatenate((uid, *found[0])), np.concatenate((start, *found[1])))


def _kept(batches: Arrow, length: int) -> Arrow:
    for batch in batches:
        for part in _text.slices(batch.column("text")):
            n = part.hi - part.lo
            gone = _anchored.removed_items(batch.column("gone").slice(part.lo, n), part.off, length)
            stay = np.append(0, np.cumsum(~gone))
            enters = gone.copy()
            enters[1:] &= ~gone[:-1]
            heads = part.off[:-1][np.diff(part.off) > 0]
            enters[heads] = gone[heads]
            spans = np.append(0, np.cumsum(enters))
            off = stay[part.off].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(part.lo, n),
                    pa.array(np.diff(part.off)),
                    pa.array(np.diff(part.off) - np.diff(stay[part.off])),
                    pa.array(np.diff(spans[part.off]).astype(np.int64)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(part.buf[~gone]))]),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def repeated_runs(texts: DataFrame, windows: Windows) -> DataFrame:
    """uid and ``gone``, the runs (start, last) of strings that also start earlier, of identified texts."""
    length = windows.window
    anchors = _anchored.repeated_anchors(texts, windows)
    rows = _anchored.window_rows(texts, anchors, windows, as_hashes=False, held_bytes=HELD_BYTES)
    # buckets of bounded size, whatever the number of candidates
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), anchors.count() // _anchored.ROWS_PER_TASK + 1)
    rows = rows.repartition(buckets, F.col("route")).sortWithinPartitions("doc_id", "uid", "start", "route")
    return _anchored.removals(rows, lambda batches: _resolve(batches, length))


def kept_bytes(judged: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` of texts with their removed runs."""
    joined = judged.select("doc_id", "text", "gone")
    return joined.mapInArrow(lambda batches: _kept(batches, length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs removed) and ``kept``, the bytes that stay."""
    windows = Windows(words=False, window=length, base=min(gram, length))
    texts = _anchored.identified(docs, id_col, text_col)
    return kept_bytes(texts.join(repeated_runs(texts, windows), "uid", "left"), length)
