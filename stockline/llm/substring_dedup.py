"""Word-window deduplication by level-wise doubling.

A window is ``window`` consecutive words.  The first level looks at windows of
that length halved as often as it stays even and at least ``shortest`` (5, 10,
20 words by default) and keeps those whose words occur twice or more in the
corpus; only these are extended to twice the length, and the next level keeps the
longer ones that still repeat: a candidate that does not repeat at one level is
never looked at again.  Each level's survivors are a written table.  Short
windows are taken at content-defined anchors (``_anchored``), at least one of
which lies in every full window, so nothing is lost and a fraction of the
positions is shuffled; the last level compares the full windows around the
anchors that are left.

Every word covered by a full window that also starts earlier (smaller id, or
the same text further left) is removed.

Edge cases: null texts are empty; texts shorter than a window keep all words;
null ids come first in the order; rows equal in id and text count as one row
listed several times (all get its result), and rows with one id but other texts
are ordered by a hash of the text; very long texts and very frequent windows
are processed whole; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockline.llm import _anchored, _text
from stockline.llm._anchored import Arrow, Windows

WINDOW = 20
SHORTEST = 5


def levels(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the first level to the full one, each twice the one before."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= shortest:
        out.insert(0, out[0] // 2)
    return out


def _resolve(batches: Arrow) -> Arrow:
    for batch in _anchored.groups(batches, "route"):
        batch, uid, start = _anchored.settled(batch)
        buf, size = _anchored.lengths(batch.column("body"))
        content = buf.view(np.uint64) if len(buf) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(batch.num_rows), size // 8)
        own, doc = batch.column("uid").to_numpy()[row], batch.column("doc_id").to_numpy()[row]
        at = _text.expand(batch.column("start").to_numpy(), size // 8)
        # rows come in order of route, text and position: the first of equal windows is the earliest
        _, first, back = np.unique(content, return_index=True, return_inverse=True)
        first = first[back]
        later = np.flatnonzero((own != own[first]) | (doc != doc[first]) | (at != at[first]))
        yield from _anchored.runs(np.concatenate((uid, own[later])), np.concatenate((start, at[later])))


def _kept(batches: Arrow, windows: Windows) -> Arrow:
    for batch in batches:
        for part in _text.slices(batch.column("text")):
            s, e, first = _text.spans(part.buf, part.off, _text.NOT_SPACE)
            n = part.hi - part.lo
            gone = _anchored.removed_items(batch.column("gone").slice(part.lo, n), first, windows.window)
            stay = np.flatnonzero(~gone)
            begins = np.append(0, np.cumsum(~gone))[first]  # kept words before each text
            last = np.zeros(len(stay) + 1, bool)
            last[begins[1:] - 1] = True  # of its text; an empty text marks one that is marked already, or the spare
            last = last[:-1]
            size = e[stay] - s[stay] + ~last
            where = _text.expand(s[stay], size)
            out = np.append(part.buf, np.uint8(0x20))[where] if len(where) else np.zeros(0, np.uint8)
            ends = np.append(0, np.cumsum(size))
            out[ends[1:][~last] - 1] = 0x20
            off = ends[begins].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(part.lo, n),
                    pa.array(np.diff(first)),
                    pa.array(np.diff(np.append(0, np.cumsum(gone))[first]).astype(np.int64)),
                    pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(off), pa.py_buffer(out)]),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay joined by one space."""
    *shorter, base = levels(window, shortest)[:-1] or [window]
    windows = Windows(words=True, window=window, base=base, shorter=shorter)
    texts = _anchored.identified(docs, id_col, text_col)
    anchors = _anchored.repeated_anchors(texts, windows)
    rows = _anchored.window_rows(texts, anchors, windows, as_hashes=True)
    rows = rows.repartition("route").sortWithinPartitions("route", "doc_id", "uid", "start")
    gone = _anchored.removals(rows, _resolve)
    joined = texts.join(gone, "uid", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(lambda batches: _kept(batches, windows), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
