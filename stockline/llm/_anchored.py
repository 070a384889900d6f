"""Repeated windows of a corpus, found through content-defined anchors.

Shared by the word-window and the byte-window deduplication.  A window is
``window`` consecutive items (words or bytes) of one text.  Each window is dealt
to its smallest ``base``-item gram (its anchor), which depends on the window's
content alone, so two equal windows have equal anchors at the same distance.
About 2 in (window - base + 2) positions are anchors, and only anchors travel:

1. ``repeated_anchors``: anchors whose gram occurs twice or more in the corpus.
   A batch sends each distinct gram once (the rest of its occurrences are known
   to be repeated), so a gram that a third of all rows share reaches its task
   as one row per batch.  The answer is a written table.  With ``shorter``
   lengths the anchors climb a ladder: first the grams of the shortest length at
   the anchors' positions, then the next length at the positions that survived
   alone, up to ``base``; each level's survivors are a written table.
2. ``window_rows``: the texts again, joined with their repeated anchors; each
   one sends the windows dealt to it, routed by the gram.  Grams that occur
   very often (``hot``; a bounded list, largest first) have their windows
   routed one by one by their own content instead, which spreads what shares a
   gram but differs around it.
3. ``removals``: the caller's resolver says, per route, which windows have an
   equal one that starts earlier; they are gathered per text.

The shuffle of texts by row identity is one exchange that steps 2 and the
caller's last step both read.  Row identity is ``uid`` = xxhash64(id, text);
fully equal rows count as one row listed several times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm import _text
from stockline.llm._store import written

HOT_ROWS = 20_000
HOT_GRAMS = 100_000
ROWS_PER_TASK = 100_000
SETTLED = 4
COMPARED_ROWS = 10_000
_COUNT = 24  # low bits of a packed position hold the local count

Arrow = Iterator[pa.RecordBatch]


class Windows:
    """How texts become items: ``words`` (runs of non-space bytes) or bytes."""

    def __init__(self, words: bool, window: int, base: int, shorter: Sequence[int] = ()):
        if not 0 < base <= window:
            raise ValueError("base must be between 1 and window")
        self.words, self.window, self.base = words, window, base
        self.ladder = [*shorter, base]

    def items(self, part: _text.Slice) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit value per item, and where each text's items begin."""
        if not self.words:
            return part.buf.astype(np.uint64) + np.uint64(1), part.off
        s, e, first = _text.spans(part.buf, part.off, _text.NOT_SPACE)
        return _text.word_hashes(part.buf, s, e), first

    def anchors(self, part: _text.Slice):
        """Item values, text borders, and per anchor: position, first and last window, gram, text."""
        values, first = self.items(part)
        gram = _text.grams(values, self.base)
        at, lo, hi = _text.anchors(gram, _text.starts_within(first, self.window, len(values)), self.window - self.base + 1)
        return values, first, at, lo, hi, gram[at], np.searchsorted(first, at, side="right") - 1

    def levels(self, values: np.ndarray, at: np.ndarray, gram: np.ndarray) -> list[np.ndarray]:
        """At each anchor, the gram of every length of the ladder that begins there."""
        # a pre-filter: 40 bits decide which positions go on, and what goes on is looked at again
        return [*(_text.grams(values, n)[at] >> np.uint64(24) for n in self.ladder[:-1]), gram]

    def hashes(self, values: np.ndarray) -> np.ndarray:
        """Hash of the window that starts at each item (also across texts)."""
        return _text.grams(values, self.window)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and uid, by which steps are joined."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))


def _batch(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def groups(batches: Arrow, key: str) -> Arrow:
    """Batches of rows sorted by ``key``, re-cut so that none splits a key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and kept and kept[-1].column(key)[-1].as_py() == int(keys[0]):
            kept.append(batch)
            continue
        same = int(np.searchsorted(keys, keys[0], side="right")) if kept and kept[-1].column(key)[-1].as_py() == int(keys[0]) else 0
        cut = last
        if kept:
            yield from _joined([*kept, batch.slice(0, same)])
            kept = []
        if cut > same:
            yield batch.slice(same, cut - same)
        kept = [batch.slice(max(cut, same))]
    yield from _joined(kept)


def _joined(parts: list[pa.RecordBatch]) -> Arrow:
    table = pa.Table.from_batches(parts).combine_chunks() if parts else None
    yield from table.to_batches() if table is not None else ()


def _deal(grams: Sequence[np.ndarray], uid: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """A batch's anchors for one level: gram, uid, pos and local count (packed), and grams of later levels."""
    gram = grams[0]
    _, where, back, count = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
    once = np.zeros(len(gram), bool)
    once[where] = True
    n = np.where(once, np.minimum(count[back], (1 << _COUNT) - 1), 0)
    # what is known to be repeated needs no count: it is dealt out evenly
    key = np.where(once, gram, _text.mix(uid.view(np.uint64) + pos.astype(np.uint64)))
    later = {f"next{i}": g.view(np.int64) for i, g in enumerate(grams[1:])}
    return _batch({"gram": key.view(np.int64), "uid": uid, "packed": (pos.astype(np.int64) << _COUNT) | n} | later)


def repeated_anchors(docs: DataFrame, windows: Windows) -> DataFrame:
    """Written table: uid, pos (item) of every anchor whose gram is found twice or more; gram and n where it is hot."""

    def first(batches: Arrow) -> Arrow:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            for part in _text.slices(batch.column("text")):
                values, first, at, _, _, gram, text = windows.anchors(part)
                if len(at):
                    found.append((uid[part.lo + text], at - first[text], *windows.levels(values, at, gram)))
            if found:
                own, pos, *grams = (np.concatenate(x) for x in zip(*found))
                yield _deal(grams, own, pos)

    def further(batches: Arrow) -> Arrow:
        for batch in batches:
            grams = [batch.column(c).to_numpy().view(np.uint64) for c in batch.schema.names if c.startswith("next")]
            yield _deal(grams, batch.column("uid").to_numpy(), batch.column("pos").to_numpy())

    def repeated(batches: Arrow) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows sorted by gram, which of them are repeated, and those grams' counts."""
        for batch in groups(batches, "gram"):
            gram, n = batch.column("gram").to_numpy(), batch.column("packed").to_numpy() & ((1 << _COUNT) - 1)
            begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            total = np.repeat(np.add.reduceat(n, begin), np.diff(np.append(begin, len(gram))))
            keep = np.flatnonzero((n == 0) | (total > 1))
            yield batch, keep, total[keep]

    def survivors(batches: Arrow) -> Arrow:
        for batch, keep, _ in repeated(batches):
            rows = batch.take(pa.array(keep))
            later = {c: rows.column(c) for c in rows.schema.names if c.startswith("next")}
            yield _batch({"uid": rows.column("uid"), "pos": rows.column("packed").to_numpy() >> _COUNT} | later)

    def anchors(batches: Arrow) -> Arrow:
        for batch, keep, total in repeated(batches):
            gram, packed = batch.column("gram").to_numpy()[keep], batch.column("packed").to_numpy()[keep]
            hot = ((packed & ((1 << _COUNT) - 1)) > 0) & (total >= HOT_ROWS)
            yield _batch(
                {
                    "uid": batch.column("uid").to_numpy()[keep],
                    "pos": packed >> _COUNT,
                    "gram": pa.array(gram, mask=~hot),
                    "n": pa.array(total, mask=~hot),
                }
            )

    rows, step = docs.select("text", "uid"), first
    for i, length in enumerate(windows.ladder):
        later = "".join(f", next{j} bigint" for j in range(len(windows.ladder) - 1 - i))
        sent = rows.mapInArrow(step, f"gram bigint, uid bigint, packed bigint{later}")
        dealt = sent.repartition("gram").sortWithinPartitions("gram")
        if later:
            rows, step = written(dealt.mapInArrow(survivors, f"uid bigint, pos bigint{later}"), f"level-{length}"), further
    return written(dealt.mapInArrow(anchors, "uid bigint, pos bigint, gram bigint, n bigint"), "anchors")


def hot_grams(anchors: DataFrame) -> np.ndarray:
    """The most frequent grams, HOT_GRAMS at most: a bounded list, whatever the input."""
    rows = anchors.where("gram IS NOT NULL").groupBy("gram").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def window_rows(docs: DataFrame, anchors: DataFrame, windows: Windows, as_hashes: bool, held_bytes: int = 1 << 62) -> DataFrame:
    """route, doc_id, uid, start (item) and the windows dealt to each repeated anchor.

    ``body``: the hashes of the windows that start at start, start + 1, ...
    (8 bytes each), or with ``as_hashes`` false the items' bytes themselves.
    Where an equal stretch starts earlier in the same batch, its windows are
    settled: such a row is dealt out evenly and its body is only their number
    (``SETTLED`` bytes).  doc_id is the order of texts, nulls first.  A task
    holds the stretches of a batch, or of about ``held_bytes`` of its texts.
    """
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_grams(anchors))
    marks = anchors.groupBy("uid").agg(F.collect_list("pos").alias("marks"))

    def stretches(part: _text.Slice, marked: pa.Array):
        """Per stretch: route, text, start, windows, hash of its items; and the bodies."""
        values, first, at, lo, hi, gram, text = windows.anchors(part)
        if not len(at):
            return None
        want = marked.flatten().to_numpy() + np.repeat(first[:-1], pc.list_value_length(marked).to_numpy())
        keep = np.flatnonzero(np.isin(at, want))
        lo, hi, gram, text = lo[keep], hi[keep], gram[keep], text[keep]
        hashes = windows.hashes(values)
        wide = np.isin(gram, hot.value)
        if wide.any():  # one row for each window
            count = np.where(wide, hi - lo + 1, 1)
            each = _text.expand(lo, count)
            wide, text = np.repeat(wide, count), np.repeat(text, count)
            hi, lo = np.where(wide, each, np.repeat(hi, count)), each
            gram = np.where(wide, hashes[lo], np.repeat(gram, count))
        content = _text.ranges(_text.prefix(values), lo, hi + windows.window)
        unit, data, size = (8, hashes.view(np.uint8), hi - lo + 1) if as_hashes else (1, part.buf, hi - lo + windows.window)
        body = np.ascontiguousarray(data[_text.expand(lo * unit, size * unit)])
        ends = np.append(0, np.cumsum(size * unit)).astype(np.int32)
        bodies = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(ends), pa.py_buffer(body)])
        return gram, part.lo + text, lo - first[text], hi - lo + 1, content, bodies

    def send(batch: pa.RecordBatch, parts: list) -> pa.RecordBatch:
        route, row, start, count, content = (np.concatenate(x) for x in list(zip(*parts))[:5])
        doc, uid = batch.column("doc_id").to_numpy()[row], batch.column("uid").to_numpy()[row]
        order = np.lexsort((start, uid, doc, content))
        lead = np.append(True, content[order][1:] != content[order][:-1])
        leader = np.empty(len(order), np.int64)
        leader[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        is_lead = np.zeros(len(order), bool)
        is_lead[order[lead]] = True
        bodies = pa.concat_arrays([p[5] for p in parts])
        follows = np.flatnonzero(~is_lead)
        for lo in range(0, len(follows), COMPARED_ROWS):  # equal hashes, equal items
            some = follows[lo : lo + COMPARED_ROWS]
            alike = pc.equal(bodies.take(pa.array(some)), bodies.take(pa.array(leader[some])))
            is_lead[some] = ~alike.to_numpy(zero_copy_only=False)
        same = (doc == doc[leader]) & (uid == uid[leader]) & (start == start[leader])
        number = pa.Array.from_buffers(
            pa.binary(SETTLED), len(count), [None, pa.py_buffer(count.astype("<i4"))]
        ).cast(pa.binary())
        body = pc.if_else(pa.array(is_lead), bodies, number)
        even = _text.mix(uid.view(np.uint64) + start.astype(np.uint64))
        out = _batch({"route": np.where(is_lead, route, even).view(np.int64), "doc_id": doc, "uid": uid, "start": start, "body": body})
        return out.filter(pa.array(is_lead | ~same))

    def emit(batches: Arrow) -> Arrow:
        for batch in batches:
            batch = batch.filter(batch.column("marks").is_valid())
            held, size = [], 0
            for part in _text.slices(batch.column("text")):
                found = stretches(part, batch.column("marks").slice(part.lo, part.hi - part.lo))
                held += [found] if found is not None else []
                size += len(part.buf)
                if held and size >= held_bytes:
                    yield send(batch, held)
                    held, size = [], 0
            if held:
                yield send(batch, held)

    joined = docs.join(marks, "uid", "left").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text", "uid", "marks")
    return joined.mapInArrow(emit, "route bigint, doc_id bigint, uid bigint, start bigint, body binary")


def lengths(body: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and each row's length."""
    buf, off = _text.buffers(body)
    return buf[off[0] : off[-1]], np.diff(off)


def settled(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows still to be resolved; uid and start of each settled window."""
    body = batch.column("body")
    known = pc.equal(pc.binary_length(body), SETTLED)
    done = batch.filter(known)
    buf, _ = lengths(done.column("body"))
    count = np.frombuffer(buf.tobytes(), "<i4").astype(np.int64)
    return batch.filter(pc.invert(known)), np.repeat(done.column("uid").to_numpy(), count), _text.expand(done.column("start").to_numpy(), count)


def runs(uid: np.ndarray, start: np.ndarray) -> Arrow:
    """Window starts of texts, joined into runs: uid, start, last."""
    if not len(uid):
        return
    order = np.lexsort((start, uid))
    uid, start = uid[order], start[order]
    new = np.flatnonzero(np.append(True, (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + 1)))
    yield _batch({"uid": uid[new], "start": start[new], "last": start[np.append(new[1:], len(uid)) - 1]})


def removals(rows: DataFrame, resolve: Callable[[Arrow], Arrow]) -> DataFrame:
    """uid and ``gone``, the runs (start, last) of removed windows of each text."""
    found = rows.mapInArrow(resolve, "uid bigint, start bigint, last bigint")
    return found.groupBy("uid").agg(F.collect_list(F.struct("start", "last")).alias("gone"))


def removed_items(gone: pa.Array, first: np.ndarray, window: int) -> np.ndarray:
    """Which items of a slice's texts lie in a removed window."""
    total = int(first[-1])
    if not len(gone) or not total:
        return np.zeros(total, bool)
    counts = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False)
    flat = gone.flatten()
    base = np.repeat(first[:-1], counts)
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, base + flat.field("start").to_numpy(), 1)
    np.add.at(step, base + flat.field("last").to_numpy() + window, -1)
    return np.cumsum(step[:-1]) > 0
