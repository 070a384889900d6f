"""Benchmark decontamination: a broadcast set of normalised test n-grams.

The benchmark's windows (13 words, or a whole shorter item) are hashed once on
the driver and broadcast, if its size, checked first, says that there are at
most ``max_windows`` of them.  Documents are scanned batch by
batch: words are hashed over the Arrow buffer, windows are looked up in the
sorted hash set, and every hit is verified on the words themselves.  No
shuffle of documents.  A larger benchmark is not broadcast: its windows, words
included, are joined with those of the documents by hash, and every hit is
verified on the words in the same way, so the size changes no result.

Normalisation lower-cases A-Z and takes words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Edge cases: null or wordless texts have no words, no hits and are not
contaminated; null or wordless items are ignored; repeated document rows are
judged alike; repeated or null item ids are reported once per distinct id
(null as an empty string); an empty benchmark hits nothing.  Only the id and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.llm import _text
from stockline.llm._store import fresh

WINDOW = 13
MAX_WINDOWS = 1_000_000
CONTAMINATED_SHARE = 20  # hit when 20 * n_hit >= n_words

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

_SCAN = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


def _words(text: str) -> list[bytes]:
    raw = _text.LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = _text.spans(raw, np.array([0, len(raw)]), IS_WORD)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(s.tolist(), e.tolist())]


def benchmark_windows(rows, window: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """Every window of every item, with the ids of the items that have it."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in rows:
        words = _words(text or "")
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            out.setdefault(tuple(words[i : i + n]), set()).add("" if item is None else str(item))
    return out


class WindowSet:
    """Windows by length: sorted hashes, and what each hash stands for."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.by_length: dict[int, tuple[np.ndarray, list[list[tuple[bytes, list[str]]]]]] = {}
        groups: dict[int, list[tuple[bytes, ...]]] = {}
        for w in windows:
            groups.setdefault(len(w), []).append(w)
        for n, members in groups.items():
            data = np.frombuffer(b"\x00".join(b"\x00".join(w) for w in members), np.uint8)
            s, e, _ = _text.spans(data, np.array([0, len(data)]), IS_WORD)
            hashes = _text.grams(_text.word_hashes(data, s, e), n)[::n]
            table: dict[int, list[tuple[bytes, list[str]]]] = {}
            for h, w in zip(hashes.tolist(), members):
                table.setdefault(h, []).append((b"\x00".join(w), sorted(windows[w])))
            keys = np.array(sorted(table), np.uint64)
            self.by_length[n] = keys, [table[int(k)] for k in keys]

    def hits(self, data: bytes, s: np.ndarray, e: np.ndarray, first: np.ndarray, hashes: np.ndarray):
        """(word position, window length, item ids) of every verified occurrence."""
        for n, (keys, what) in self.by_length.items():
            g = _text.grams(hashes, n)
            if not len(g):
                continue
            k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            found = np.flatnonzero((keys[k] == g) & _text.starts_within(first, n, len(hashes))[: len(g)])
            for i, j in zip(found.tolist(), k[found].tolist()):
                words = b"\x00".join(data[a:b] for a, b in zip(s[i : i + n].tolist(), e[i : i + n].tolist()))
                for exact, items in what[j]:
                    if exact == words:
                        yield i, n, items


Hits = Iterator[tuple[int, int, list[str]]]


class _Words:
    """The normalised words of a slice: bytes, borders, where texts begin, hashes."""

    def __init__(self, part: _text.Slice):
        self.part, buf = part, _text.LOWER[part.buf]
        self.start, self.end, self.first = _text.spans(buf, part.off, IS_WORD)
        self.hashes = _text.word_hashes(buf, self.start, self.end)
        self.data = buf.tobytes()

    def content(self, i: int, n: int) -> bytes:
        """The ``n`` words from the i-th on."""
        return b"\x00".join(self.data[a:b] for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist()))

    def judged(self, ids: pa.Array, hits: Hits) -> pa.RecordBatch:
        """One row per text from (word position, window length, item ids) of every occurrence."""
        part, first, s, e = self.part, self.first, self.start, self.end
        texts = part.hi - part.lo
        items: list[set[str]] = [set() for _ in range(texts)]
        step = np.zeros(len(s) + 1, np.int32)
        for i, n, found in hits:
            items[int(np.searchsorted(first, i, side="right")) - 1].update(found)
            step[i] += 1
            step[i + n] -= 1
        hit = np.cumsum(step)[:-1] > 0
        n_hit = np.diff(np.append(0, np.cumsum(hit))[first])
        runs: list[list[dict]] = [[] for _ in range(texts)]
        for d in np.flatnonzero(n_hit).tolist():
            own = hit[first[d] : first[d + 1]]
            at = first[d] + np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            base = int(part.off[d])
            char = lambda b: len(self.data[base:b].decode("utf-8", "replace"))  # noqa: B023, E731
            runs[d] = [{"start": char(int(s[a])), "end": char(int(e[b - 1]))} for a, b in zip(at[::2], at[1::2])]
        columns = [
            ids.slice(part.lo, texts),
            pa.array(np.diff(first)),
            pa.array(n_hit.astype(np.int64)),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])


def _scan(batches: Iterator[pa.RecordBatch], windows: WindowSet) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch.column(1)):
            words = _Words(part)
            yield words.judged(batch.column(0), windows.hits(words.data, words.start, words.end, words.first, words.hashes))


def _windows(batches: Iterator[pa.RecordBatch], lengths: list[int], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, hash, n, position, words) of the windows of each text; without lengths, its own: ``window`` or all its words.

    The words themselves go with a text's own windows only (the benchmark's).
    """
    for batch in batches:
        for part in _text.slices(batch.column(1)):
            words = _Words(part)
            count = np.diff(words.first)
            for n in lengths or sorted(set(np.minimum(count[count > 0], window).tolist())):
                ok = np.flatnonzero(_text.starts_within(words.first, n, len(words.hashes)))
                text = np.searchsorted(words.first, ok, side="right") - 1
                if not lengths:
                    keep = np.minimum(count[text], window) == n
                    ok, text = ok[keep], text[keep]
                if len(ok):
                    ids = batch.column(0).slice(part.lo, part.hi - part.lo).take(pa.array(text))
                    g = _text.grams(words.hashes, n)[ok].view(np.int64)
                    content = pa.nulls(len(ok), pa.binary()) if lengths else pa.array([words.content(i, n) for i in ok.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(g), pa.array(np.full(len(ok), n)), pa.array(ok - words.first[text]), content], ["id", "h", "n", "pos", "words"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch.column("text")):
            words = _Words(part)
            found = batch.column("found").slice(part.lo, part.hi - part.lo).to_pylist()
            at = ((int(words.first[d]) + f["pos"], f) for d, own in enumerate(found) for f in own or ())
            # equal hashes are candidates; the words decide
            hits = ((i, f["n"], [f["item"]]) for i, f in at if words.content(i, f["n"]) == f["words"])
            yield words.judged(batch.column("doc_id"), hits)


def _by_join(texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``_scan`` for a benchmark of any size: its windows are joined with the texts' by hash, their words with them."""
    schema = "id string, h bigint, n bigint, pos bigint, words binary"
    theirs = items.mapInArrow(lambda batches: _windows(batches, [], window), schema)
    theirs = theirs.select("h", "n", F.coalesce("id", F.lit("")).alias("item"), "words").distinct()
    lengths = [r["n"] for r in theirs.select("n").distinct().collect()]  # as many values as a window has words, at most
    named = texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    ours = named.select("uid", "text").mapInArrow(lambda batches: _windows(batches, lengths or [window], window), schema.replace("id string", "id bigint"))
    hits = ours.drop("words").join(theirs, ["h", "n"]).groupBy("id").agg(F.collect_set(F.struct("pos", "n", "item", "words")).alias("found"))
    joined = named.join(hits, F.col("uid") == F.col("id"), "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_marked, _SCAN)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (array), spans (characters of hit runs), contaminated."""
    items = _items(benchmark, item_col, text_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if _fits(items, max_windows):
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(benchmark_windows(items.collect(), window)))
        scanned = texts.mapInArrow(lambda batches: _scan(batches, shared.value), _SCAN)
    else:
        scanned = _by_join(texts, items, window)
    return scanned.withColumn("contaminated", _judged())


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))


def _fits(items: DataFrame, max_windows: int) -> bool:
    """Whether the items surely have ``max_windows`` windows or fewer: a window needs two bytes of text."""
    return items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] <= 2 * max_windows


def _judged() -> Column:
    return (F.col("n_hit") > 0) & (CONTAMINATED_SHARE * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """The rows of ``docs`` whose texts are not contaminated, unchanged.

    With a broadcast benchmark rows are judged in the scan itself (no join by
    id, so repeated or null ids cannot mix up rows); with a larger one by the
    text's hash, which rows of one text share, and so does the verdict.
    """
    items = _items(benchmark, item_col, text_col)
    if not _fits(items, max_windows):
        key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
        texts = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
        name = fresh(docs, "bad_text")
        bad = _by_join(texts, items, WINDOW).where(_judged()).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(bad, key == F.col(name), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(benchmark_windows(items.collect())))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
            for judged in _scan(iter([pair]), shared.value):
                hit = judged.column(2).to_numpy()
                bad = (hit > 0) & (CONTAMINATED_SHARE * hit >= judged.column(1).to_numpy())
                yield batch.take(judged.column(0).filter(pa.array(~bad)))

    return docs.mapInArrow(clean, docs.schema)
