"""Near-duplicate detection with min-max hashing.

A text is its set of distinct shingles (runs of ``words`` words, lower-cased
A-Z).  Under each of PERMUTATIONS random permutations of the shingle hashes both
the smallest and the largest value are kept: two signature values for one hash
evaluation, each equal with probability J for two sets of similarity J, and with
less variance than independent ones.  ROWS values make a band key; two texts are
compared if they share one of BANDS keys, which two texts at the threshold fail
to do with probability (1 - 0.8**5)**40 = 1e-7.  Every link is confirmed on the
full sets.

The work is arranged so that no group is ever expanded into all its pairs:

1. Texts with equal sets are one class (an aggregation; its smallest id stands
   for it).  Only classes go on.
2. Band keys that two or more classes share are buckets.  Each bucket's leader is
   the member that lies in the fullest buckets (the centre of a group of copies
   rather than its edge); every member is confirmed against its leaders.
3. Links make components (repeated minimum over links, pointers halved).
4. What is left are buckets whose members are still in several components (of
   buckets with equal members, one).  They are cut into blocks of bounded size,
   those of the bucket's fullest component apart, and every two blocks of a
   bucket meet in one task, unless both are of that component.  A first round looks at
   signatures only and names the members that agree with a member of another
   component to within five standard deviations of the threshold; a second
   brings the texts of those, confirms pairs on their full sets, and returns
   only the links that join two components, so a block of n members returns
   fewer than n links.  Then components are joined again.

Edge cases: null or wordless texts have an empty set, link with nothing and are
kept; texts with fewer words than a shingle have one shingle, the whole
sequence; repeated rows are one class; a null id comes first, as the smallest;
an empty table yields an empty result; texts are processed whole; rows
that share an id are taken as one document; only the id and text columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm import _text
from stockline.llm._anchored import groups
from stockline.llm._store import fresh, written

WORDS = 5
PERCENT = 80
PERMUTATIONS = 100
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
#: 2 * 100 values at similarity 0.8 have a standard deviation of 5.7; five of them below 160.
AGREE = 131
BLOCK = 1024
NONE = -(1 << 63)

Arrow = Iterator[pa.RecordBatch]

_random = np.random.default_rng(20240601)
_MULTIPLY = _random.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(part: _text.Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted in each text, and where each text's begin."""
    buf = _text.LOWER[part.buf]
    s, e, first = _text.spans(buf, part.off, _text.NOT_SPACE)
    h = _text.word_hashes(buf, s, e)
    ok = np.flatnonzero(_text.starts_within(first, words, len(h)))
    found = _text.grams(h, words)[ok] if len(ok) else np.zeros(0, np.uint64)
    text = np.searchsorted(first, ok, side="right") - 1
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):  # the whole sequence
        found = np.append(found, _text.ranges(_text.prefix(h), first[short], first[short + 1]))
        text = np.append(text, short)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    if len(found):
        new = np.append(True, (found[1:] != found[:-1]) | (text[1:] != text[:-1]))
        found, text = found[new], text[new]
    return found, np.searchsorted(text, np.arange(part.hi - part.lo + 1))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Min and max under every permutation, one row of 2 * PERMUTATIONS values per non-empty text."""
    begin = first[:-1][np.diff(first) > 0]
    out = np.empty((len(begin), 2 * PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        value = ((sets * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * k] = np.minimum.reduceat(value, begin)
        out[:, 2 * k + 1] = np.maximum.reduceat(value, begin)
    return out


def _signed(batches: Arrow, words: int) -> Arrow:
    for batch in batches:
        for part in _text.slices(batch.column("text")):
            sets, first = shingles(part, words)
            n = np.diff(first)
            full = np.flatnonzero(n)
            sig = signatures(sets, first) if len(full) else np.zeros((0, 2 * PERMUTATIONS), np.uint32)
            wide = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.zeros(wide.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                key = _text.mix(key * np.uint64(_text._P) + wide[:, :, r])
            low = np.ascontiguousarray((sig & np.uint32(0xFF)).astype(np.uint8))
            # the set's two fingerprints: sums of its hashes, mixed
            total = np.append(np.uint64(0), np.cumsum(sets, dtype=np.uint64))
            other = np.append(np.uint64(0), np.cumsum(_text.mix(sets ^ np.uint64(_text._P)), dtype=np.uint64))
            lo, hi = first[full], first[full + 1]
            at = np.full(part.hi - part.lo, -1)
            at[full] = np.arange(len(full))
            take = pa.array(at, mask=at < 0)
            bands = pa.ListArray.from_arrays(pa.array((BANDS * np.arange(len(full) + 1)).astype(np.int32)), pa.array(key.reshape(-1).view(np.int64)))
            body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * PERMUTATIONS), len(full), [None, pa.py_buffer(low)]).cast(pa.binary())
            columns = [
                batch.column("doc_id").slice(part.lo, part.hi - part.lo),
                pa.array(n.astype(np.int64)),
                pa.array((total[hi] - total[lo]).view(np.int64)).take(take),
                pa.array((other[hi] - other[lo]).view(np.int64)).take(take),
                bands.take(take),
                body.take(take),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "f1", "f2", "bands", "sig"])


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def _blocks(batches: Arrow) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of one task of two blocks (or one with itself): rows, signatures, left and right positions."""
    for batch in groups(batches, "route"):
        route = batch.column("route").to_numpy()
        begin = np.flatnonzero(np.append(True, route[1:] != route[:-1])).tolist()
        for lo, hi in zip(begin, [*begin[1:], len(route)]):
            part = batch.slice(lo, hi - lo)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)
            side = part.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            yield part, sig, left, right if len(right) else left


def _close(batches: Arrow) -> Arrow:
    """Members whose signature agrees well enough with that of a member of another component."""
    for part, sig, left, right in _blocks(batches):
        component = part.column("component").to_numpy()
        found = np.zeros(part.num_rows, bool)
        for i in left.tolist():
            other = right[component[right] != component[i]]
            if len(other):
                near = other[_agreement(sig[other], sig[i]) >= AGREE]
                found[near] = True
                found[i] |= len(near) > 0
        if found.any():
            yield part.select(["route", "cls", "component", "side", "sig"]).filter(pa.array(found))


def _joining(batches: Arrow, words: int, percent: int) -> Arrow:
    """Confirmed links that join two components, one for each time that two are joined."""
    for part, sig, left, right in _blocks(batches):
        ids, root = part.column("cls").to_numpy(), part.column("component").to_numpy().copy()
        sets: list[np.ndarray] = []
        for piece in _text.slices(part.column("text")):
            values, first = shingles(piece, words)
            sets += [values[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        links = []
        for i in left.tolist():
            other = right[root[right] != root[i]]
            agree = _agreement(sig[other], sig[i])
            for j in other[np.argsort(-agree, kind="stable")][: int((agree >= AGREE).sum())].tolist():
                if root[i] == root[j]:
                    continue
                same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    root[root == root[j]] = root[i]
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _confirm(batches: Arrow, words: int, percent: int) -> Arrow:
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = []
            for column in ("text_a", "text_b"):
                buf, off = _text.buffers(part.column(column))
                sets.append(shingles(_text.Slice(0, part.num_rows, buf[off[0] : off[-1]], off - off[0]), words))
            (x, fx), (y, fy) = sets
            row = np.append(np.repeat(np.arange(part.num_rows), np.diff(fx)), np.repeat(np.arange(part.num_rows), np.diff(fy)))
            both = np.append(x, y)
            order = np.lexsort((both, row))
            both, row = both[order], row[order]
            same = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=part.num_rows)
            union = np.diff(fx) + np.diff(fy) - same
            linked = pa.array((union > 0) & (100 * same >= percent * union))
            yield part.select(["a", "b"]).filter(linked)


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    first = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(lambda batches: _confirm(batches, words, percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of a link, by repeated minimum.

    Each round takes the smallest label among a node's neighbours (aggregated
    before it is joined, so a node with very many links is no large task), then
    the label of that label, which halves the paths; rounds end when no label
    moves.  Every round is a written table.
    """
    edges = written(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = edges.join(labels.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        nxt = moved.join(jump, "low", "left").select("node", F.least("low", F.coalesce("further", "low")).alias("label"), F.col("label").alias("was"))
        nxt = written(nxt, "labels")
        if nxt.where("label <> was").isEmpty():
            return nxt.select("node", F.col("label").alias("component"))
        labels = nxt.select("node", "label")


def _routes(placed: DataFrame) -> DataFrame:
    """Where the members of open buckets meet: route, cls, component, side of (key, cls, component) rows.

    A bucket is open if its members are in several components; of open buckets
    with the same members one is enough.  The members of its fullest component
    are linked already, so their blocks meet only those of the others, which meet
    all.  With n members in the fullest component and m others that is
    m * (2n + m) / BLOCK rows beside the members themselves: the usual open
    bucket, a large group of copies and a few strangers, gives about one row a
    member.
    """
    content = [F.sum(F.pmod(F.xxhash64("cls", F.lit(k)), F.lit(1 << 40))).alias(f"m{k}") for k in (0, 1)]
    parts = placed.groupBy("key", "component").agg(*content, F.count("*").alias("n"))
    sums = [F.sum(c).alias(c) for c in ("m0", "m1")]
    keys = parts.groupBy("key").agg(*sums, F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"))
    keys = keys.where("top.n < size").groupBy("m0", "m1", "size").agg(F.min(F.struct("key", "top")).alias("one"))
    blocks = [F.ceil(n / BLOCK).cast("int") for n in (F.col("one.top.n"), F.col("size") - F.col("one.top.n"))]
    keys = keys.select("one.key", F.col("one.top.component").alias("main"), blocks[0].alias("linked"), blocks[1].alias("others"))
    rest = placed.join(keys, "key")
    inside = F.col("component") == F.col("main")
    within = F.pmod(F.xxhash64("cls"), F.when(inside, F.col("linked")).otherwise(F.col("others"))).cast("int")
    rest = rest.withColumn("own", F.when(inside, within).otherwise(F.col("linked") + within))
    met = F.sequence(F.when(inside, F.col("linked")).otherwise(F.lit(0)), F.col("linked") + F.col("others") - 1)
    rest = rest.withColumn("met", F.explode(met))
    route = F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met"))
    return rest.select(route.alias("route"), "cls", "component", (F.col("own") > F.col("met")).cast("int").alias("side"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (first of its component)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    ordered = source.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc_id"), "text")
    schema = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, sig binary"
    signed = written(ordered.mapInArrow(lambda batches: _signed(batches, words), schema), "signed")

    # equal sets are one class; its rows carry equal bands and signatures
    head = signed.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles")
    head = written(head.agg(F.min("doc_id").alias("cls"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    member = signed.select("doc_id", "f1", "f2", "n_shingles").join(head.select("f1", "f2", "n_shingles", "cls"), ["f1", "f2", "n_shingles"], "left")
    member = written(member.select("doc_id", "n_shingles", F.coalesce("cls", "doc_id").alias("cls")), "members")

    keys = head.select("cls", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bucket = written(keys.join(shared, "key"), "buckets")
    weight = bucket.groupBy("cls").agg(F.sum("size").alias("weight"))
    weighted = bucket.join(weight, "cls")
    leader = weighted.groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not("cls").alias("rank"))).alias("top"))
    star = bucket.join(leader.select("key", F.bitwise_not("top.rank").alias("leader")), "key").where("cls <> leader")
    star = written(star.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct(), "star")

    in_bucket = bucket.select("cls").distinct()
    sigs = written(head.select("cls", "sig").join(in_bucket, "cls").groupBy("cls").agg(F.min("sig").alias("sig")), "signatures")
    texts = ordered.select(F.col("doc_id").alias("cls"), "text").join(in_bucket, "cls").groupBy("cls").agg(F.min("text").alias("text"))
    texts = written(texts, "texts")

    close = star.join(sigs.toDF("b", "sig_b"), "b").join(sigs.toDF("a", "sig_a"), "a")
    close = close.mapInArrow(_similar, "a bigint, b bigint")
    links = written(_links(close, texts, words, percent), "links")
    label = components(links)

    placed = bucket.select("key", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    rest = _routes(placed.select("key", "cls", F.coalesce("component", "cls").alias("component"))).join(sigs, "cls")
    rest = rest.select("route", "cls", "component", "side", "sig")
    schema = "route bigint, cls bigint, component bigint, side int, sig binary"
    near = written(rest.repartition("route").sortWithinPartitions("route").mapInArrow(_close, schema), "near")
    near = near.join(texts, "cls").select("route", "cls", "component", "side", "sig", "text")
    more = near.repartition("route").sortWithinPartitions("route", "cls").mapInArrow(lambda batches: _joining(batches, words, percent), "a bigint, b bigint")
    all_links = written(links.union(more), "links")

    final = components(all_links).toDF("cls", "component")
    named = member.join(final, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id"))
    null = lambda c: F.nullif(F.col(c), F.lit(NONE)).alias(c)
    return named.select(null("doc_id"), "n_shingles", null("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, unchanged.

    Rows that share an id are one document and stay or go together.
    """
    name = fresh(docs, "kept_id")
    kept = near_duplicates(docs, words, percent, id_col, text_col).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def _similar(batches: Arrow) -> Arrow:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for c in ("sig_a", "sig_b"))
        yield batch.select(["a", "b"]).filter(pa.array(_agreement(a, b) >= AGREE))
