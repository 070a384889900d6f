"""Language-model scores: exact base counts, filter levels, groups and segments."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import WORD, lower

from stockline.llm import lm_score


def tokens(text):
    return [*WORD.findall(lower(text)), "\0end"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _expected(rows):
    """(id, tokens, held out, known, training tokens, base score, score with exact counts in place of the filter's)."""
    counts, pairs, before = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in rows:
        if not held(d):
            x = tokens(t)
            counts.update(x)
            pairs.update(zip(["\0begin", *x], x))
            before.update(["\0begin", *x[:-1]])
    scale = sum(counts.values()) + 0.5 * (len(counts) + 1)
    mid = lambda c: 1.5 * 2 ** math.floor(math.log2(c)) - 0.5 if c else 0.0
    out = []
    for d, t in rows:
        x = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / scale) for w in x)
        terms = (
            math.log10((mid(pairs[v, w]) + lm_score.MU * (counts[w] + 0.5) / scale) / (mid(before[v]) + lm_score.MU))
            for v, w in zip(["\0begin", *x], x)
        )
        out.append((str(d), len(x), held(d), sum(counts[w] > 0 for w in x), sum(counts.values()), base, sum(terms)))
    return sorted(out)


def _got(frame):
    return sorted((str(r.doc_id), r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in frame.collect())


@pytest.fixture(scope="module")
def rows(corpus):
    return [*corpus, *((d, "never seen words " * 40) for d in range(200, 230) if held(d))]


@pytest.mark.parametrize("group, bucket", [(8 << 20, 4 << 20), (5000, 1 << 30), (20_000, 3000), (1, 50_000)])
def test_scores_of_every_number_of_groups_and_segments(rows, make_docs, group, bucket):
    """Base figures are exact; a filter with room has no stray bits, so the score is that of exact counts."""
    got = _got(lm_score.score(make_docs(rows), group_bytes=group, bucket_bytes=bucket, bits_per_entry=64))
    for g, e in zip(got, _expected(rows), strict=True):
        assert g[:5] == e[:5]
        assert g[5] == pytest.approx(e[5], rel=1e-9)
        assert g[6] == pytest.approx(e[6], rel=0.01)


@pytest.mark.parametrize("bucket", [4 << 20, 10_000])
def test_score_at_the_production_filter(rows, make_docs, bucket):
    """At BITS_PER_ENTRY bits stray bits lift a term for about one unseen pair in 90; a text's mean term moves little."""
    got = _got(lm_score.score(make_docs(rows), bucket_bytes=bucket))
    off = []
    for g, e in zip(got, _expected(rows), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9)
        off.append((g[6] - e[6]) / e[1])
    assert min(off) > -0.05 and np.mean(off) < 0.08


def test_long_words_that_one_polynomial_hash_confuses(make_docs):
    """Thue-Morse words and their complements: different tokens, different counts."""
    for order in (10, 11, 12):
        x = "a"
        for _ in range(order):
            x += x.translate(str.maketrans("ab", "ba"))
        y = x.translate(str.maketrans("ab", "ba"))
        texts = [(i, x if i % 3 else y) for i in range(40)]
        for g, e in zip(_got(lm_score.score(make_docs(texts))), _expected(texts), strict=True):
            assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9)


def test_bigrams_seen_once_count():
    """Half of v's bigrams are seen once: with them P(. | v) adds up to 1."""
    texts = pa.chunked_array([pa.array([f"v only{i} v often" for i in range(80)])])
    group = lm_score._Group(texts)
    segment = lm_score.Filter(group.keys, group.counts(np.ones(80, bool)), 64)
    after = np.unique(group.token[1:][group.token[:-1] == group.token[0]])
    n = lm_score.middle(segment.levels(lm_score.bigrams(np.full(len(after), group.token[0]), after)), lm_score.MIN_BIGRAM)
    assert len(after) == 81 and sorted(n)[:80] == [1.0] * 80
    # a level's middle stands for its counts: 64 .. 127 by 95.5
    assert n.sum() == pytest.approx(80 + 95.5, rel=0.05)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1 << 62, 1 << 63, 20_000, dtype=np.uint64) | np.uint64(1))
    counts = rng.integers(1, 500, len(keys))
    levels = lm_score.level(counts, 1)
    segment = lm_score.Filter(keys, counts)
    assert (segment.levels(keys) >= levels).all()
    assert (segment.levels(keys) == levels).mean() > 0.95
    others = rng.integers(0, 1 << 61, 20_000, dtype=np.uint64)
    assert (segment.levels(others) > 0).mean() < 0.02


def test_group_counts_and_buckets():
    texts = pa.chunked_array([pa.array(["a b a", "", "b"])])
    group = lm_score._Group(texts)
    n = group.counts(np.array([True, True, False]))
    of = lambda key: n[np.searchsorted(group.keys, key)]
    a, b = group.token[0], group.token[1]
    assert (of(a), of(b), of(lm_score.END), of(lm_score.BEGIN)) == (2, 1, 2, 2)
    assert of(lm_score.bigrams(np.array([a]), np.array([b]))[0]) == 1
    assert of(lm_score.bigrams(np.array([lm_score.BEGIN]), np.array([b]))[0]) == 0  # in the third text only
    for log_buckets in (0, 1, 5):
        cuts = lm_score._cuts(group.keys, log_buckets)
        assert len(cuts) == (1 << log_buckets) + 1 and (cuts[0], cuts[-1]) == (0, len(group.keys))
        for i, k in enumerate(group.keys.tolist()):
            bucket = int(np.searchsorted(cuts, i, side="right")) - 1
            assert bucket == (k >> (64 - log_buckets) if log_buckets else 0)


def test_packed_keys():
    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (lm_score._unpack(lm_score._pack(keys)) == keys).all()


def test_edges(make_docs):
    assert lm_score.score(make_docs([])).collect() == []
    only_held = [i for i in range(100) if held(i)][:3]
    got = lm_score.score(make_docs([(i, "a b") for i in only_held])).collect()
    assert {(r.train_tokens, r.n_known, r.n_tokens) for r in got} == {(0, 0, 3)}
    assert all(np.isfinite(r.base_score) and np.isfinite(r.score) for r in got)
