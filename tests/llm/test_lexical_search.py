"""Ranked lexical search against plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import lower

from stockline.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _expected(docs, items, k):
    found = [(i, TERM.findall(lower(t))) for i, t in docs]
    found = [(i, len(w), Counter(w)) for i, w in found if w]
    total = sum(n for _, n, _ in found)
    holding = Counter(t for _, _, tf in found for t in tf)
    out = []
    for item, text in items:
        scores = []
        for doc, n, tf in found:
            m = 100 - 50 + (50 * n * len(found)) // total
            score = 0
            for t in set(TERM.findall(lower(text))) & tf.keys():
                w = math.floor(1000 * math.log((2 * len(found) + 2) / (2 * holding[t] + 1)))
                score += w * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score:
                scores.append((-score, -1 if doc is None else doc, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(8)
    words = [w for _, t in corpus[:40] for w in (t or "").split()]
    own = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))) for i in range(25)]
    return [*own, (90, None), (91, "?! ;"), (92, "nowhere zzzz"), (3, own[4][1]), own[5], (None, "É other OTHER, abc")]


def _items(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "item_id int, text string, query string, key string, rank string")


@pytest.mark.parametrize("k,block", [(50, 1000), (3, 7), (1, 1000)])
def test_same_as_plain_scoring(spark, make_docs, small_batches, corpus, items, k, block):
    got = ls.search(make_docs(corpus), _items(spark, items), k, block_queries=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _expected(corpus, items, k)


def test_ties_beyond_k_and_many_copies(spark, make_docs):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(1000 + i, f"here {i}") for i in range(100)]
    items = [(1, "same"), (2, "here words"), (3, "7 here")]
    got = sorted((tuple(r) for r in ls.search(make_docs(docs, 7), _items(spark, items)).collect()), key=repr)
    assert got == _expected(docs, items, 50)


def test_many_texts_to_rescore_are_joined(spark, make_docs, corpus, items, monkeypatch):
    monkeypatch.setattr(ls, "BROADCAST_TEXTS", 3)
    got = ls.search(make_docs(corpus), _items(spark, items))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _expected(corpus, items, 50)


def test_empty_tables(spark, make_docs):
    assert ls.search(make_docs([]), _items(spark, [(1, "a")])).collect() == []
    assert ls.search(make_docs([(1, "a")]), _items(spark, [])).collect() == []
    assert ls.search(make_docs([(1, None), (2, " ")]), _items(spark, [(1, "a"), (2, None)])).collect() == []


class _NoIndex(ls.Queries):
    def __init__(self, queries, documents, total, weights):
        self.items, self.documents, self.total, self.weights = [], documents, total, weights
        known = sorted({t for q in queries for t in q})
        lookups = [(i, t) for i, q in enumerate(queries) for t in q]
        self.hashes = np.array([ls.crc32(t) for t in known], np.uint32)
        self.columns = np.array([known.index(t) for _, t in lookups], np.int64)
        self.w = np.array([weights[i][t] for i, t in lookups], np.float32)
        self.asked = np.arange(len(queries))
        self.begin = np.searchsorted(np.array([i for i, _ in lookups]), self.asked)


def test_bounds_are_never_below_scores_and_prune():
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(3000)]
    docs = [[rng.choice(words[: rng.choice([30, 3000])]) for _ in range(rng.choice([1, 20, 300, 5000]))] for _ in range(200)]
    queries = [sorted(rng.sample(words, 12)) for _ in range(30)]
    weights = [{t: rng.randint(0, 20000) for t in q} for q in queries]
    block = _NoIndex(queries, len(docs), sum(map(len, docs)), weights)
    batch = ls.pa.RecordBatch.from_arrays([ls.pa.array([b" ".join(d).decode() for d in docs])], ["text"])
    rows = [b for b in ls._sketched(iter([batch]), {}) if b.column("keys")[0].as_py()]
    seen = tight = before = 0
    for b in rows:
        n = b.column("n")[0].values.to_numpy()
        slots = np.frombuffer(b.column("log_slots")[0].as_py(), np.uint8).astype(np.int64)
        codes = np.unpackbits(np.frombuffer(b.column("used")[0].as_py(), np.uint8))
        codes[codes > 0] = np.frombuffer(b.column("codes")[0].as_py(), np.uint8)
        for own, bounds in block.bounds(n, slots, codes):
            for r, line in zip(own.tolist(), bounds):
                tf = Counter(docs[before + r])
                for q in range(len(queries)):
                    score = block.score(q, tf, block.norm(len(docs[before + r])))
                    assert line[q] >= score
                    seen += 1
                    tight += line[q] <= 1.01 * score + 1
        before += len(n)
    assert seen == 200 * 30 and tight > 0.9 * seen
