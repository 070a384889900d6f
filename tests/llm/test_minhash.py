"""Near-duplicate components against all-pairs comparison of full sets."""

from __future__ import annotations

import random

import pytest
from llm_helpers import WORD, lower

from stockline.llm import minhash


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 2, 30])):
            words = list(base)
            for _ in range(rng.randint(0, len(words) * 8 // 100 + 1)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else text))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  b"), (n + 4, "a"), rows[3], (None, rows[0][1])]
    rng.shuffle(rows)
    return rows


def brute(rows, words):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] == rows[b][0]
            both = len(sets[a] & sets[b])
            if same_id or (sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)):
                parent[find(a)] = find(b)
    key = [-1 if d is None else d for d, _ in rows]
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), key[a]), key[a])
    return sorted((key[a], len(sets[a]), least[find(a)], key[a] == least[find(a)]) for a in range(len(rows)))


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3)])
def test_components_match_all_pairs(make_docs, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_copies(seed)
    got = minhash.near_duplicates(make_docs(rows), words=4).collect()
    null = lambda x: -1 if x is None else x
    assert sorted((null(r.doc_id), r.n_shingles, null(r.component_id), r.kept) for r in got) == brute(rows, 4)


def test_members_of_different_components_meet_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(8)
    placed = [(key, cls, rng.choice([1, 1, 1, 1, 2, 3, 50 + cls])) for key in range(6) for cls in rng.sample(range(100), 30)]
    placed += [(7, c, 1) for c in range(20)]  # settled
    placed += [(8, cls, component) for key, cls, component in placed if key == 0]  # the members of another bucket
    routes = minhash._routes(spark.createDataFrame(placed, "key bigint, cls bigint, component bigint")).collect()
    tasks = {}
    for r in routes:
        tasks.setdefault(r.route, ([], []))[r.side].append((r.cls, r.component))
    met = []
    for left, right in tasks.values():
        pairs = [(a, b) for a in left for b in right] if right else [(a, b) for i, a in enumerate(left) for b in left[:i]]
        met += [tuple(sorted((a[0], b[0]))) for a, b in pairs if a[1] != b[1]]
        assert len(left) < 30 and len(right) < 30
    want = []
    for key in range(6):
        members = [(cls, component) for k, cls, component in placed if k == key]
        want += [tuple(sorted((a[0], b[0]))) for i, a in enumerate(members) for b in members[:i] if a[1] != b[1]]
    assert sorted(met) == sorted(want)


def test_a_large_open_bucket_has_few_rows_a_member(spark):
    member = spark.range(100_000).selectExpr("1L as key", "id as cls", "CASE WHEN id < 95000 THEN 0 ELSE id div 1000 END as component")
    assert minhash._routes(member).count() < 20 * 100_000


def test_stage_keeps_the_rows_of_the_smallest_id(make_docs):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(4, text), (2, text), (9, text + " more"), (5, "something else entirely here now"), (6, None), (7, "")]
    docs = make_docs(rows)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7]


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []
