"""Filter interaction audit against a count of every order by hand."""

from __future__ import annotations

import random
import re
from itertools import permutations

from llm_helpers import WORD

from stockline.llm import filter_audit


def _fails(rows):
    """{row number: set of letters} by the plain rules."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in rows),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def _expected(rows, labels):
    fails = _fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = set()
    for part in {p or "" for _, _, p in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        steps = {}
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for i, name in enumerate(order):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(gone)
                steps["".join(order), i + 1] = name, len(left), gone
        for (order, step), (name, kept, gone) in steps.items():
            failing = sum(name in f for _, f in own)
            alone = sum(f == {name} for _, f in own)
            out.add((part, order, step, kept, len(gone), failing - len(gone), alone,
                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), shapley[name]))
    return out


def _corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [None, "", " \n", "A" * 400, "x " * 80, "ab cd " * 60, "| " + "y" * 9000]
    for _ in range(60):
        t = " ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.choice([5, 49, 50, 90, 120])))
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.3:
            t += rng.choice("#$%&*|")
        texts.append(t)
    texts += rng.choices(texts, k=40)
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    rows += [rows[9], rows[70], (None, texts[8], "a"), (None, None, "c"), (3, "another text of id 3", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, len(texts), 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def _frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "doc_id long, text string, source string, part string, digest string, mask string, good string")
    return docs, spark.createDataFrame([(*r, "x", "x") for r in labels], "doc_id long, quality int, toxic int, good string, n string")


def test_every_order_step_and_part(spark, small_batches):
    rows, labels = _corpus()
    docs, marks = _frames(spark, rows, labels)
    got = [tuple(r) for r in filter_audit.audit(docs.repartition(5), marks).collect()]
    want = _expected(rows, labels)
    assert len(got) == len(set(got)) == 600 * len({p or "" for _, _, p in rows})
    assert set(got) == want


def test_empty_tables(spark):
    docs, marks = _frames(spark, [], [])
    assert filter_audit.audit(docs, marks).collect() == []
    docs, marks = _frames(spark, [(1, "x", "s")], [])
    rows = filter_audit.audit(docs, marks).collect()
    assert len(rows) == 600 and sum(r["removed"] for r in rows) == 120 and sum(r["good_lost"] for r in rows) == 0


def test_plain_changes_reach_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_swaps_keep_the_counts_and_share_nodes():
    rng = random.Random(1)
    weights = {m: (rng.randint(0, 3), rng.randint(0, 1)) for m in range(16)}
    d = filter_audit.Diagram(weights, 4)
    for level in filter_audit.plain_changes(4):
        d.swap(level)
        fresh = filter_audit.Diagram(
            {sum(1 << i for i, v in enumerate(d.order) if m >> v & 1): w for m, w in weights.items()}, 4
        )
        assert d.weight[d.root] == fresh.weight[fresh.root]
        assert [s[1:] for s in d.steps()] == [s[1:] for s in fresh.steps()]
        assert [len(x) for x in d.levels] == [len(x) for x in fresh.levels]
        assert set(d.weight) == {0, *d.leaves.values(), *(n for x in d.levels for n in x.values())}
