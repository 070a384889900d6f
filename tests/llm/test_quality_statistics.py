"""Statistics of texts against plain counts; the flat forest against a walk node by node."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import WORD

from stockline.llm import _text, quality_model

CLASSES = {
    "space": b" \t\x0b\x0c\r", "newline": b"\n", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789",
    "stop": b".?", "comma": b",;:", "shout": b"!", "pipe": b"|", "symbol": b"#*$%&<>@=+^~_\\/{}[]",
}


def _plain(text):
    data = (text or "").encode()
    counts = {name: sum(b in chars for b in data) for name, chars in CLASSES.items()}
    counts["non_ascii"] = sum(b > 127 for b in data)
    counts["other_ascii"] = len(data) - sum(counts.values())
    words = [w.encode() for w in WORD.findall(text or "")]
    lines = [x for x in data.split(b"\n") if x]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    share = lambda a, b: a / max(b, 1)
    top = lambda x: max(Counter(x).values(), default=0)
    out = {f"{name} per byte": share(n, len(data)) for name, n in counts.items()}
    out |= {"log bytes": math.log1p(len(data)), "log words": math.log1p(len(words)), "log lines": math.log1p(len(lines))}
    out |= {
        "bytes per word": share(len(data) - counts["space"] - counts["newline"], len(words)),
        "longest word": max(map(len, words), default=0),
        "words per line": share(len(words), len(lines)),
        "distinct words": share(len(set(words)), len(words)),
        "top word share": share(top(words), len(words)),
        "equal neighbours": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "repeated 3-grams": share(len(grams) - len(set(grams)), len(grams)),
        "distinct lines": share(len(set(lines)), len(lines)),
        "repeated line words": share(top(lines), len(lines)),
    }
    out |= {f"{k}s per word": share(counts[k], len(words)) for k in ("shout", "pipe", "symbol")}
    return [out[name] for name in quality_model.STATISTICS]


def test_statistics_are_plain_counts(corpus):
    texts = [t for _, t in corpus] + ["One! two|three.\n\nOne! two|three.\n#a #a #a b,c; d?", "x\ty\x0bz\r\n\x7f\0é😀", "a b c a b c a b c"]
    found = np.concatenate([quality_model.statistics(p) for p in _text.slices(pa.array(texts, pa.string()), 4000)])
    assert found.shape == (len(texts), len(quality_model.STATISTICS))
    for text, row in zip(texts, found):
        assert row.tolist() == pytest.approx(_plain(text), rel=1e-12), text


def _walk(forest, x):
    total = forest.prior
    for node in forest.roots.tolist():
        while forest.left[node] >= 0:
            node = int(forest.left[node] if x[forest.statistic[node]] <= forest.threshold[node] else forest.right[node])
        total += forest.value[node]
    return 1 / (1 + math.exp(-total))


def test_forest_scores_are_those_of_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, len(quality_model.STATISTICS)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    forest = quality_model.fit(x, y)
    score = forest.score(x)
    assert score.tolist() == pytest.approx([_walk(forest, row) for row in x], rel=1e-9)
    assert ((score > 0.5) == y).mean() > 0.95


def test_first_split_is_the_best_of_all():
    """One statistic tells the classes apart: the first tree splits there, between the classes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(quality_model.STATISTICS)))
    x[:, 11] = rng.permutation(300)
    y = (x[:, 11] >= 120).astype(float)
    forest = quality_model.fit(x, y)
    gain = []
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j])
        g = np.cumsum((y.mean() - y)[order])[:-1]
        h = np.arange(1, 300) * y.mean() * (1 - y.mean())
        rest = h[-1] + h[0] - h
        gain.append((g**2 / (h + quality_model.L2) + g**2 / (rest + quality_model.L2)).max())
    root = int(forest.roots[0])
    assert int(np.argmax(gain)) == forest.statistic[root] == 11
    assert 110 <= forest.threshold[root] <= 125  # 64 bins of 300 rows
