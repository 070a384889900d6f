from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

EXTRA = ("k", "term", "kept", "n_words", "uid", "ids", "spans", "row", "label", "w", "t", "route", "bands", "component_id")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Frame of (doc_id, text) rows with extra columns whose names operators use themselves."""

    def make(rows, parts=3):
        fields = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
        frame = spark.createDataFrame([(*r, *("x" for _ in EXTRA)) for r in rows], fields)
        return frame.repartition(parts) if rows else frame

    return make


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.fixture(scope="session")
def corpus():
    """Texts that share passages, with copies, empty and null texts, one long text, and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(40)]

    def words(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = [words(rng.randint(1, 120)) for _ in range(20)]
    texts = []
    for _ in range(60):
        kind = rng.random()
        if kind < 0.2:
            texts.append(rng.choice(base))
        elif kind < 0.6:
            a, b = rng.choice(base), rng.choice(base)
            texts.append(a[rng.randint(0, len(a)) :] + rng.choice([" ", "\n", "", " x "]) + b[: rng.randint(0, len(b))])
        elif kind < 0.7:
            texts.append(rng.choice(["", None, "a" * 300, "ab " * 90, " \n\t ", "q " * 25]))
        else:
            texts.append(words(rng.randint(1, 120)))
    texts.append(words(20_000))
    rows = list(enumerate(texts))
    return [*rows, rows[5], (7, "other " * 30), (None, rows[9][1])]
