"""Equality is decided on content; levels feed levels; long, empty and clashing input."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from llm_helpers import WORD

from stockline.llm import _anchored, _text, decontaminate, minhash, pii, quality_rules, substring_dedup


def _twins(order):
    """Two words of 2**order letters that every polynomial hash modulo 2**64 takes for one."""
    x = "a"
    for _ in range(order):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


ORDERS = (10, 11, 12)


def test_word_hashes_tell_all_words_apart():
    rng = random.Random(3)
    words = {"".join(rng.choice("ab\0é") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 63, 64, 65, 200]))).encode() for _ in range(3000)}
    words = sorted(words | {w.encode() for o in ORDERS for w in _twins(o)})
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    hashes = _text.word_hashes(buf, starts, ends)
    assert len(np.unique(hashes)) == len(words)
    one = [int(_text.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    assert one == hashes.tolist()  # whatever stands around it


@pytest.mark.parametrize("order", ORDERS)
def test_long_words_in_windows(make_docs, order):
    x, y = _twins(order)
    tail = " ".join(f"w{i}" for i in range(19))
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_windows(make_docs([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{y} {tail}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("order", ORDERS)
def test_long_words_in_near_duplicates(make_docs, order):
    x, y = _twins(order)
    for rows in ([(1, f"{x} p q r"), (2, f"{y} p q r")], [(1, x), (2, y)]):
        got = minhash.near_duplicates(make_docs(rows), words=4).collect()
        assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("max_windows", [1_000_000, 0])
def test_long_words_in_benchmark_windows(spark, make_docs, order, max_windows):
    x, y = _twins(order)
    tail = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, f"{x} {tail}")], "item_id int, text string")
    got = decontaminate.contamination(make_docs([(1, f"{y} {tail}"), (2, f"{x} {tail}")]), bench, max_windows=max_windows).collect()
    assert {r.doc_id: r.n_hit for r in got} == {1: 0, 2: 13}


def test_a_hit_of_the_join_is_verified(spark, make_docs, monkeypatch):
    """With every window under one hash, the words alone decide, on either branch."""
    rows = [(1, "a b c d"), (2, "x a b"), (3, "b a"), (4, None)]
    bench = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "item_id int, text string")
    plain = sorted(map(str, decontaminate.contamination(make_docs(rows), bench).collect()))
    batch = decontaminate._Words(next(iter(_text.slices(decontaminate.pa.array(["a b c"])))))
    assert (batch.content(0, 2), batch.content(1, 2)) == (b"a\0b", b"b\0c")
    joined = decontaminate.contamination(make_docs(rows), bench, max_windows=0)
    assert sorted(map(str, joined.collect())) == plain
    found = [{"pos": 0, "n": 2, "item": "9", "words": b"a\0c"}, {"pos": 1, "n": 2, "item": "8", "words": b"b\0c"}]
    kind = decontaminate.pa.list_(decontaminate.pa.struct([("pos", "int64"), ("n", "int64"), ("item", "string"), ("words", "binary")]))
    one = decontaminate.pa.RecordBatch.from_arrays(
        [decontaminate.pa.array([1]), decontaminate.pa.array(["a b c"]), decontaminate.pa.array([found], kind)], ["doc_id", "text", "found"]
    )
    (out,) = decontaminate._marked(iter([one]))
    assert out.to_pylist()[0]["items"] == ["8"] and out.to_pylist()[0]["n_hit"] == 2


def test_each_level_looks_at_survivors_only(spark, make_docs, corpus, monkeypatch):
    tables = {}
    write = _anchored.written

    def kept(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(_anchored, "written", kept)
    rows = [*corpus, (900, " ".join(f"u{i}" for i in range(300))), (901, " ".join(f"u{i}" for i in range(5)) + " " + " ".join(f"v{i}" for i in range(300)))]
    substring_dedup.remove_repeated_windows(make_docs(rows)).collect()
    places = {name: {(r["uid"], r["pos"]) for r in t.collect()} for name, t in tables.items()}
    assert list(places) == ["level-5", "anchors"]  # 5 words, 10 words; the windows of 20 are the result
    assert places["anchors"] < places["level-5"]
    texts = {r["uid"]: WORD.findall(r["text"]) for r in _anchored.identified(make_docs(rows), "doc_id", "text").collect()}
    for name, n in (("level-5", 5), ("anchors", 10)):
        grams = {}
        for words in [w for w in texts.values()]:
            for i in range(len(words) - n + 1):
                grams[tuple(words[i : i + n])] = grams.get(tuple(words[i : i + n]), 0) + 1
        assert all(grams[tuple(texts[u][p : p + n])] > 1 for u, p in places[name])
    windows = _anchored.Windows(True, 20, 10, [5])
    anchors = sum(len(windows.anchors(p)[2]) for p in _text.slices(decontaminate.pa.array([" ".join(w) for w in texts.values()])))
    assert len(places["level-5"]) < anchors  # words found once fall out at the first level
    longer = substring_dedup.remove_repeated_windows(make_docs(corpus), shortest=3).collect()
    assert sorted(map(str, longer)) == sorted(map(str, substring_dedup.remove_repeated_windows(make_docs(corpus), shortest=20).collect()))


def test_spans_of_a_text_of_many_mails_and_terms():
    n = 100_000
    text = "".join(f"a{i}@b.cc quorvex " for i in range(n))
    part = next(iter(_text.slices(decontaminate.pa.array([text]))))
    known = np.array([pii._term_key("quorvex")] if hasattr(pii, "_term_key") else [], np.uint64)
    if not len(known):
        words = pii._Words(part)
        known = np.unique(words.hash[(words.end - words.start) == 7])
    began = time.monotonic()
    ((_, _, (spans,)),) = pii._found(decontaminate.pa.array([text]), known, np.zeros(len(known), bool))
    assert time.monotonic() - began < 5
    assert sum(s[1] == 0 for s in spans) == n and sum(text[s[0] : s[2]] == "quorvex" for s in spans if s[1] == 4) == n


def test_terms_apart_from_base_spans():
    rng = random.Random(5)
    for _ in range(300):
        cut = lambda: sorted((a, 0, a + rng.randint(1, 8), False) for a in rng.sample(range(60), rng.randint(0, 9)))
        terms, base = cut(), cut()
        assert pii._apart(terms, base) == [t for t in terms if not any(a < t[2] and t[0] < b for a, _, b, _ in base)]


def test_columns_with_the_operators_own_names(spark, monkeypatch):
    names = ["kept_id", "KEPT_ID_", "bad_text", "text_key", "own_key", "own_terms", "__kept", "__bad", "__terms", "__key", "__k"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, f"name{i % 3} quorvex kim@ex.com writes text number {i} of these", *names) for i in range(6)]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, "text number 3 of these")], "item_id int, text string")
    assert minhash.keep_one_of_each(docs).columns == docs.columns
    for limit in (1_000_000, 0):
        assert {r.doc_id for r in decontaminate.remove_contaminated(docs, bench, max_windows=limit).collect()} == {0, 1, 2, 4, 5}
        monkeypatch.setattr(pii, "MAX_TERMS", limit)
        clean = pii.sanitise(docs)
        assert clean.columns == docs.columns
        assert all("kim" not in r.text and r.own_key == "own_key" for r in clean.collect())


def test_empty_tables(spark, make_docs, tmp_path):
    import corpus_pipeline
    from stockline.llm import quality_model

    none = make_docs([])
    bench = spark.createDataFrame([], "item_id int, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.score(none, quality_model.train(none, labels)).collect() == []
    assert quality_rules.quality_rules(none).collect() == [] and quality_rules.keep_good(none).collect() == []
    for limit in (1_000_000, 0):
        assert decontaminate.contamination(none, bench, max_windows=limit).collect() == []
        assert decontaminate.remove_contaminated(none, bench, max_windows=limit).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
