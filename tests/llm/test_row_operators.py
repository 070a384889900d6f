"""Operators that judge rows one by one: rules, decontamination, PII, tokens, pieces, quality model."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import WORD, lower
from pyspark.sql import functions as F

from stockline.llm import decontaminate, pii, quality_model, quality_rules, sentencepiece_codec, token_pack

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("word_bpe_49k.json")


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


# quality rules


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_rule_counts(corpus, make_docs):
    extra = [(900, "a b c a b c a b c"), (901, "x\nx\n \ny|$\nx"), (902, "one two"), (903, "a a a a")]
    rows = corpus + extra
    got = quality_rules.quality_rules(make_docs(rows)).collect()
    expected = sorted((str(d), *rule_counts(t)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("values", [1, 7, 1 << 40])
def test_rule_counts_when_window_hashes_clash(corpus, make_docs, monkeypatch, values):
    monkeypatch.setattr(quality_rules, "_window_hash", lambda *words: F.pmod(F.xxhash64(*words), F.lit(values)) * (1 << 22))
    rows = corpus[:60] + [(900, "a b c a b c a b c"), (901, "a b c d a b c e a b c"), (902, "one two"), (903, None), (904, "x y z p q r x y z")]
    got = quality_rules.measures(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_repeat_words) for r in got) == sorted((str(d), rule_counts(t)[4]) for d, t in rows)


def test_rule_filter_keeps_rows_as_they_are(make_docs):
    good = " ".join(["the house of a man that is not far from here was built"] * 1 + [f"and word{i} is" for i in range(30)])
    docs = make_docs([(1, good), (2, "### $$$ " * 60), (3, None), (None, good)])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text, r.kept) for r in kept.collect()) == [(-1, good, "x"), (1, good, "x")]
    judged = quality_rules.quality_rules(docs)
    assert judged.where("kept").count() == 2  # a filter on the result
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# decontamination


def test_decontamination(make_docs, spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(n))) for i, n in enumerate((40, 13, 5, 20))]
    items += [(10, None), (11, "?!"), (12, items[1][1])]
    words = items[0][1].split()
    rows = [
        (1, "x " * 50 + " ".join(words[3:20]).upper() + ". tail"),
        (2, "x " * 900 + ", ".join(words[0:13])),
        (3, items[2][1].replace(" ", "--")),
        (4, " ".join(words[:12])),
        (5, None),
        (6, ""),
        (7, items[1][1] + " " + items[1][1]),
        (7, "clean"),
        (None, items[3][1]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    expected = []
    for d, t in rows:
        w, hit, found = pattern.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        expected.append((str(d), len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    docs = make_docs(rows)
    got = decontaminate.contamination(docs, bench).collect()
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(((str(r.doc_id), r.n_words, r.n_hit, list(r.items), r.contaminated) for r in got), key=key) == sorted(expected, key=key)
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in clean.collect()) == sorted((str(d), t or "") for (d, t), e in zip(rows, expected) if not e[4])
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    # a benchmark too large to broadcast gives the same by a join
    joined = decontaminate.contamination(docs, bench, max_windows=1)
    assert sorted(map(str, joined.collect())) == sorted(map(str, got))
    rest = decontaminate.remove_contaminated(docs, bench, max_windows=1)
    assert rest.columns == docs.columns and sorted(map(str, rest.collect())) == sorted(map(str, clean.collect()))


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["a1@.-_ é", "0123456789. -", "+12 ().-a", "4111 1111@a.b-"])
def test_base_patterns(letters):
    rng = random.Random(letters)
    for _ in range(8000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == base_spans(text), text


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "a@", "+1(", "1.", "a.b-"):
        pii.base_spans(unit * 300_000)


def pii_rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        middle = " Zorblat wrote é jane.doe@ex.com " if i % 20 == 0 else " wrote é clown "
        rows.append((i, " ".join(rng.choice(words) for _ in range(30)) + middle + " ".join(rng.choice(words) for _ in range(30))))
    return [*rows, (1000, "only Zorblat, here"), (1001, None), (1002, ""), (None, "mail é a@b.cd 4111111111111111 and 4111-1111-1111-1112")]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_terms_that_give_an_entity_away(make_docs, monkeypatch, bound):
    monkeypatch.setattr(pii, "MAX_TERMS", bound)
    got = by_id(pii.find(make_docs(pii_rows())))
    spans = lambda d: [(s["kind"], s["start"], s["end"]) for s in got[d].spans]
    assert spans(1000) == [("term", 5, 12)] and got[1000].text == "only , here"
    assert [s[0] for s in spans(0)] == ["term", "email"] and "[EMAIL]" in got[0].text
    assert spans(1) == [] and spans(1001) == [] and got[1001].text == ""
    assert spans(None) == [("email", 7, 13), ("card", 14, 30)]


def brute_terms(rows):
    """The terms that give an entity away, with the largest P(e | t), word by word."""
    near, contexts, df, mentions = ({} for _ in range(4))
    for row, (_, text) in enumerate(rows):
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
        for w in {w for *_, w in words}:
            df[w] = df.get(w, 0) + 1
        spans = base_spans(text or "")
        for a, kind, b in spans:
            outside = lambda s, e: not any(x < e and s < y for x, _, y in spans)
            beside = [x for x in words if x[1] <= a][-8:] + [x for x in words if x[0] >= b][:8]
            beside = tuple(w for s, e, w in beside if outside(s, e))
            entity = kind, text[a:b].lower() if "@" in text[a:b] else re.sub("[^0-9.]" if kind == 1 else "[^0-9]", "", text[a:b])
            mentions.setdefault(entity, set()).add(row)
            for w in beside:
                near.setdefault((w, entity), set()).add(row)
                contexts.setdefault((w, entity), set()).add(beside)
    found = {}
    for (w, entity), held in near.items():
        p = len(held) / df[w]
        if len(contexts[w, entity]) >= 2 and p >= 0.5 and p * len(rows) / len(mentions[entity]) >= 2**4:
            found[w] = max(p, found.get(w, 0))
    return found


def test_terms_of_two_contexts(make_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    some = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, f"{some()} {some()}") for i in range(300)]
    rows += [(400, f"{some()} Quorvex wrote kim@ex.com {some()}"), (401, f"{some()} quorvex, Kim@Ex.com {some()}")]
    once = f"{some()} Onceonly solo@ex.com {some()}"
    rows += [(500, once), (501, once)]
    terms = brute_terms(rows)
    assert terms["quorvex"] == 1 and "onceonly" not in terms
    got = by_id(pii.find(make_docs(rows)))
    for d, text in rows:
        expected = {lower(text[s["start"] : s["end"]]) for s in got[d].spans if s["kind"] == "term"}
        assert expected == set(lower(text).replace(",", "").split()) & set(terms), text
    assert all("quorvex" not in got[d].text.lower() for d in (400, 401)) and "Onceonly" in got[500].text


def test_sanitise_keeps_rows_and_columns(make_docs):
    docs = make_docs([(1, "x a@b.cd y"), (1, "x a@b.cd y"), (2, None), (3, "plain")])
    clean = pii.sanitise(docs)
    assert clean.schema == docs.schema
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == [(1, "x [EMAIL] y"), (1, "x [EMAIL] y"), (2, ""), (3, "plain")]
    assert by_id(clean)[2].text is None
    assert pii.sanitise(make_docs([])).collect() == []


# token packing


def test_pack_and_unpack():
    for bits in (1, 5, 16, 17, 31, 32):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64)
        payload = token_pack.pack(ids, bits)
        assert len(payload) == 16 * bits * 8
        for start, count in ((0, 1000), (3, 7), (64, 64), (63, 130), (999, 1), (500, 0)):
            assert (token_pack.unpack(payload, bits, start, count) == ids[start : start + count]).all()


def test_tokens_are_the_library_s(spark, corpus, make_docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_pack, "BLOCK_TOKENS", 500)
    tokenizer = Tokenizer.from_file(BPE)
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    token_pack.write_tokens(make_docs(corpus), BPE, f"{tmp_path}/tokens", end_id=2)
    got = sorted(token_pack.read_tokens(spark, f"{tmp_path}/tokens").collect(), key=lambda r: r.start)
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [
        (d, s, len(i), i) for (d, _), s, i in zip(rows, starts, ids)
    ]
    flat = [x for i in ids for x in i]
    assert token_pack.token_range(spark, f"{tmp_path}/tokens", 450, 700).tolist() == flat[450:1150]
    assert zlib.crc32(bytes(got[0].ids)) == zlib.crc32(np.array(ids[0], "<u4").tobytes())


def test_chunks_of_any_characters():
    encoder = token_pack.Encoder.load(open(BPE, encoding="utf-8").read())
    rng = random.Random(3)
    latin = "".join(map(chr, range(33, 256))) + "  "
    odd = "aB c'sD \n\té中😀́Σİ 　 \x85 1½<|endoftext|>\x1c​ﬁ"
    texts = ["".join(rng.choice(s) for _ in range(rng.randint(0, 14))) for s in (latin, odd) for _ in range(5000)]
    expected = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == expected


def test_no_tokens(spark, make_docs, tmp_path):
    token_pack.write_tokens(make_docs([]), BPE, f"{tmp_path}/none", end_id=2)
    assert token_pack.read_tokens(spark, f"{tmp_path}/none").collect() == []


# SentencePiece


def test_pieces_are_the_library_s(corpus, make_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    odd = "ab c▁ \n\té中́😀  eathe n"
    rows = corpus + [(100 + i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 14)))) for i in range(2000)]
    docs = make_docs(rows)
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES, table_chunks=50), PIECES).collect()
    expected = [(str(d), library.encode(t or "")) for d, t in rows]
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted((d, i, library.decode(i)) for d, i in expected)
    assert sorted(map(tuple, sentencepiece_codec.round_trip(docs, PIECES).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert sentencepiece_codec.encode(make_docs([]), PIECES).collect() == []


# quality model


def test_quality_model_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = quality_model.score(docs, quality_model.train(docs, labels))
    assert scored.count() == docs.count()
    held = scored.where("held_out").join(labels, "doc_id").toPandas()
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.7)).all()
    assert (held.predicted == held.quality).mean() >= 0.9


def test_quality_model_edges(spark, make_docs):
    rows = [(i, "good text of many words here " * 5 if i % 2 else "$$$ ### " * 20) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "some text"), (1, rows[1][1])]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.score(docs, quality_model.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    good = [r for r in got if r.doc_id is not None and r.doc_id < 60]
    assert all(r.predicted == r.doc_id % 2 for r in good)
    crc = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    assert all(r.held_out == crc(r.doc_id) for r in got)
    for few in (labels.limit(0), labels.where("quality = 1")):
        flat = quality_model.score(docs, quality_model.train(docs, few)).select("score").distinct().collect()
        assert len(flat) == 1
    again = quality_model.train(docs.repartition(5), labels)
    assert (again.value == quality_model.train(docs, labels).value).all()


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    bench = decontaminate.benchmark_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    rules = quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    good = {r.doc_id for r in rules.where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs if r.doc_id in good]
    from test_minhash import brute

    first = {d for d, _, c, kept in brute(rows, 5) if kept}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lengths = {len(w) for w in bench}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = {}
    for d, text in rows:
        if d not in first:
            continue
        w = [x.encode() for x in pattern.findall(lower(text))]
        hit = {p for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in bench for p in range(k, k + n)}
        if hit and 20 * len(hit) >= len(w):
            continue
        spans = [(*s, False) for s in base_spans(text or "")]
        expected[d] = library.encode(pii.redact(text or "", spans))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == expected


def test_pipeline_takes_out_terms(spark, sf_dir, tmp_path):
    import corpus_pipeline
    import sentencepiece

    def before_pii(path):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, path)
        return sorted((r.doc_id, r.text) for r in docs.collect())

    one, two = (d for d, _ in before_pii(sf_dir)[:2])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = F.when(F.col("doc_id").isin(one, two), F.concat("text", F.lit(" Quorvex wrote kim@ex.com"))).otherwise(F.col("text"))
    docs.withColumn("text", named).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = before_pii(str(tmp_path))
    terms = brute_terms(rows)
    assert terms["quorvex"] == 1
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = {}
    for d, text in rows:
        base = [(*s, False) for s in base_spans(text or "")]
        words = ((m.start(), 4, m.end(), m.group()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)))
        extra = [(a, k, b, terms[w] >= 0.9) for a, k, b, w in words if w in terms and not any(x < b and a < y for x, _, y, _ in base)]
        expected[d] = library.encode(pii.redact(text or "", base + extra))
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == expected


def test_pipeline_stages_return_documents_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame((out := stage(spark, docs, sf_dir)).collect(), out.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).first()
    assert last.ids_sha256 == hashlib.sha256(",".join(map(str, last.ids)).encode()).hexdigest()
