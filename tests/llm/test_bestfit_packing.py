"""Best-fit packing: exact content, gapless places, bounded bins, few sequences."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stockline.llm import bestfit_packing as bp
from stockline.llm import token_pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def _expected(rows, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    out = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out[doc_id, piece, start, len(part), np.array(part, "<u4").tobytes()] += 1
    return out


@pytest.mark.parametrize("capacity,open_bins", [(64, 2), (64, 1000), (4096, 1024)])
def test_every_piece_once_and_gapless(make_docs, corpus, small_batches, capacity, open_bins):
    sequences = bp.pack(make_docs(corpus), PATH, 1, capacity, open_bins)
    got = [tuple(r) for r in bp.pieces(sequences).collect()]
    assert Counter((d, p, s, n, bytes(i)) for d, p, s, n, i, _, _ in got) == _expected(corpus, capacity)
    places = defaultdict(list)
    for _, _, _, length, _, sequence, offset in got:
        places[sequence].append((offset, length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    bins: list[int] = []  # all pieces in one place, longest first, each where it fits best
    for size in sorted((n for _, _, _, n, *_ in got), reverse=True):
        best = max((b for b in range(len(bins)) if bins[b] + size <= capacity), key=bins.__getitem__, default=None)
        if best is None:
            bins.append(size)
        else:
            bins[best] += size
    assert len(places) <= (1.25 if open_bins == 2 else 1.01) * len(bins) + 1


def test_sequences_of_several_tasks_are_joined(make_docs):
    rows = [(i, "word " * (i % 13)) for i in range(400)]
    sequences = bp.pack(make_docs(rows, 8), PATH, 1, 256)
    found = sequences.collect()
    tokens = sum(r["n_tokens"] for r in found)
    assert len({r["sequence_id"] for r in found}) == len(found) <= -(-tokens // 256) + 1


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert bp.pieces(bp.pack(make_docs([]), PATH, 1)).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x", "x", "x", "x")], "doc_id long, text string, ids string, parts string, width string, settled string")
    (row,) = bp.pieces(bp.pack(docs, PATH, 1)).collect()
    assert (row["doc_id"], row["length"], row["offset"], row["start"]) == (1, 3, 0, 0)


def test_open_bins_against_a_search_of_all_bins():
    rng = random.Random(4)
    for limit in (1, 3, 50):
        bins, plain, closed, wanted = bp.OpenBins(30, limit), [], [], []
        for item in range(500):
            size = rng.randint(1, 30)
            one = bins.place(size, (size, item))
            if one:
                closed.append(sum(s for s, _ in one))
            fits = [b for b in plain if 30 - sum(b) >= size]
            best = max(fits, key=sum, default=None)
            if best is None:
                plain.append(best := [])
            best.append(size)
            full = [b for b in plain if sum(b) == 30] or (sorted(plain, key=sum)[-1:] if len(plain) > limit else [])
            for b in full:
                plain.remove(b)
                wanted.append(sum(b))
            assert bins.count == len(plain) <= limit
            assert bins.bits == sum(1 << f for f in {30 - sum(b) for b in plain})
        assert closed == wanted
        assert sorted(30 - f for f, _ in bins.rest()) == sorted(map(sum, plain))


def test_words_that_differ_in_case_alone_are_tokenised_once():
    with open(PATH, encoding="utf-8") as f:
        encoder = token_pack.Encoder(f.read(), 100)
    encoder.chunks.clear()
    texts = ["Word wORD\tword ÀÉ àé", "KİΣ Word ΑΣ", "<|endoftext|> Word Word's", "¡Þ\xad×\x85Ÿ \xa0Ð"]
    found = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)]
    assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.chunks.clear()
    encoder.encode(texts[:1])
    assert sorted(encoder.chunks) == ["word", "àé"]
