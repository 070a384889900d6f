"""Word-window and byte-window deduplication against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from llm_helpers import WORD

from stockline.llm import _anchored, substring_dedup, suffix_dedup


def removed(rows, units, window):
    """Positions covered by a window that starts earlier, per distinct row in (id, order of listing)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        if rows[i] in out:
            continue
        u, gone = units[i], set()
        for p in range(len(u) - window + 1):
            key = u[p : p + window]
            key = key if isinstance(key, bytes) else tuple(key)
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        out[rows[i]] = gone
    return out


def spans(gone):
    return sum(p - 1 not in gone for p in gone)


@pytest.fixture(params=["cold", "hot"])
def heat(request, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(_anchored, "HOT_ROWS", 3)


def test_words(corpus, make_docs, small_batches, heat):
    rows = corpus
    units = [WORD.findall(t or "") for _, t in rows]
    gone = removed(rows, units, 20)
    expected = sorted(
        (str(d), len(u), len(gone[d, t]), " ".join(w for p, w in enumerate(u) if p not in gone[d, t])) for (d, t), u in zip(rows, units)
    )
    got = substring_dedup.remove_repeated_windows(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == expected


def test_bytes(corpus, make_docs, small_batches, heat):
    rows = corpus
    units = [(t or "").encode() for _, t in rows]
    gone = removed(rows, units, 100)
    expected = sorted(
        (str(d), len(u), len(gone[d, t]), spans(gone[d, t]), bytes(b for p, b in enumerate(u) if p not in gone[d, t])) for (d, t), u in zip(rows, units)
    )
    got = suffix_dedup.remove_repeated_bytes(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expected


def test_empty_tables(make_docs):
    assert substring_dedup.remove_repeated_windows(make_docs([])).collect() == []
    assert suffix_dedup.remove_repeated_bytes(make_docs([])).collect() == []


def test_levels_double():
    assert substring_dedup.levels(20, 5) == [5, 10, 20]
    assert substring_dedup.levels(7) == [7]


@pytest.mark.parametrize("length", [3, 8, 12, 20])
@pytest.mark.parametrize("bits", [64, 4, 0])
def test_family_levels_stay_geometric(length, bits):
    """Bytes decide, whatever the fingerprints tell apart; levels at least halve and hold each fingerprint once."""
    rng = np.random.default_rng(length)

    def prints(text, n):
        return suffix_dedup._fingerprints(text, n) & np.uint64((1 << bits) - 1)

    family, seen, known = suffix_dedup.SuffixFamily(length, prints), set(), set()
    assert len(family.add(np.zeros(0, np.uint8), np.zeros(0, np.int64))) == 0
    for _ in range(48):
        text = rng.integers(97, 99 if length > 3 else 105, 100, dtype=np.uint8)
        where = np.flatnonzero(rng.random(100 - length + 1) < 0.7)
        earlier = family.add(text, where)
        known.update(prints(text, length)[where].tolist())
        for at, flag in zip(where.tolist(), earlier.tolist()):
            string = text[at : at + length].tobytes()
            assert flag == (string in seen)
            seen.add(string)
        sizes = [len(x.prints) for x in family.levels]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
    assert sorted(np.concatenate([x.prints for x in family.levels]).tolist()) == sorted(known)
    held = {x.text[at : at + length].tobytes() for x in family.levels for at in x.at.tolist()}
    assert held | family.others == seen and not held & family.others


def test_query_digest_is_of_the_kept_text(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    got = {r.doc_id: r for r in substring_dedup.remove_repeated_windows(make_docs([(1, text), (2, text + " tail")])).collect()}
    assert got[1].n_removed == 0 and got[2].kept == "tail"
    assert hashlib.sha256(got[2].kept.encode()).hexdigest()


def _bytes_result(frame):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.collect())


@pytest.mark.parametrize("cuts", [[30], [10, 20, 45, 46]])
def test_batches_added_to_a_stored_index(spark, corpus, make_docs, tmp_path, cuts):
    """Batch after batch gives the result of all at once; stored levels at least halve."""
    from stockline.llm.suffix_index import SuffixIndex

    rows = [r for r in dict.fromkeys(corpus) if r[0] is not None and r != (7, "other " * 30)]  # ids in order of batches
    whole = _bytes_result(suffix_dedup.remove_repeated_bytes(make_docs(rows)))
    index, got = SuffixIndex(spark, str(tmp_path / "index")), []
    assert index.levels() == []
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        got += _bytes_result(index.add(make_docs(rows[lo:hi])))
        sizes = [level.suffixes for level in index.levels()]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
    assert sorted(got) == whole
    for level in index.levels():
        suffixes = index._table(level, "suffixes")
        assert suffixes.count() == level.suffixes == suffixes.select("uid", "pos").distinct().count()
        for part in suffixes.rdd.glom().map(lambda p: [bytes(r["prefix"]) for r in p]).collect():
            assert part == sorted(part)  # lexicographic order in each part


def test_a_batch_that_is_known_adds_no_suffix(spark, make_docs, tmp_path):
    from stockline.llm.suffix_index import SuffixIndex

    index = SuffixIndex(spark, str(tmp_path / "index"))
    rows = [(1, "".join(chr(97 + i * i % 26) + str(i) for i in range(200))), (None, None), (2, "")]
    index.add(make_docs(rows))
    before = index.levels()
    again = index.add(make_docs([(0, rows[0][1]), (None, rows[0][1]), (5, rows[0][1] + "tail")])).collect()
    assert {r.doc_id: bytes(r.kept) for r in again} == {0: b"", None: b"", 5: b"tail"}
    assert sum(x.suffixes for x in index.levels()) <= sum(x.suffixes for x in before) + 4  # the tail's
    assert index.add(make_docs([])).collect() == []
