"""Personal data: patterns, and terms that give protected entities away.

The patterns (e-mail, IPv4, card and phone numbers) find the protected entities.
A term that keeps turning up beside one entity identifies it as well as the
entity itself would, so the corpus decides what else must go:

* every mention of an entity, however spelt, contributes the terms within
  ``RADIUS`` words of it;
* ``near(t, e)``: texts in which t is that close to e, ``contexts``: different
  stretches of words it happened in (copies of one passage count once);
* ``df(t)``: texts that hold t at all, over the whole corpus;
* t discloses e if P(e | t) = near / df reaches ``GENERALISE`` and tells at least
  ``MIN_BITS`` bits, log2(P(e | t) / P(e)), on ``MIN_CONTEXTS`` contexts or more.
  Two contexts are the least that repeats: a word found once has P(e | t) = 1
  whatever it stands beside.

Disclosing terms become spans of kind ``term`` wherever they stand.  In the
sanitised text, entities and terms are generalised to their kind
(``[EMAIL]``, ``[TERM]``), and terms with P(e | t) >= ``REMOVE`` are removed.

Statistics are aggregated over all texts with one row per batch and key before
the shuffle, so neither a frequent word nor an entity that a third of all texts
mention makes one task large.  The disclosing terms are broadcast if there are at
most ``MAX_TERMS``; a longer list is joined with the words of the texts instead.

Edge cases: null texts are empty and hold no spans; an empty table yields empty
statistics; copies and repeated rows get equal spans; spans of one kind do not
overlap, spans of different kinds may; offsets count characters, ends are
exclusive; scans are linear in the text's length (no pattern retries inside a
run); only the id and text columns are read, ``sanitise`` keeps all columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm import _text
from stockline.llm._store import fresh, written
from stockline.llm.decontaminate import IS_WORD

KINDS = ("email", "ip", "card", "phone", "term")
RADIUS = 8
MIN_CONTEXTS = 2
MIN_BITS = 4.0
GENERALISE = 0.5
REMOVE = 0.9
MAX_TERMS = 1_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts at a run's first digit or behind the match before, which ends where its run does
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

Span = tuple[int, int, int]  # start, kind, end
Arrow = Iterator[pa.RecordBatch]


def _emails(text: str) -> Iterator[Span]:
    floor, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            yield lo, 0, domain.end()
            floor = domain.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Pattern matches by start, then kind: (start, index into KINDS, end)."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = (p.lstrip("0") for p in m.group().split("."))
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


class _Words:
    """Words of a slice, lower-cased A-Z, with their hashes and texts."""

    def __init__(self, part: _text.Slice):
        buf = _text.LOWER[part.buf]
        self.start, self.end, self.first = _text.spans(buf, part.off, IS_WORD)
        self.hash = _text.word_hashes(buf, self.start, self.end)


def _char_to_byte(text: str, chars: list[int]) -> list[int]:
    if text.isascii():
        return chars
    out, at, size = [], 0, 0
    for c in chars:  # ascending
        size += len(text[at:c].encode())
        at = c
        out.append(size)
    return out


def _byte_to_char(data: bytes, ats: list[int]) -> list[int]:
    out, at, size = [], 0, 0
    for b in ats:  # ascending, on character borders
        size += len(data[at:b].decode("utf-8", "replace"))
        at = b
        out.append(size)
    return out


def _entity(kind: int, text: str) -> str:
    """One name for all spellings of an entity: e-mails lower-cased, numbers by their digits."""
    if KINDS[kind] == "email":
        return f"email:{text.lower()}"
    if KINDS[kind] == "ip":
        return f"ip:{'.'.join(p.lstrip('0') or '0' for p in text.split('.'))}"
    return f"{KINDS[kind]}:{''.join(_DIGIT.findall(text))}"


def _hash_text(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(_text.word_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])


def _mentions(batches: Arrow) -> Arrow:
    """Rows (term, entity, context, uid): a term near a mention of an entity; term null: the mention itself."""
    for batch in batches:
        uid = batch.column("uid").to_numpy()
        for part in _text.slices(batch.column("text")):
            texts = batch.column("text").slice(part.lo, part.hi - part.lo).to_pylist()
            found = [(i, base_spans(t)) for i, t in enumerate(texts) if t]
            if not any(s for _, s in found):
                continue
            words = _Words(part)
            rows: list[tuple[np.ndarray, int, int, int]] = []
            for i, spans in found:
                if not spans:
                    continue
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                starts, ends = words.start[lo:hi], words.end[lo:hi]
                edges = _char_to_byte(texts[i], sorted({x for s in spans for x in (s[0], s[2])}))
                byte = dict(zip(sorted({x for s in spans for x in (s[0], s[2])}), edges))
                inside = np.zeros(hi - lo, bool)
                borders = []
                for a, kind, b in spans:
                    k0 = int(np.searchsorted(ends, byte[a] + part.off[i], side="right"))
                    k1 = int(np.searchsorted(starts, byte[b] + part.off[i]))
                    inside[k0:k1] = True
                    borders.append((k0, k1, _hash_text(_entity(kind, texts[i][a:b]))))
                for k0, k1, entity in borders:
                    near = np.append(np.arange(max(0, k0 - RADIUS), k0), np.arange(k1, min(hi - lo, k1 + RADIUS)))
                    terms = words.hash[lo + near[~inside[near]]]
                    context = int(_text.ranges(_text.prefix(terms), np.array([0]), np.array([len(terms)])).view(np.int64)[0])
                    rows.append((np.unique(terms).view(np.int64), entity, context, int(uid[part.lo + i])))
            size = [len(r[0]) for r in rows]
            columns = [pa.array(np.concatenate([r[0] for r in rows]))]
            columns += [pa.array(np.repeat(np.array([r[k] for r in rows], np.int64), size)) for k in (1, 2, 3)]
            mention = [pa.nulls(len(rows), pa.int64())] + [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
            names = ["term", "entity", "context", "uid"]
            yield pa.RecordBatch.from_arrays(columns, names)
            yield pa.RecordBatch.from_arrays(mention, names)


def _frequencies(batches: Arrow) -> Arrow:
    """Rows (term, n): texts of the batch that hold a term."""
    for batch in batches:
        found = []
        for part in _text.slices(batch.column("text")):
            words = _Words(part)
            if len(words.hash):
                text = np.repeat(np.arange(part.hi - part.lo), np.diff(words.first))
                order = np.lexsort((text, words.hash))
                h, t = words.hash[order], text[order]
                found.append(h[np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))])
        if found:
            term, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table: term (hash), disclosure (the largest P(e | t)) of terms above the thresholds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("i"), text.alias("text")).select("text", F.xxhash64("i", "text").alias("uid"))
    rows = texts.mapInArrow(_mentions, "term bigint, entity bigint, context bigint, uid bigint")
    # one row per (term, entity, context) and text first: a frequent entity is spread over its contexts
    seen = written(rows.distinct(), "mentions")
    in_texts = seen.select("term", "entity", "uid").distinct().groupBy("term", "entity").agg(F.count("*").alias("near"))
    in_contexts = seen.select("term", "entity", "context").distinct().groupBy("term", "entity").agg(F.count("*").alias("contexts"))
    pairs = in_texts.where("term IS NOT NULL").join(in_contexts.where(f"contexts >= {MIN_CONTEXTS}"), ["term", "entity"])
    entities = in_texts.where("term IS NULL").select("entity", F.col("near").alias("entity_texts"))
    frequency = texts.mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))
    total = max(docs.count(), 1)
    share = F.least(F.col("near") / F.col("df"), F.lit(1.0))
    bits = F.log2(share * F.lit(float(total)) / F.col("entity_texts"))
    found = pairs.join(entities, "entity").join(frequency, "term").where((share >= GENERALISE) & (bits >= MIN_BITS))
    return written(found.groupBy("term").agg(F.max(share).alias("disclosure")), "disclosing")


def _term_spans(part: _text.Slice, known: np.ndarray, remove: np.ndarray, texts: list[str]) -> dict[int, list[tuple[int, int, int, bool]]]:
    """Per text, the spans of disclosing terms: start, kind, end, whether removed."""
    out: dict[int, list[tuple[int, int, int, bool]]] = {}
    if not len(known):
        return out
    words = _Words(part)
    k = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    hits = np.flatnonzero(known[k] == words.hash)
    cut = np.searchsorted(hits, words.first)  # hits are in order of texts
    for i in np.flatnonzero(np.diff(cut)).tolist():
        own = hits[cut[i] : cut[i + 1]]
        base = int(part.off[i])
        data = texts[i].encode()
        edges = np.stack((words.start[own], words.end[own]), axis=1).reshape(-1) - base
        chars = _byte_to_char(data, edges.tolist())
        out[i] = [(chars[2 * j], 4, chars[2 * j + 1], bool(remove[k[w]])) for j, w in enumerate(own.tolist())]
    return out


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Entities and terms replaced by their kind, removed terms left out."""
    out, at = [], 0
    for start, kind, end, gone in sorted(spans):
        if start >= at:
            out.append(text[at:start])
            out.append("" if gone else f"[{KINDS[kind].upper()}]")
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def _apart(terms: list[tuple], base: list[tuple]) -> list[tuple]:
    """The terms that no base span overlaps; both are in order of their starts."""
    starts = [s[0] for s in base]
    reach = list(accumulate((s[2] for s in base), max))  # the furthest end up to each span
    return [t for t in terms if not (n := bisect_left(starts, t[2])) or reach[n - 1] <= t[0]]


def _found(column: pa.Array, known: np.ndarray, remove: np.ndarray) -> Iterator[tuple[int, list[str], list[list]]]:
    """Slices of a text column: first row, texts, and per text all spans, in order."""
    for part in _text.slices(column):
        texts = [t or "" for t in column.slice(part.lo, part.hi - part.lo).to_pylist()]
        terms = _term_spans(part, known, remove, texts)
        spans = []
        for i, t in enumerate(texts):
            base = [(*s, False) for s in base_spans(t)]
            extra = _apart(terms.get(i, []), base)
            spans.append(sorted(base + extra) if extra else base)
        yield part.lo, texts, spans


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _known(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r["term"], r["disclosure"]) for r in terms.collect())
    known = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.array([r[1] >= REMOVE for r in rows], bool)[order]


def _texts_with_terms(docs: DataFrame, terms: DataFrame, text_col: str, use: Callable, schema) -> DataFrame:
    """Run ``use(batch, found)`` over docs, with found as by ``_found``.

    The terms are broadcast in parts of MAX_TERMS; with more than one part the
    texts are first cut down to the terms that occur in them, by a join on the
    hash, and each batch is given those of its own texts.
    """
    spark = docs.sparkSession
    if terms.count() <= MAX_TERMS:
        shared = spark.sparkContext.broadcast(_known(terms))

        def run(batches: Arrow) -> Arrow:
            for batch in batches:
                yield from use(batch, _found(batch.column(text_col), *shared.value))

        return docs.mapInArrow(run, schema)

    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    text_key, own_key, own_terms = (fresh(docs, n) for n in ("text_key", "own_key", "own_terms"))

    def vocabulary(batches: Arrow) -> Arrow:
        for batch in batches:
            for part in _text.slices(batch.column("t")):
                words = _Words(part)
                text = np.repeat(batch.column("k").to_numpy()[part.lo : part.hi], np.diff(words.first))
                yield pa.RecordBatch.from_arrays([pa.array(words.hash.view(np.int64)), pa.array(text)], ["term", "k"])

    occurring = docs.select(F.col(text_col).alias("t"), key.alias("k")).mapInArrow(vocabulary, "term bigint, k bigint").distinct()
    per_text = occurring.join(terms, "term").groupBy(F.col("k").alias(own_key)).agg(F.collect_list(F.struct("term", "disclosure")).alias(own_terms))
    joined = docs.withColumn(text_key, key).join(per_text, F.col(text_key) == F.col(own_key), "left").drop(text_key, own_key)

    def run_joined(batches: Arrow) -> Arrow:
        for batch in batches:
            own = batch.column(own_terms)
            flat = own.flatten()
            term = flat.field("term").to_numpy().view(np.uint64)
            known, where = np.unique(term, return_index=True)
            remove = flat.field("disclosure").to_numpy()[where] >= REMOVE
            rest = batch.select([c for c in batch.schema.names if c != own_terms])
            yield from use(rest, _found(rest.column(text_col), known, remove))

    return joined.mapInArrow(run_joined, schema)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``spans`` (kind, start, end; by start, then kind) and the sanitised ``text``."""
    terms = disclosing_terms(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def use(batch: pa.RecordBatch, found) -> Arrow:
        for lo, texts, spans in found:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in s] for s in spans]
            clean = [redact(t, s) if s else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, len(texts)), pa.array(rows, pa.list_(_SPAN)), pa.array(clean, pa.string())], ["doc_id", "spans", "text"]
            )

    return _texts_with_terms(texts, terms, "text", use, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>, text string")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts; other columns and rows as they are (null texts stay null)."""
    terms = disclosing_terms(docs, id_col, text_col)

    def use(batch: pa.RecordBatch, found) -> Arrow:
        at = batch.schema.names.index(text_col)
        for lo, texts, spans in found:
            part = batch.slice(lo, len(texts))
            null = part.column(at).is_null().to_pylist()
            clean = [None if n else redact(t, s) if s else t for t, s, n in zip(texts, spans, null)]
            yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    return _texts_with_terms(docs, terms, text_col, use, docs.schema)
