"""Rule-based quality filter: one threshold table compiled into a Spark projection.

Every rule bounds the ratio of two counts of a text (characters to words,
symbols to words, stop words to words, repeated lines to lines).  The counts
are built-in SQL expressions, and so are the rules, so the whole filter is
column expressions over the scan: no shuffle, no user function.

Edge cases: a null text has no words; a text without words or with fewer than
``MIN_WORDS`` fails the base rules; rows are judged one by one, so repeated
rows give repeated results and null ids stay null.  Input columns other than
the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
SYMBOLS = "[#*$%&|<>]"
SPACE = "[\\x09-\\x0D\\x20]"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it with as on be by this are was from at or "
    "der die und das nicht ist den von zu mit auf ein eine als "
    "le la les de des du et un une est pour que dans par pas sur qui en "
    "el los las y se del por con para lo su al"
).split()


@dataclass(frozen=True)
class Rule:
    """low * denominator <= 100 * numerator <= high * denominator (percent)."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None

    def sql(self) -> str:
        sides = []
        if self.low is not None:
            sides.append(f"100 * {self.numerator} >= {self.low} * {self.denominator}")
        if self.high is not None:
            sides.append(f"100 * {self.numerator} <= {self.high} * {self.denominator}")
        return "(" + " AND ".join(sides) + ")"


RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols to words", "n_symbols", "n_words", None, 30),
    Rule("stop words to words", "n_stop_words", "n_words", 4, None),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", None, 40),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _hashed(windows: Column) -> Column:
    """One number per window, in text order."""
    return F.transform(windows, lambda x, i: _window_hash(x, F.get("w", i + 1), F.get("w", i + 2)))


def _equal_words(i: Column, j: Column) -> Column:
    return F.get("w", i).eqNullSafe(F.get("w", j))


def _by_words(windows: Column) -> Column:
    """Positions of repeated windows, from the words themselves (sorted beside their positions)."""
    placed = F.sort_array(
        F.transform(windows, lambda x, i: F.struct(F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)).alias("k"), i.cast("long").alias("p")))
    )

    def repeated(s: Column) -> Column:
        kept = F.filter(s, lambda x, i: (x["k"] == F.get(s, i + 1)["k"]) | (x["k"] == F.get(s, i - 1)["k"]))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    return F.get(F.transform(F.array(placed), repeated), F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts the rules bound, per row: ``row`` (all columns of it), doc_id, n_words, word_chars, ...

    ``n_repeat_words`` counts words that lie in a 3-word window found twice or
    more in the text; the union of those windows is the sum of gaps between their
    sorted positions, 3 at most each.  Windows are numbers: a hash whose lowest
    bits give way to the position, so that one sort of plain numbers brings equal
    ones together in text order.  Only texts that hold a number twice are sorted.
    Neighbours with equal hashes are compared word by word, and a text in which
    two of them differ is counted on its words instead.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), text.alias("t"))
    base = base.select("row", "doc_id", "t", _words(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    windows = F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))
    # the lowest bits, as many as the largest position has
    mask = F.expr("shiftleft(1L, length(bin(size(w)))) - 1").alias("mask")
    hashed = base.select("row", "doc_id", "t", "w", lines.alias("l"), _hashed(windows).alias("h"), mask)
    counted = hashed.select(
        "row",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        "w",
        "mask",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.bitwise_not("mask")).bitwiseOR(i.cast("long")))),
        ).alias("s"),
    )
    numbers = [c for c in counted.columns if c not in ("w", "mask", "s")]

    def equal_hash(x: Column, y: Column) -> Column:
        return x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("mask")) == 0

    repeated = F.filter("s", lambda x, i: equal_hash(x, F.get("s", i + 1)) | equal_hash(x, F.get("s", i - 1)))
    found = counted.select(*numbers, "w", "mask", repeated.alias("s"))

    def differ(x: Column, y: Column) -> Column:
        i, j = (v.bitwiseAND(F.col("mask")).cast("int") for v in (x, y))
        return equal_hash(x, y) & ~(_equal_words(i, j) & _equal_words(i + 1, j + 1) & _equal_words(i + 2, j + 2))

    clash = F.exists(F.transform("s", lambda x, i: F.coalesce(differ(x, F.get("s", i + 1)), F.lit(False))), lambda x: x)
    positions = F.sort_array(F.transform("s", lambda x: x.bitwiseAND(F.col("mask"))))
    placed = found.select(*numbers, F.when(F.size("s") == 0, F.array().cast("array<bigint>")).when(clash, _by_words(windows)).otherwise(positions).alias("r"))
    union = F.aggregate(
        "r",
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(p - a["last"], F.lit(3))).alias("sum")),
        lambda a: a["sum"],
    )
    return placed.select(*numbers, F.coalesce(union, F.lit(0).cast("long")).alias("n_repeat_words"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every text: doc_id, the counts, base_failed and kept.

    ``base_failed``: fewer than MIN_WORDS words, or more than
    MAX_REPEAT_PERCENT of them in repeated 3-word windows.  ``kept``: not
    base_failed and inside every rule's bounds.
    """
    judged = F.struct(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
        "n_stop_words",
        F.expr(BASE_FAILED).alias("base_failed"),
        _passes(rules).alias("kept"),
    )
    # unpacked from an array, so that a filter on a column is not pushed below (see keep_good)
    return measures(docs, id_col, text_col).select(F.inline(F.array(judged)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged (judged in place, no join by id).

    Rows are unpacked where the verdict is true rather than filtered by it: the
    optimiser pushes a filter below the projections it reads, and would work the
    counts out again for every place that names them.
    """
    return measures(docs, id_col, text_col).select(F.inline(F.when(_passes(rules), F.array("row"))))


def _passes(rules: tuple[Rule, ...]) -> Column:
    return F.expr(f"NOT ({BASE_FAILED}) AND " + " AND ".join(r.sql() for r in rules))
