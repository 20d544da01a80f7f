"""Quality rules: a threshold table compiled into one projection, without user functions.

`RULES` is data: each row names a measure, the side of the threshold that fails, and the threshold.
`measures` adds the counts, `verdict` turns the table into one boolean expression.

Defined cases: a null text counts as empty; an empty text has no words, so it fails the base rule;
repeated rows are judged one by one; an empty table gives an empty result; other columns pass
through `apply_rules` untouched (measures overwrite a column of the same name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import WORD, set_aside, words

#: Words in a window, for repetition inside one text.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Two or more capitals in a row.
SHOUT = r"\p{Lu}{2,}"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this from at or an have not which "
    "le la les de des du et un une que qui dans en pour par sur au ne pas est il elle avec ce "
    "der die das und in den von zu mit sich auf ist nicht ein eine im dem es für als auch an "
    "el los las y del se por con una su para al lo como más pero sus no sí"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when `measure` is below `low` or above `high`."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars / n_words", low=2.0, high=14.0),
    Rule("symbol_ratio", "n_symbols / n_words", high=0.25),
    Rule("stop_word_ratio", "n_stop_words / n_words", low=0.03),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", high=0.5),
    Rule("shouted_ratio", "n_shouted / n_words", high=0.3),
)
#: Always applied first; fixed by the contract of the query.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_shouted."""
    docs, back = set_aside(docs, ("_words", "_lines", "_windows", "_ranked", "_at"))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    split = docs.withColumns({"_words": words(text), "_lines": lines})
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)))
    hashed = split.withColumn("_windows", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words
        rest = F.greatest(F.size("_windows") - step, F.lit(0))
        pairs = F.zip_with(F.slice("_windows", F.lit(1), rest), F.slice("_windows", F.lit(step + 1), rest), lambda a, b: F.xxhash64(a, b))
        hashed = hashed.withColumn("_windows", pairs)
    # Equal windows have equal hashes, so a text whose hashes are all different repeats nothing. The
    # others compare the windows themselves, sorted so that equal ones are neighbours.
    suspect = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("_words", i, WINDOW), " ").alias("w"), i.alias("i")))
    ranked = hashed.withColumn("_ranked", F.when(suspect, F.sort_array(placed)))

    def repeated(x: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get("_ranked", j)["w"] == x["w"], F.lit(False))
        return F.when(same(i - 1) | same(i + 1), x["i"])

    at = ranked.withColumn("_at", F.sort_array(F.array_compact(F.transform("_ranked", repeated))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "_at", start, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
    )["n"]
    listed = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    return at.withColumns(
        {
            "n_words": _size("_words"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_lines": _size("_lines"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_stop_words": _size(F.filter("_words", lambda w: w.isin(listed))),
            "n_shouted": F.regexp_count(t, F.lit(SHOUT)).cast("long"),
        }
    ).drop("_words", "_lines", "_windows", "_ranked", "_at").withColumnsRenamed(back)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds; a measure without a value (no words, no lines) holds."""
    kept = F.lit(True)
    for r in rules:
        # try_divide: an empty text has nothing to divide by, and the base rule rejects it anyway.
        top, bottom = r.measure.split(" / ")
        m = F.try_divide(F.col(top), F.col(bottom))
        kept &= F.coalesce(m >= r.low, F.lit(True)) if r.low is not None else F.lit(True)
        kept &= F.coalesce(m <= r.high, F.lit(True)) if r.high is not None else F.lit(True)
    return kept


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with its measures, base_failed and kept. To filter on these, see kept_documents."""
    judged = measures(docs, text).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs` as they were."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    # The optimizer would write the nested measures out inside a pushed-down filter, many times over; it
    # pushes nothing through a projection that numbers its rows.
    judged = apply_rules(whole).withColumn("_row", F.monotonically_increasing_id())
    kept = judged.filter(F.col("kept") & (F.col("_row") >= 0))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
