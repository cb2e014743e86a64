"""Rule-based quality filter: a threshold table compiled into one projection.

Every measure is an expression over the row's own text, so the operator is a single
scan without shuffle, state or user functions.

Defined results: a null or empty text has zero words and fails the base rule; extra
columns are ignored; repeated rows get the same verdict each; an empty table gives an
empty result. Very long texts cost n log n at most (only texts with a repeated window
sort their windows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t-\r]+"
WINDOW = 5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as by this are was from at or "
    "le la les de des du et que un une pour par dans qui en au aux sur pas est "
    "der die das und zu von mit ist nicht ein eine für auf auch im den dem sich "
    "el los las del y para con su se una por al lo no es"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high`` (None: open), once it has ``from_words`` words."""

    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The production table. Ratios are per word or per line, as the measure's name says.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2.0, high=18.0),
    Rule("symbols_per_word", high=0.3),
    Rule("stop_words_per_word", low=0.02, from_words=50),
    Rule("dup_lines_per_line", high=0.5),
    Rule("repeat_words_per_word", high=0.2),
)


def words_of(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: the length of a union of intervals."""

    def of_sorted(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        marked = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["p"]))
        starts = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
        return let(
            starts,
            lambda f: F.aggregate(
                F.transform(f, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(f, j + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    pairs = F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    return let(F.sort_array(pairs), of_sorted)


def measures(documents: DataFrame) -> DataFrame:
    """doc_id and every measure that a rule may name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(F.col("doc_id"), text.alias("text")).select(
        "doc_id",
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"),
        words_of(F.col("text")).alias("_words"),
    )
    hashed = base.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    rolled = let(
        F.col("_hashes"),
        lambda h: F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))),
        ),
    )
    stop_hashes = [F.xxhash64(F.lit(v)) for w in STOP_WORDS for v in dict.fromkeys((w, w.capitalize(), w.upper()))]
    stop = F.filter("_hashes", lambda h: h.isin(*stop_hashes))
    wide = hashed.select(
        "doc_id",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
        rolled.alias("_windows"),
    )
    repeated = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows")))
    counted = wide.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long")).drop("_windows")
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        "*",
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_stop_words", "n_words").alias("stop_words_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_lines_per_line"),
        per("n_repeat_words", "n_words").alias("repeat_words_per_word"),
    )


def compile_rules(rules=RULES) -> Column:
    """One boolean expression: all rules hold."""
    verdict = F.lit(True)
    for rule in rules:
        value, holds = F.col(rule.measure), F.lit(True)
        if rule.low is not None:
            holds = holds & (value >= rule.low)
        if rule.high is not None:
            holds = holds & (value <= rule.high)
        verdict = verdict & (holds | (F.col("n_words") < rule.from_words))
    return verdict


def assess(documents: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept: one row per row of ``documents``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(documents).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & compile_rules(rules)).alias("kept"),
    )


def keep_good(documents: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``documents``, with its columns, that ``assess`` keeps."""
    keyed = packed(documents).select(F.col("_row").alias("doc_id"), F.col("_row.text").alias("text"))
    return assess(keyed, rules).where("kept").select("doc_id.*")
