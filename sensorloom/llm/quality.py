"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over the whole text, every rule a row (measure, lowest, highest), and the verdict is one condition
made from the table. There are no user functions, no shuffle and no second pass.

Words are runs of characters outside [\\x20\\x09-\\x0D]. A 5-word window counts as repeated if the text holds it twice or more; all words of
all its occurrences are repeated words. The windows of a text are first compared as a set of hashes; only texts with a repeat go on to the
positions.

Cases: a null or empty text has no words, all measures 0 and fails the base; ratios over zero are 0. Each row is judged alone: repeated rows
and null ids make no difference. Empty tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import BLANK_CLASS, BLANKS, bound

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
# fixed values: frequent function words of the four languages
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "on", "it", "a", "an", "as", "was", "by",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "est", "sur", "au", "pas",
    "der", "die", "das", "und", "den", "dem", "ein", "eine", "von", "zu", "mit", "nicht", "ist", "auf", "im", "sich", "für",
    "el", "los", "las", "del", "y", "no", "se", "con", "por", "para", "una", "su", "lo", "al", "es",
)


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [lowest, highest]; None leaves a side open."""

    measure: str
    lowest: float | None = None
    highest: float | None = None


RULES = (
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", highest=0.1),
    Rule("stop_word_ratio", lowest=0.01),
    Rule("dup_line_ratio", highest=0.5),
    Rule("upper_ratio", highest=0.5),
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK_CLASS}+"))


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more."""

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>"))

    def positions(hashes: Column) -> Column:
        """Sorted starts of the windows whose hash is there twice or more."""
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            chosen = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
            return F.array_sort(F.transform(chosen, lambda x: x["i"]))

        return bound(pairs, repeated)

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            bound(positions(hashes), covered)
        )

    return bound(windows(words), count)


def _repeated_lines(text: Column) -> Column:
    filled = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return bound(filled, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def judged(
    docs: DataFrame,
    *,
    rules: tuple[Rule, ...] = RULES,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each row's id, base measures, ratios, base_failed, failed_rules and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    measured = bound(
        F.struct(text.alias("t"), _words(text).alias("w")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            _count(x["t"], SYMBOLS).alias("n_symbols"),
            _repeated_lines(x["t"]).alias("n_dup_lines"),
            _repeated_words(x["w"]).alias("n_repeat_words"),
            _count(x["t"], "[A-Z]").alias("n_upper"),
            F.size(F.filter(x["w"], lambda w: w.isin(*stop))).cast("long").alias("n_stop"),
            F.size(F.split(x["t"], "\n")).cast("long").alias("n_lines"),
        ),
    )
    base = docs.select(F.col(id_col), measured.alias("_m")).select(id_col, "_m.*")
    n = F.col("n_words")
    ratios = {
        "mean_word_length": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("word_chars")),
        "stop_word_ratio": _ratio(F.col("n_stop"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "upper_ratio": _ratio(F.col("n_upper"), F.col("word_chars")),
    }
    with_ratios = base.withColumns(ratios)
    failed = []
    for rule in rules:
        value = F.col(rule.measure)
        wrong = F.lit(False)
        if rule.lowest is not None:
            wrong = wrong | (value < rule.lowest)
        if rule.highest is not None:
            wrong = wrong | (value > rule.highest)
        failed.append(F.when(wrong, F.lit(rule.measure)))
    base_failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    return (
        with_ratios.withColumn("base_failed", base_failed)
        .withColumn("failed_rules", F.array_compact(F.array(*failed)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
