"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import word_array

#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their "
    "they this to was we were which will with you "
    "als am auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich im ist mit nach nicht sich sie "
    "sind so über um und von war wie zu zum zur "
    "al como con de del el en es esta este ha la las lo los más no para pero por que se sin su sus un una y "
    "au aux avec ce cette dans des du elle est et il ils je le les leur mais ne nous ou par pas pour qui sa ses son sont sur une"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= metric <= high``; a missing bound doesn't bind."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Base rules, in whole numbers: at least 50 words, at most half of them in repeated three-word windows.
BASE_RULES = (
    Rule("word_count", "n_words", low=50),
    Rule("repeated_words", "100 * n_repeat_words - 50 * n_words", high=0),
)
#: The method's own thresholds, on ratios; each is null, and so fulfilled, where its divisor is 0.
RULES = (
    Rule("mean_word_length", "mean_word_chars", low=2.5, high=12.0),
    Rule("symbols_per_word", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.05),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def _holds(rule: Rule) -> Column:
    value = F.expr(rule.metric)
    tests = [value >= rule.low] * (rule.low is not None) + [value <= rule.high] * (rule.high is not None)
    both = tests[0]
    for test in tests[1:]:
        both = both & test
    return F.coalesce(both, F.lit(True))


def _failed(rules: tuple[Rule, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(~_holds(r), F.lit(r.name)) for r in rules]))


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    base_rules: tuple[Rule, ...] = BASE_RULES,
    stop_words: tuple[str, ...] | list[str] = STOP_WORDS,
) -> DataFrame:
    """Metrics and verdict of every row: ``id``, the counts and ratios, ``base_failed, failed_rules, kept``.

    Words are runs of characters other than space and U+0009 to U+000D, of the whole text. Repeated words
    are those in three-word windows that the text holds twice or more; duplicate lines are ``\\n``-split
    lines with a word that equal an earlier one. Null and empty texts have no words and fail the base
    rules. Repeated rows are judged each; other columns of ``df`` are ignored. Map only, no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    split = base.select(
        "id",
        "text",
        word_array(F.col("text")).alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    n = F.size("w")
    following = lambda first: F.slice("w", F.lit(first), F.greatest(n - 2, F.lit(0)))
    joined = F.zip_with(following(1), following(2), lambda a, b: F.concat(a, F.lit(" "), b))
    windows = split.select(
        "id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda word: F.lower(word).isin(list(stop_words)))).cast("long").alias("n_stop_words"),
        F.zip_with(joined, following(3), lambda ab, c: F.concat(ab, F.lit(" "), c)).alias("windows"),
    )
    metrics = [c for c in windows.columns if c != "windows"]
    # only a text that repeats a window pays for the sort that finds which
    ordered = windows.select(
        *metrics,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("s"),
    )
    twins = F.zip_with(
        F.slice("s", F.lit(1), F.size("s") - 1),
        F.slice("s", F.lit(2), F.size("s") - 1),
        lambda x, y: F.when(x["g"] == y["g"], F.array(x["i"], y["i"])).otherwise(F.expr("cast(array() as array<int>)")),
    )
    starts = ordered.select(*metrics, F.when(F.col("s").isNotNull(), F.array_distinct(F.flatten(twins))).alias("at"))
    covered = F.array_union(
        F.array_union("at", F.transform("at", lambda i: i + 1)), F.transform("at", lambda i: i + 2)
    )
    counted = starts.select(
        *metrics, F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words")
    )
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    ratios = counted.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )
    judged = ratios.select(
        "*", (F.size(_failed(base_rules)) > 0).alias("base_failed"), _failed(base_rules + rules).alias("failed_rules")
    )
    return judged.withColumn("kept", F.size("failed_rules") == 0)


def keep_good(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose text passes every rule, in its columns, which may have any names.

    Null and empty texts fail the base rules and go; repeated rows are judged each; an empty table stays
    empty. A language none of whose words are in ``STOP_WORDS`` fails the stop-word rule: pass ``stop_words``.
    """
    marked = df.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    # a filter moves below deterministic projections and would repeat their arrays in its condition
    judged = score(marked, "row", "text", **options).withColumn("__at", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__at") >= 0)).select("id.*")
