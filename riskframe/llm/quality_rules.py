"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` lists (metric, least, most).  The metrics are ratios of length, symbols, stop words and lines; every rule becomes
one comparison of the projection's verdict.  No user function runs, nothing is shuffled.

Repeated 8-word windows: their hashes are compared first, as most texts have none twice; only where two agree are the
windows themselves sorted, in the row, and the words under repeated ones counted.

Nulls and other cases: a null or empty text has no words, all counts 0, and fails the base rules; texts of any length are
read whole; equal rows and repeated or null doc_ids are returned as they come; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalars import let
from riskframe.llm.common import words_of

WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30  # base rules
# Frequent words of the four languages.
STOP_WORDS = ("the of and to in is that for it as with was on be at by this are or an from "
              "le la les de des du et un une en que qui dans pour par sur au est avec ne "
              "der die das und den von zu mit dem ist ein eine auf für nicht im es sich des "
              "el los las del y que en un una por con para su se lo como al").split()
#: (metric, least, most); None: no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.5),
]


def words_in_repeats(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found twice or more, the first included."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)]).alias("w"), i.alias("i"))))
    again: Column = lambda s, j: ((F.get(s, j)["w"] == F.get(s, j - 1)["w"]) | (F.get(s, j)["w"] == F.get(s, j + 1)["w"]))
    hit = let(windows, lambda s: F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(again(s, j), F.lit(False))), lambda j: F.get(s, j)["i"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(hit, zero, lambda a, i: F.struct((i + width).alias("end"), (a["n"] + i + width - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= width, 0).when(some, covered).otherwise(0)


def apply_rules(docs: DataFrame, rules: Sequence[tuple[str, float | None, float | None]] = RULES,
                stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """doc_id, the counts, the metrics of the rules, base_failed and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), words_of(F.col("text")).alias("_words"),
                       F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    counted = rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        words_in_repeats(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(list(stop_words)))).alias("_stops"), F.size("_lines").alias("_n_lines"))
    n = F.greatest("n_words", F.lit(1))
    counted = counted.withColumns({
        "mean_word_chars": F.col("word_chars") / n, "symbols_per_word": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("_stops") / n, "dup_line_ratio": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))})
    passed = F.lit(True)
    for metric, least, most in rules:
        passed = passed & (F.lit(True) if least is None else F.col(metric) >= least) & (F.lit(True) if most is None else F.col(metric) <= most)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    out = counted.withColumn("base_failed", failed).withColumn("kept", ~failed & passed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      *dict.fromkeys(m for m, _, _ in rules))
