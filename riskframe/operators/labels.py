"""Label vectors to 0/1 columns, term flags and dose features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import scalars, text


def label_counts(df: DataFrame, col: str) -> DataFrame:
    return (df.select(F.explode(text.split_labels(F.col(col))).alias("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def frequent_labels(df: DataFrame, col: str, min_count: int = 10) -> list[str]:
    """Labels seen at least ``min_count`` times, all labels when none is."""
    counts = label_counts(df, col)
    for kept in (counts.where(F.col("n") >= min_count), counts):
        rows = kept.orderBy(F.desc("n"), "label").collect()
        if rows:
            return [r["label"] for r in rows]
    return []


def one_hot_long(df: DataFrame, col: str, id_col: str = "row_id", min_count: int = 10, other: str = "其他") -> DataFrame:
    """(id, label) of every flag that is 1, the long form of ``one_hot_multi``: no list of labels, so any number of them."""
    counts = label_counts(df, col)
    common = counts.agg(F.max("n").alias("_most"))
    kept = counts.join(F.broadcast(common)).where((F.col("n") >= min_count) | (F.col("_most") < min_count)).select("label", F.lit(True).alias("_kept"))
    rows = df.select(id_col, F.explode(text.split_labels(F.col(col))).alias("label")).join(kept, "label", "left")
    return rows.select(id_col, F.when(F.col("_kept"), F.col("label")).otherwise(other).alias("label")).distinct()


def one_hot_multi(df: DataFrame, col: str, min_count: int = 10, other: str = "其他") -> tuple[DataFrame, list[str]]:
    """0/1 column per frequent label plus one for any label outside the set.

    A frequent label that is itself called like ``other`` is overwritten by it.  With thousands of labels ``one_hot_long``
    is the better form.
    """
    keep = frequent_labels(df, col, min_count)
    if not keep:
        return df, []
    labels = F.col("_labels")
    flags: dict = {}
    spelled: dict[str, set] = {}
    for k in keep:
        name = f"{col}_oh_{scalars.sanitize_text(k)}"
        twins = spelled.get(name.lower(), set()) - {name}
        # Spark's column names ignore case, so a label differing by case only is numbered
        name = f"{name}_{len(twins) + 1}" if twins else name
        spelled.setdefault(name.lower(), set()).add(name)
        flags[name] = F.array_contains(labels, k).cast("int")
    flags[f"{col}_oh_{other}"] = F.exists(labels, lambda x: ~x.isin(keep)).cast("int")
    out = df.withColumn("_labels", text.split_labels(F.col(col))).withColumns(flags).drop("_labels")
    return out, list(flags)


def one_hot_fixed(df: DataFrame, col: str, labels: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """0/1 column per listed label of a single- or multi-valued column."""
    multi = dict(df.dtypes)[col].startswith("array")
    flags = {f"{prefix}{k}": (F.array_contains(F.col(col), k) if multi else F.col(col).eqNullSafe(k)).cast("int")
             for k in labels}
    return df.withColumns(flags), list(flags)


@dataclass(frozen=True)
class Term:
    """A term to look for: literal text, or a regular expression."""

    name: str
    pattern: str
    regex: bool = False

    def flag(self, c):
        return (c.rlike(text.FLAGS.replace("i", "") + self.pattern) if self.regex else c.contains(self.pattern))


def contains_flags(df: DataFrame, col: str, terms: Sequence[Term], prefix: str,
                   skip_unseen: bool = False) -> tuple[DataFrame, list[Term]]:
    """0/1 column per term; terms nobody has can be left out."""
    kept = list(terms)
    if skip_unseen:
        seen = df.agg(*[F.max(t.flag(F.col(col)).cast("int")).alias(t.name) for t in terms]).first()
        kept = [t for t in terms if seen[t.name] == 1]
    flags = {f"{prefix}{scalars.sanitize_text(t.name)}": F.coalesce(t.flag(F.col(col)), F.lit(False)).cast("int")
             for t in kept}
    return (df.withColumns(flags) if flags else df), kept


def extraction_coverage(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per drug: rows naming it, rows with a positive dose, and the gap."""
    wide = df.agg(*[e for has, dose in pairs.values() for e in (
        F.sum(F.col(has)).cast("long").alias(has), F.count_if(F.col(dose) > 0).alias(dose))])
    rows = F.array(*[F.struct(F.lit(d).alias("drug"), F.col(h).alias("named"), F.col(x).alias("dosed"))
                     for d, (h, x) in pairs.items()])
    return (wide.select(F.explode(rows).alias("r")).select("r.*")
            .withColumn("without_dose", F.col("named") - F.col("dosed")))
