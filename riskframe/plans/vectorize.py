"""Raw surgical table to feature table, as one lazy plan plus a few small aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import dates, scalars, text
from riskframe.operators import impute, labels, schema
from riskframe.presets import clinical as c
from riskframe.session import shared_folder

PUMP, BLOCK = "镇痛泵配方", "阻滞镇痛用药"


def parse_columns(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Prune columns, deal the rows out evenly, as a small file is one task otherwise, parse dates and numbers."""
    df = schema.drop_columns(df, c.DROP_NAMES, c.DROP_CONTAINS)
    df = schema.prune_sparse_columns(df, 0.7, [*c.REQUIRED, row_id])
    df = schema.drop_columns(df, c.DROP_AFTER_PRUNING).repartition(row_id)
    parts = dates.date_parts(dates.parse_mixed_date(F.col("手术日期")))
    df = df.withColumns({"手术月份": parts["month"], "手术星期": parts["weekday"], "手术日期": parts["iso"]})
    return df.withColumns({
        **{x: scalars.token_to_int(F.col(x), c.ZERO_TOKENS) for x in c.ZERO_TOKEN_COLUMNS if x in df.columns},
        **{x: scalars.number_prefix(F.col(x)) for x in c.NUMERIC if x in df.columns}})


def fill_weight(df: DataFrame) -> DataFrame:
    """Median weight, then the record whose age and weight were swapped."""
    if "体重" not in df.columns:
        return df
    df = impute.fill_median(df, ["体重"])
    if "年龄" not in df.columns:
        return df
    return impute.correct_records(df, [((F.col("年龄") == 77) & (F.col("体重") == 8), {"体重": 77.0, "年龄": 59.0})])


def fill_calendar(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Forward fill of date, year, month and weekday."""
    filled = [x for x in ("手术日期", "年份", "手术月份", "手术星期") if x in df.columns]
    return impute.forward_fill(df, filled, row_id)


def clean_raw(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The cleaned table with its raw texts, before any feature is derived."""
    return fill_calendar(fill_weight(parse_columns(df, row_id)), row_id)


def add_pump_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Flag and dose per pump drug, volume and rate from the formula text."""
    df = df.withColumn(PUMP, text.clean_text(F.col(PUMP)))
    cols: dict = {}
    for drug in c.PUMP_DRUGS:
        has = F.col(PUMP).contains(drug).cast("int")
        dose = text.zero_when_absent(has, text.extract_dose(F.col(PUMP), drug, ready=True))
        if drug == "布托啡诺":
            dose = F.when(dose == 1000.0, 1.0).otherwise(dose)
        cols[f"{PUMP}_has_{drug}"], cols[f"{PUMP}_{drug}_mg"] = has, dose
    df = df.withColumns(cols)
    for col, pattern, default in (("总量", c.VOLUME_IN_TEXT, 200.0), ("背景量", c.RATE_IN_TEXT, 4.0)):
        if col in df.columns:
            df = impute.fill_from_text(df, col, PUMP, pattern)
            if col == "总量":
                df = impute.correct_records(df, [(F.col(col) == 1500.0, {col: 150.0})])
            df = impute.fill_default(df, {col: default})
    return df, list(cols)


def add_block_features(df: DataFrame, exclusive: bool = False) -> tuple[DataFrame, list[str]]:
    """Flag and dose per block drug that occurs at all, total dose and volume."""
    source = next((x for x in ("阻滞镇痛配方", BLOCK) if x in df.columns), None)
    if source is None:
        return df, []
    df = df.withColumn("_block", text.normalize_formula(F.col(source)))
    terms = [labels.Term(t.name, c.EXCLUSIVE_BUPIVACAINE, True) if exclusive and t.name == "布比卡因" else t
             for t in c.BLOCK_DRUGS]
    df, kept = labels.contains_flags(df, "_block", terms, f"{BLOCK}_has_", skip_unseen=True)
    names, doses = [], []
    for t in kept:
        has, dose = f"{BLOCK}_has_{t.name}", f"{BLOCK}_{t.name}_dose"
        df = df.withColumn(dose, text.zero_when_absent(F.col(has), text.extract_block_dose(F.col("_block"), t.pattern, ready=True)))
        names += [has, dose]
        doses.append(F.col(dose))
    totals = {f"{BLOCK}_总量": text.row_total(doses),
              f"{BLOCK}_总体积_ml": F.coalesce(text.extract_volume(F.col("_block"), ready=True), F.lit(0.0))}
    return df.withColumns(totals).drop("_block"), [*names, *totals]


def vectorize_table(df: DataFrame, min_count: int = 10, exclusive: bool = False, row_id: str = "row_id") -> DataFrame:
    """Feature table with the row id in front.

    The parsed rows are stored once; the aggregates that decide the columns read
    their few columns there, and the shuffle for the forward fill moves numbers only.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
    parsed = parse_columns(df, row_id)
    parsed.write.parquet(folder)
    df = fill_weight(spark.read.schema(parsed.schema).parquet(folder))
    out = [row_id]
    if "性别" in df.columns:
        df = df.withColumn("性别_num", text.parse_gender(F.col("性别")).cast("double"))
        out.append("性别_num")
    if "ASA分级" in df.columns:
        df = df.withColumn("ASA分级_num", text.parse_grade(F.col("ASA分级")).cast("double"))
        df = impute.fill_mode(df, "ASA分级_num")
        out.append("ASA分级_num")
    if "手术名称" in df.columns:
        df = df.withColumn("手术类型类别", text.classify_keywords(F.col("手术名称"), c.SURGERY_RULES, c.SURGERY_DEFAULT))
        df, names = labels.one_hot_fixed(df, "手术类型类别", c.SURGERY_LABELS, "手术类型_")
        out += names
    for col in ("麻醉方法", "镇痛方式"):
        if col in df.columns:
            df, names = labels.one_hot_multi(df, col, min_count)
            out += names
    if "阻滞镇痛部位" in df.columns:
        sites = text.classify_multi(F.col("阻滞镇痛部位"), c.SITE_RULES, c.SITE_NEGATIONS, c.SITE_ABSENT, c.SITE_OTHER)
        df, names = labels.one_hot_fixed(df.withColumn("_sites", sites), "_sites", c.SITE_LABELS, "阻滞镇痛部位_")
        out += names
    out += [x for x in c.DEFAULTS if x in df.columns]
    if PUMP in df.columns:
        df, names = add_pump_features(df)
        out += names
    df, names = add_block_features(df, exclusive)
    out += names + [x for x in (*c.CONTEXT, *c.OUTCOMES) if x in df.columns]
    wide = df.select(*[F.col(f"`{x}`") for x in dict.fromkeys(out) if x not in c.DROP_CONSTANT])
    return fill_calendar(impute.fill_default(wide, c.DEFAULTS), row_id)
