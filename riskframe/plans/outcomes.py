"""Tables in the shape of the surgical data, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.presets import clinical

WEEKS = ["w0", "w1", "w2", "w3"]
METRICS = ["click", "view", "purchase", "signup", "error"]
POSITIVE_MIN = {"click": 60.0, "view": 60.0, "purchase": 50.0, "signup": 50.0, "error": 50.0}


def matrix_targets(spark: SparkSession) -> DataFrame:
    """Target dimension of the user outcome matrix."""
    rows = [(f"{w}_{m}", w, m, f"Week{i}_{m.title()}", "main" if i < 2 else "exploratory", POSITIVE_MIN[m])
            for i, w in enumerate(WEEKS) for m in METRICS]
    return spark.createDataFrame(rows, clinical.TARGET_SCHEMA)


def raw_surgeries(spark: SparkSession, sf: str) -> DataFrame:
    """One raw row per order: texts with gaps, mixed dates and several notations."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = spark.read.parquet(f"{sf}/customer.parquet")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    price, bal = F.col("o_totalprice"), F.col("c_acctbal")
    d = F.col("o_orderdate").cast("date")
    tenth = lambda v, n: F.pmod(F.floor(v), F.lit(n)).cast("int")
    pick = lambda v, options: F.element_at(F.array(*[F.lit(x) for x in options]), tenth(v, len(options)) + 1)
    outcomes = {
        name: F.when(tenth(price / (3 + i), 11) < 9, F.concat(tenth(price / (7 + i), 9).cast("string"), F.lit("分")))
        for i, name in enumerate(clinical.OUTCOMES)}
    return rows.select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.day(d) == 1, F.year(d).cast("string")).alias("年份"),
        F.when(F.col("o_orderstatus") == "F", F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(F.col("o_orderstatus") == "P", F.date_format(d, "M.dd")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("手术日期"),
        pick(bal, ["男", "女", "M", "female"]).alias("性别"),
        F.concat(tenth(price / 11, 70) + 18, F.lit("岁")).alias("年龄"),
        F.when(tenth(price, 5) > 0, F.concat((tenth(bal, 60) + 40).cast("string"), F.lit(".5kg"))).alias("体重"),
        pick(price / 13, ["ASA Ⅱ级", "III", "2", ""]).alias("ASA分级"),
        pick(price / 17, ["子宫肌瘤剔除", "剖宫产", "膝关节置换", "腰椎融合", "胆囊切除", "疝修补", "其它手术"]).alias("手术名称"),
        pick(bal / 3, ["插管全麻+神经阻滞", "腰麻", "腰硬联合", "插管全麻／硬膜外"]).alias("麻醉方法"),
        pick(bal / 5, ["PCIA", "PCEA", "PCNA＋PCIA"]).alias("镇痛方式"),
        F.concat(F.lit("舒芬"), tenth(price / 19, 90) + 50, F.lit("ug+帕洛诺司琼0.25mg,"), tenth(price / 23, 50) + 100, F.lit("ml 2ml/h")).alias("镇痛泵配方"),
        F.when(tenth(price / 29, 3) == 0, F.lit("150ml")).alias("总量"),
        F.when(tenth(price / 29, 3) == 1, F.lit("2")).alias("背景量"),
        pick(price / 31, ["无", "股神经阻滞", "TAP+椎旁", "Ⅰ/Ⅱ型胸肌阻滞", "竖脊肌平面阻滞"]).alias("阻滞镇痛部位"),
        pick(price / 31, ["", "0.375%罗哌卡因各20ml", "罗哌卡因 0.5% 20ml/侧", "布比卡因脂质体133g", "0.25%布比卡因30ml"]).alias("阻滞镇痛配方"),
        F.lit("3").alias("床号"), F.lit("x").alias("补充_备注"),
        *[e.alias(n) for n, e in outcomes.items()])
