"""Text, date and number rules on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from riskframe.functions import dates, scalars, text
from riskframe.presets import clinical


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_mixed_dates(spark):
    got = column(spark, ["45013", "3.28", "3.0", "3.10", "2023-03-28", "3.28日", "2023/3/28", "x", None, "13.45"],
                 dates.parse_mixed_date)
    day = datetime.date(2023, 3, 28)
    assert got == [day, day, datetime.date(1900, 1, 2), datetime.date(2023, 3, 10), day, day, day, None, None, None]


def test_weekday_starts_on_monday(spark):
    got = column(spark, [datetime.date(2024, 1, 1), datetime.date(2024, 1, 7)], lambda c: dates.date_parts(c)["weekday"], "date")
    assert got == [0, 6]


def test_gender(spark):
    assert column(spark, ["男", "male", "男性患者", "f", "女", "", None, "x"], text.parse_gender) == [1, 1, 1, 0, 0, None, None, None]


def test_grade_prefix_order(spark):
    got = column(spark, ["ASA Ⅱ级", "III", "2", "", "Ⅵ", "ASA：4级", "VI", "IV", None, "x"], text.parse_grade)
    assert got == [2, 3, 2, None, 6, 4, 6, 4, None, None]


@pytest.mark.parametrize("name,label", [
    ("剖宫产术", "产科"), ("子宫肌瘤剔除术", "妇科"), ("腰椎间盘手术", "骨科-脊柱"), ("肱骨骨折", "骨科-上肢"), ("膝关节置换", "骨科-下肢"),
    ("髂骨取骨", "骨科-其他"), ("胆囊切除", "腹外科-上腹"), ("阑尾切除", "腹外科-下腹"), ("疝修补", "腹外科-其他"), ("甲状腺", "其他"), ("", "其他")])
def test_surgery_class(spark, name, label):
    got = column(spark, [name], lambda c: text.classify_keywords(c, clinical.SURGERY_RULES, clinical.SURGERY_DEFAULT))
    assert got == [label]


def sites(c):
    return F.array_sort(text.classify_multi(c, clinical.SITE_RULES, clinical.SITE_NEGATIONS, clinical.SITE_ABSENT, clinical.SITE_OTHER))


def test_block_sites(spark):
    got = column(spark, ["TAP，股神经、臂丛", "Ⅰ/Ⅱ型胸肌阻滞", "无", None, "II", "竖脊肌平面阻滞", "某某神经阻滞"], sites)
    assert got == [sorted(["腹壁平面阻滞", "下肢外周神经阻滞", "上肢/颈丛神经阻滞"]), ["胸壁平面阻滞"], ["未记录/未实施"], ["未记录/未实施"],
                   ["其他"], ["其他外周神经阻滞"], ["其他外周神经阻滞"]]


def test_split_labels_full_width(spark):
    got = column(spark, ["插管全麻＋神经阻滞", "a；无;II|b", "　腰麻　", ""], text.split_labels)
    assert got == [["插管全麻", "神经阻滞"], ["a", "b"], ["腰麻"], []]


def test_dose(spark):
    got = column(spark, ["舒芬100ug+x", "0.3%舒芬25ml", "舒芬太尼100ug", "舒芬 2 G", "舒芬0.5% 共 20ml", "舒芬　5mg", None],
                 lambda c: text.extract_dose(c, "舒芬"))
    assert got == [0.1, 75.0, None, 2000.0, 100.0, 5.0, None]


def test_volume(spark):
    got = column(spark, ["0.375%罗哌卡因各20ml", "罗哌卡因20ml/侧+5ml/h", "稀释至40ml(30ml)", "5ml/h", "10ml+15 ML", "配至：60ml", None],
                 text.extract_volume)
    assert got == [40.0, 40.0, 30.0, None, 25.0, 60.0, None]


def test_block_dose(spark):
    ropi, lipo, plain = [t.pattern for t in clinical.BLOCK_DRUGS[:3]]
    texts = ["0.375%罗哌卡因各20ml", "罗哌卡因 0.5% 20ml/侧+5ml/h", "100mg罗哌卡因", "罗哌卡因10ml;其它5ml", "布比卡因脂质体133g", "盐酸罗哌卡因50mg", "x"]
    assert column(spark, texts, lambda c: text.extract_block_dose(c, ropi)) == [150.0, 200.0, 100.0, 10.0, None, 50.0, None]
    assert column(spark, texts, lambda c: text.extract_block_dose(c, lipo))[4] == 133.0
    assert column(spark, ["0.25%左旋布比卡因20ml", "布比卡因脂质体133mg"], lambda c: text.extract_block_dose(c, plain)) == [20.0, None]


def test_overlapping_drug_can_be_excluded(spark):
    got = column(spark, ["0.25%左旋布比卡因20ml", "0.25%布比卡因20ml"],
                 lambda c: text.extract_block_dose(c, clinical.EXCLUSIVE_BUPIVACAINE))
    assert got == [None, 50.0]


def test_numbers(spark):
    assert column(spark, ["65岁", "-1.5x", " 7", "kg", None], scalars.number_prefix) == [65.0, -1.5, 7.0, None, None]
    assert column(spark, ["1e3", "x", "NaN", "Infinity", None], scalars.to_double) == [1000.0, None, None, None, None]
    assert column(spark, ["无", "未见", "2", "x", None], lambda c: scalars.token_to_int(c, clinical.ZERO_TOKENS)) == [0, 0, 2, 0, 0]
    assert column(spark, [" a ", "nan", "", "NONE", None], scalars.missing_to_null) == ["a", None, None, None, None]


def test_names_and_first_present(spark):
    assert column(spark, ["a b-c", "（x）", "　", "手术 类型/其他"], text.sanitize_name) == ["ab_c", "x", "unknown", "手术类型_其他"]
    df = spark.createDataFrame([("nan", None, "x"), ("null", "2", "x")], "a string, b string, c string")
    got = [r[0] for r in df.select(scalars.first_present("a" and F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["x", "2"]


def test_half_even(spark):
    assert column(spark, [0.5, 1.5, 2.5, 26.5], scalars.half_even, "double") == [0, 2, 2, 26]


def test_shift_clip_keeps_null(spark):
    assert column(spark, [0.0, 9.0, None], lambda c: scalars.shift_clip(c, -1, 0, 10), "double") == [0.0, 8.0, None]
    assert column(spark, [10.0], lambda c: scalars.shift_clip(c, 1), "double") == [11.0]


def test_focal_and_tail_weight(spark):
    got = column(spark, [3.0, 4.0, 7.0], scalars.tail_weight, "double")
    assert got == [1.0, 2.5, 4.0]
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (None, 0.5)], "y int, p double")
    vals = [r[0] for r in df.select(scalars.focal_loss(F.col("y"), F.col("p"), 0.25, 2.0)).collect()]
    assert vals[0] == pytest.approx(0.25 * 0.25 * 0.693147, abs=1e-5)
    assert vals[1] == pytest.approx(0.75 * 0.25 * 0.693147, abs=1e-5)
    assert vals[2] == 0.0


def test_target_tiers():
    tiers = {t[0]: t[4] for t in clinical.target_rows()}
    assert tiers["术后第一天_静息痛"] == "main" and tiers["术后第三天_静息痛"] == "low_event"
    assert tiers["术后第二天_静息痛"] == "exploratory" and tiers["术后第三天_镇静评分"] == "low_event_sedation"
    assert tiers["手术当天_活动状态"] == "secondary_activity_status"
