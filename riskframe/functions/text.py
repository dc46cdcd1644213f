"""Text rules as Column expressions; the word lists are passed in as data.

``(?U)`` makes ``\\s`` match the full-width space, ``(?d)`` lets ``.`` stop at
a newline only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.scalars import let, strip

FLAGS = "(?iUd)"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"

# Fixed values of the label splitter.
LABEL_SEPARATORS = {"＋": "+", "，": ",", "、": ",", "；": ";", "／": "/", "｜": "|"}
LABEL_IDIOMS = {"Ⅰ/Ⅱ型胸肌": "ⅠⅡ型胸肌", "I/II型胸肌": "II型胸肌", "1/2型胸肌": "2型胸肌"}
LABEL_STOP = ["无", "未见", "none", "None", "Ⅰ", "Ⅱ", "Ⅲ", "Ⅳ", "Ⅴ", "Ⅵ", "I", "II", "III", "IV", "V", "VI", "1", "2"]
# Fixed values of the formula normaliser.
FORMULA_CHARS = {"％": "%", "&": "%", "，": ",", "；": ";", "：": ":", "（": "(", "）": ")", "＋": "+", "盐酸": ""}
FINAL_VOLUME_PATTERNS = [
    r"(?:稀释至|配至|共|至)\s*" + NUMBER + r"\s*ml",
    r"[:]\s*" + NUMBER + r"\s*ml",
    r"\(\s*" + NUMBER + r"\s*ml\s*\)",
]
# Fixed values of the grade parser.
GRADE_NOISE = ["ASA", "级", "：", ":"]
ROMAN_FULL_WIDTH = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI"}
ROMAN_PREFIXES = [("VI", 6), ("V", 5), ("IV", 4), ("III", 3), ("II", 2), ("I", 1)]


def clean_text(c: Column) -> Column:
    """Trimmed text; NULL and "nan" become empty."""
    return F.coalesce(let(strip(c), lambda t: F.when(F.lower(t) != "nan", t)), F.lit(""))


def sanitize_name(c: Column, fallback: str = "unknown") -> Column:
    """Letters, digits and CJK kept; other runs become one underscore."""
    squeezed = F.regexp_replace(c.cast("string"), r"(?U)\s+", "")
    named = F.regexp_replace(F.regexp_replace(squeezed, r"[^0-9A-Za-z一-鿿]+", "_"), r"^_+|_+$", "")
    return F.when(named != "", named).otherwise(F.lit(fallback))


def replace_all(c: Column, mapping: dict[str, str]) -> Column:
    """Single characters in one pass, longer tokens one by one."""
    single = {k: v for k, v in mapping.items() if len(k) == 1 and len(v) <= 1}
    single = dict(sorted(single.items(), key=lambda kv: len(kv[1]), reverse=True))
    out = F.translate(c, "".join(single), "".join(single.values())) if single else c
    rest = [kv for kv in mapping.items() if kv[0] not in single]
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), rest, out)


def has_any(c: Column, keywords: list[str]) -> Column:
    """One pass over the text for a whole keyword group."""
    return c.rlike("|".join(re.escape(k) for k in keywords))


@dataclass(frozen=True)
class KeywordRule:
    """A label and what names it: any keyword, or all words of one combination."""

    label: str
    keywords: list[str]
    combinations: list[tuple[str, ...]] = field(default_factory=list)

    def matches(self, c: Column) -> Column:
        tests = [has_any(c, self.keywords)] if self.keywords else []
        for words in self.combinations:
            tests.append(reduce(lambda a, b: a & b, [c.contains(w) for w in words]))
        return reduce(lambda a, b: a | b, tests)


def first_label(c: Column, rules: list[KeywordRule], default: str) -> Column:
    """Label of the first rule that matches, else the default."""
    expr = F
    for rule in rules:
        expr = expr.when(rule.matches(c), rule.label)
    return expr.otherwise(default) if rules else F.lit(default)


def classify_keywords(c: Column, rules: list[KeywordRule], default: str) -> Column:
    """Ordered keyword groups over the whole text; empty text gets the default."""
    return let(clean_text(c), lambda t: first_label(t, rules, default))


def parse_gender(c: Column) -> Column:
    return let(F.upper(clean_text(c)), lambda t: F.when(t.isin("M", "MALE") | t.startswith("男"), 1)
               .when(t.isin("F", "FEMALE") | t.startswith("女"), 0))


def parse_grade(c: Column) -> Column:
    """Roman prefix (VI, V, IV, III, II, I in that order), else first digit 1-6."""
    t = F.upper(clean_text(c))
    t = strip(replace_all(replace_all(t, {n: "" for n in GRADE_NOISE}), ROMAN_FULL_WIDTH))

    def first_prefix(x: Column) -> Column:
        expr = F
        for prefix, value in ROMAN_PREFIXES:
            expr = expr.when(x.startswith(prefix), value)
        return expr.otherwise(F.regexp_extract(x, "[1-6]", 0).try_cast("int"))

    return let(t, first_prefix)


def split_labels(c: Column) -> Column:
    """Array of labels of a multi-valued text."""
    t = replace_all(replace_all(clean_text(c), LABEL_SEPARATORS), LABEL_IDIOMS)
    parts = F.transform(F.split(t, r"[+,/;|]"), strip)
    return F.filter(parts, lambda x: (x != "") & ~x.isin(LABEL_STOP))


def classify_multi(c: Column, rules: list[KeywordRule], negations: list[str],
                   absent: str, other: str) -> Column:
    """Set of classes of a multi-valued text.

    Empty text or a negation word gives only ``absent``; bare roman fragments
    are skipped; a label no rule names, or a row left without any, is ``other``.
    """


    def classes_of(t: Column) -> Column:
        labels = let(split_labels(t), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(t)))
        kept = F.filter(F.transform(labels, lambda x: F.lower(x)), lambda x: ~x.rlike(
            r"^(i{1,3}|iv|v|vi|[ⅠⅡⅢⅣⅤⅥⅰⅱⅲⅳⅴⅵ]+|[12])$"))
        found = F.array_distinct(F.transform(kept, lambda x: first_label(x, rules, other)))
        found = let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(other))))
        return F.when((t == "") | has_any(t, negations), F.array(F.lit(absent))).otherwise(found)

    return let(clean_text(c), classes_of)


def normalize_formula(c: Column) -> Column:
    """Full-width signs to ASCII, "&" read as "%", the salt prefix dropped."""
    return replace_all(clean_text(c), FORMULA_CHARS)


def mass_to_mg(value: Column, unit: Column) -> Column:
    """Milligrams; a "g" value of 10 or more is taken as a slip for mg."""
    u = F.lower(unit)
    return (F.when(u == "ug", value / 1000.0)
            .when((u == "g") & (value < 10), value * 1000.0)
            .otherwise(value))


def extract_dose(c: Column, drug: str, ready: bool = False) -> Column:
    """Dose in mg after the drug name, else percent x 10 x volume, else NULL.

    ``ready`` says the text is already clean, so the rule is not repeated.
    """
    name = re.escape(drug)
    mass = FLAGS + name + r"\s*" + NUMBER + r"\s*(ug|mg|g)"
    unit = FLAGS + NUMBER + r"\s*(ug|mg|g)$"
    percent_first = FLAGS + NUMBER + r"\s*%\s*" + name + r".*?" + NUMBER + r"\s*ml"
    name_first = FLAGS + name + r"\s*" + NUMBER + r"\s*%\s*.*?" + NUMBER + r"\s*ml"

    def mg(value: Column, u: Column) -> Column:
        return F.when(u == "ug", value / 1000.0).when(u == "g", value * 1000.0).otherwise(value)

    def by_percent(t: Column, pattern: str) -> Column:
        return (F.regexp_extract(t, pattern, 1).try_cast("double") * 10.0
                * F.regexp_extract(t, pattern, 2).try_cast("double"))

    def dose(t: Column) -> Column:
        # the short hit is taken apart instead of searching the text again
        by_mass = let(F.regexp_extract(t, mass, 0), lambda hit: mg(
            F.regexp_extract(hit, unit, 1).try_cast("double"), F.lower(F.regexp_extract(hit, unit, 2))))
        any_dose = F.coalesce(by_mass, by_percent(t, percent_first), by_percent(t, name_first))
        return F.when(F.lower(t).contains(drug.lower()), any_dose)

    return dose(c) if ready else let(clean_text(c), dose)


def hits(t: Column, pattern: str, group: int = 0) -> Column:
    """All hits of a pattern in the text."""
    return F.regexp_extract_all(t, F.lit(FLAGS + pattern), F.lit(group))


def sum_or_null(a: Column) -> Column:
    """Sum of an array's numbers, NULL when it has none."""
    total = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v))
    return let(F.filter(a, lambda v: v.isNotNull()), total)


def part(hit: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(hit, FLAGS + pattern, group)


def plain_volume(t: Column) -> Column:
    """Sum of "v ml" in a normalised text; rates are ignored, "each/side" doubles."""
    found = hits(t, r"(各\s*)?" + NUMBER + r"\s*ml(?!\s*/\s*h)(\s*/\s*侧)?")
    return sum_or_null(F.transform(found, lambda h: part(h, NUMBER).cast("double") * F.when(
        h.startswith("各") | h.endswith("侧"), 2.0).otherwise(1.0)))


def extract_volume(c: Column, prefer_final: bool = True, ready: bool = False) -> Column:
    """Total volume: last hit of the last final-volume pattern that hits, else the sum."""

    def final_or_sum(t: Column) -> Column:
        finals = F.concat(*[hits(t, p, 1) for p in FINAL_VOLUME_PATTERNS])
        return F.coalesce(let(finals, lambda a: F.get(a, F.size(a) - 1)).try_cast("double"), plain_volume(t))

    t = c if ready else normalize_formula(c)
    return let(t, final_or_sum if prefer_final else plain_volume)


def extract_block_dose(c: Column, drug_pattern: str, ready: bool = False) -> Column:
    """Sum of masses next to the drug, else of percent x volume, else of volumes."""
    mass = NUMBER + r"\s*(ug|mg|g)"

    def masses(t: Column, pattern: str, inner: str) -> Column:
        return F.transform(hits(t, pattern), lambda h: mass_to_mg(part(h, inner, 1).cast("double"), part(h, inner, 2)))

    def percents(t: Column, pattern: str) -> Column:
        return F.transform(hits(t, pattern), lambda h: part(h, NUMBER + r"\s*%").cast("double") * 10.0 * plain_volume(h))

    def dose(t: Column) -> Column:
        by_mass = F.concat(masses(t, drug_pattern + r"\s*" + mass, mass + "$"), masses(t, mass + r"\s*" + drug_pattern, "^" + mass))
        by_percent = F.concat(percents(t, NUMBER + r"\s*%\s*" + drug_pattern + r"[^+;,，；]*"),
                              percents(t, drug_pattern + r"\s*" + NUMBER + r"\s*%[^+;,，；]*"))
        segments = F.filter(F.split(t, r"[+;,，；]"), lambda x: x.rlike(FLAGS + drug_pattern))
        any_dose = F.coalesce(sum_or_null(by_mass), sum_or_null(by_percent), sum_or_null(F.transform(segments, plain_volume)))
        return F.when(t.rlike(FLAGS + drug_pattern), any_dose)

    return dose(c) if ready else let(normalize_formula(c), dose)


def zero_when_absent(has: Column, dose: Column) -> Column:
    return F.when(has == 0, 0.0).otherwise(F.coalesce(dose, F.lit(0.0)))


def row_total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols], F.lit(0.0))
