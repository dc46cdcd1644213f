"""One registered query per operator, each over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import chat_format, collocations, decontaminate, jaccard_join, mixing, periodic_runs, quality, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts, toxicity
from riskframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query(rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[src % 3 + 1] AS weight, 2 * source_size AS cap FROM per),
filled AS (SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights, sum(source_size) OVER () AS n, sum(weight) OVER () AS w
           FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, src ROWS UNBOUNDED PRECEDING)),
level AS (SELECT greatest(max(1.5 * n::DOUBLE / w::DOUBLE), coalesce(max((1.5 * n::DOUBLE - caps::DOUBLE) / (w - weights)::DOUBLE) FILTER (weights < w), 0)) AS level FROM filled),
targets AS (SELECT source, src, source_size, CASE WHEN n = 0 THEN 0 ELSE least(cap::DOUBLE, level * weight) END AS target FROM filled, level),
ends AS (SELECT *, sum(target) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS upto FROM targets),
total AS (SELECT round(sum(target), 3) AS total, max(upto) AS whole FROM ends),
bits AS (SELECT *, CASE WHEN floor(greatest(total / {mixing.BLOCK_WORDS}, 1) - 1e-9) < 1 THEN 0
                   ELSE length(ltrim(bin(floor(greatest(total / {mixing.BLOCK_WORDS}, 1) - 1e-9)::BIGINT), '0')) END AS k FROM total),
slots AS (SELECT e.*, total / pow(2, k) AS width, ceil(upto / whole * pow(2, k)) - ceil((upto - target) / whole * pow(2, k)) AS n_slots FROM ends e, bits),
placed AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.n_slots * t.width) AS most,
                  sum(s.size) OVER (PARTITION BY t.src ORDER BY md5(concat(coalesce(s.doc_id::VARCHAR, ''), '|mix')), s.doc_id, s.size
                                    ROWS UNBOUNDED PRECEDING) - s.size AS start
           FROM sized s JOIN slots t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (greatest(least(start + size, most) - start, 0) + greatest(least(start + size + source_size, most) - start - source_size, 0))::BIGINT AS taken
FROM placed""")
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf, "documents"))


@query()
def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf, "labels")))


@query()
def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf, "documents"))


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i:i + 9], ' ') AS gram
         FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
grams AS (SELECT doc_id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS gram
          FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM wins))),
hits AS (SELECT doc_id, i, l, item_id FROM grams JOIN wins USING (l, gram)),
per AS (SELECT doc_id, count(DISTINCT i + o) FILTER (o < l) AS n_hit FROM hits, range(0, 10) r(o) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("_h")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
grams AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
late AS (SELECT doc_id, i FROM grams QUALIFY doc_id > min(doc_id) OVER (PARTITION BY gram)),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM late, range(0, 50) r(o)),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS s, count(*) AS n
         FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) w ANTI JOIN gone g USING (doc_id, i) GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf, "documents"))


@query()
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query()
def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    cut = sharding.shard(table(spark, sf, "documents"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return token_counts.with_token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


_stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_verdict = " AND ".join(f"{m} {op} {b}" for m, lo, hi in quality_rules.RULES for op, b in ((">=", lo), ("<=", hi)) if b is not None)


@query(rf"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
                    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM cut)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, range(0, 8) r(o) GROUP BY doc_id),
counted AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                   len(list_filter(ws, lambda x: lower(x) IN ({_stops}))) AS stops, len(ls) AS n_lines
            FROM cut LEFT JOIN repeats r USING (doc_id)),
metrics AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
                   stops / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
                   n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict} AS kept,
       mean_word_chars, symbols_per_word, stop_word_ratio, dup_line_ratio FROM metrics""")
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf, "documents"))


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
          JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.to_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, c) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS c FROM reach GROUP BY doc_id) USING (doc_id)""")
def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents")).drop("_h")


_turn_chars = sum(len(mark) for mark in (chat_format.TURN, chat_format.TEXT, chat_format.END))


@query(rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{chat_format.ODD_TEXT}'), (-1, 1, 'assistant', '{chat_format.ODD_TEXT}')),
e AS (SELECT *, role || chr(10) || text || chr(10) AS told,
             {_turn_chars} + length(regexp_replace(role, '{chat_format.CONTROL}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{chat_format.CONTROL}', '\1\\\2\3', 'g')) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(told, '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def op11_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(chat_format.ODD_TEXT).alias("text"))
    return chat_format.digests(rows.unionByName(more))


@query()
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf, "documents"), rewrite=True).drop("runs")


@query(rf"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{collocations.UPPER}', '{collocations.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
u AS (SELECT lang, piece, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM p),
w AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*)::HUGEINT AS a FROM w GROUP BY ALL
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM w WHERE w2 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM w WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {collocations.LEAST}),
parts AS (SELECT *, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT t.lang, t.k, t.phrase, t.a, x.a AS l, y.a AS r, j, (1000000::HUGEINT * t.a * t.a) // (x.a * y.a) AS score
        FROM parts t JOIN f x ON x.lang = t.lang AND x.phrase = t.head JOIN f y ON y.lang = t.lang AND y.phrase = t.tail),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
         FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE NOT coalesce(100 * g.a >= {collocations.COVERED_PERCENT} * b.a, false))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM kept JOIN n USING (lang) WHERE rank <= {collocations.KEPT}""")
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.best_phrases(table(spark, sf, "documents"))
