"""Phrase collocation mining by set-oriented relational steps (SETM).

Occurrences are relations, persisted in the shared folder.  Rk holds the places in a text where a frequent phrase of k words
starts, with the numbers of its words, sorted by place; a text is one row, its places and numbers are lists.  Places count on by
one inside a piece and by more between pieces, so neighbours in a piece are neighbouring places.  A step merge-joins Rk with
itself on adjacent places: two frequent phrases that overlap in k - 1 words are an occurrence of k + 1 words.  The result is
grouped by the words' numbers and counted, and R(k+1) is its semi-join with the frequent groups.

The semi-join reads a bitmap of the groups' hashes: of fixed size however many groups there are.  An infrequent phrase may slip
through (one in 16, more beyond MOST_BITS / 16 groups); it is counted in the next step and fails there, as all parts of a frequent
phrase are frequent.  Numbers are 64-bit hashes of the words, drawn anew until no two words of the corpus share one, so groups are
exact.  Scores are, too: 10^6 a^2 is a decimal of up to 37 digits for counts below 10^15.

Scale: occurrences are never shuffled, only counts that each task has summed over some texts; joins of names and parts see the frequent
phrases alone.  A task holds CHUNK words or one text at a time.  The best phrases of a language are chosen in salted parts first.

Nulls and other cases: a null text is empty; a null language is ``und`` and joins texts that say so; empty texts, pieces and
tables give nothing; equal rows and repeated or null doc_ids are texts of their own, doc_id is never read; other columns are
ignored.  Ties at the last rank are resolved by phrase in byte order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import SALTS, discard, stored
from riskframe.llm.jaccard_join import ODD, scramble

BREAKS = b".,;:!?\n\x0b\x0c\r"  # fixed value of the query contract: what ends a piece
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = bytes.maketrans(UPPER.encode() + BREAKS, LOWER.encode() + b"." * len(BREAKS))
LEAST, LONGEST, KEPT, COVERED_PERCENT = 10, 3, 2000, 50
COUNT = "decimal(15,0)"  # of occurrences, so that a product of two and 10^6 stays within 38 digits
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 2**20, 2**27
BUCKET = 32768  # fixed value: bits of one row of bitmap_construct_agg
HASHED_WORDS, COUNTED_WORDS = 200_000, 200_000  # words whose numbers and counts a task keeps at once
BATCH_ROWS, ROWS_SENT = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
CHUNK = 2**18  # words that a task handles at once; a longer text is a chunk of its own
RELATION = "lang string, places array<long>, ids array<long>, alive array<boolean>"


class Numbers(dict):
    """Numbers of words; 0 is the break."""

    def __init__(self, seed: int):
        super().__init__()
        self.key = seed.to_bytes(8, "little")
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHED_WORDS:
            self.__init__(int.from_bytes(self.key, "little"))
        self[word] = n = int.from_bytes(blake2b(word, digest_size=8, key=self.key).digest(), "little", signed=True)
        return n


def tokens(text: bytes | None) -> list[bytes]:
    """Words and breaks (a full stop each) of a text; splitting bytes cuts at ASCII white space only."""
    return (text or b"").translate(PLAIN).replace(b".", b" . ").split()


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """C1 of all words: (lang, word, id, a)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers = Numbers(seed)
        counts: dict[str, Counter] = defaultdict(Counter)

        def told() -> Iterator:
            for lang, own in counts.items():
                own.pop(b".", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()),
                                                  pa.array([numbers[w] for w in own], pa.int64()), pa.array(list(own.values()), pa.int64())],
                                                 names=["lang", "word", "id", "a"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[lang].update(tokens(text.as_py()))
                if sum(map(len, counts.values())) > COUNTED_WORDS:
                    yield from told()
        yield from told()

    partial = texts(docs).mapInArrow(run, "lang string, word string, id long, a long")
    return partial.groupBy("lang", "word").agg(F.max("id").alias("id"), F.sum("a").alias("a"))


def group_hash(langs: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    out = langs
    for c in columns:
        out = scramble(out * ODD + c.view(np.uint64))
    return out


def language_hashes(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def bitmap_of(groups: DataFrame, keys: list[str]) -> np.ndarray:
    """Bits of the groups' hashes; its size is a power of two and follows the number of groups up to MOST_BITS."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * groups.count()):
        bits *= 2

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h = group_hash(language_hashes(batch.column(0).to_pylist()), [np.asarray(c) for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(bits)).astype(np.int64) + 1)], names=["at"])

    at = groups.select("lang", *keys).mapInArrow(run, "at long")
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((bits // BUCKET, BUCKET // 8), np.uint8)
    for r in rows.collect():  # at most MOST_BITS / BUCKET rows
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(8 * len(bitmap))
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def relation_batch(langs: list[str], rows: np.ndarray, places: np.ndarray, ids: np.ndarray, alive: np.ndarray):  # noqa: ANN201
    """Record batch of the texts that have elements; ``rows`` says which text each element is of, ascending."""
    import pyarrow as pa

    ends = np.cumsum(np.bincount(rows, minlength=len(langs)))
    full = np.flatnonzero(np.diff(ends, prepend=0))
    offsets = pa.array(np.append(0, ends[full]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (places, ids, alive)]
    return pa.RecordBatch.from_arrays([pa.array([langs[i] for i in full], pa.string()), *lists], names=["lang", "places", "ids", "alive"])


def first_relation(docs: DataFrame, seed: int, bitmap: np.ndarray) -> DataFrame:
    """R1: places and numbers of the frequent words of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator) -> Iterator:
        numbers = Numbers(seed)

        def told(langs: list[str], found: list[np.ndarray]):  # noqa: ANN202
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            places, ids = np.concatenate([np.arange(len(f)) for f in found]), np.concatenate(found)
            keep = (ids != 0) & marked(sent.value, group_hash(language_hashes(langs)[rows], [ids]))
            return relation_batch(langs, rows[keep], places[keep], ids[keep], np.ones(int(keep.sum()), bool))

        for batch in batches:
            langs, found, held = [], [], 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                langs.append(lang)
                found.append(np.fromiter(map(numbers.__getitem__, tokens(text.as_py())), np.int64))
                held += len(found[-1])
                if held > CHUNK:
                    yield told(langs, found)
                    langs, found, held = [], [], 0
            if found:
                yield told(langs, found)

    return texts(docs).mapInArrow(run, RELATION)


def chunks(batches: Iterator) -> Iterator:
    """The batches' texts in parts of about CHUNK words."""
    for batch in batches:
        ends = np.asarray(batch.column(1).offsets)[1:] - np.asarray(batch.column(1).offsets)[0]
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def merge_joined(batch, length: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Of texts with their frequent phrases of ``length`` words: languages, the text, place and number of each word, and the
    words from which two such phrases start one place apart."""
    sizes = np.diff(np.asarray(batch.column(1).offsets))
    rows = np.repeat(np.arange(batch.num_rows), sizes)
    places, ids, alive = (np.asarray(batch.column(i).flatten()) for i in (1, 2, 3))
    starts = np.flatnonzero(alive[:-1] & alive[1:] & (rows[1:] == rows[:-1]) & (places[1:] == places[:-1] + 1))
    return batch.column(0).to_pylist(), rows, places, ids, starts


def counted_phrases(relation: DataFrame, length: int) -> DataFrame:
    """C(length + 1): (lang, i0, i1, ..., a) of the occurrences that the merge-join gives."""
    keys = [f"i{j}" for j in range(length + 1)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches):
            langs, rows, _, ids, starts = merge_joined(batch, length)
            if not len(starts):
                continue
            codes, lang_of = np.unique(np.array(langs, object), return_inverse=True)
            columns = [lang_of[rows[starts]].astype(np.int64), *[ids[starts + j] for j in range(length + 1)]]
            order = np.argsort(group_hash(columns[0].view(np.uint64), columns[1:]))
            columns = [c[order] for c in columns]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(codes[columns[0][at]], pa.string()), *[pa.array(c[at]) for c in columns[1:]],
                                              pa.array(np.diff(np.append(at, len(order))))], names=["lang", *keys, "a"])

    partial = relation.mapInArrow(run, f"lang string, {', '.join(f'{k} long' for k in keys)}, a long")
    return partial.groupBy("lang", *keys).agg(F.sum("a").alias("a"))


def next_relation(relation: DataFrame, length: int, bitmap: np.ndarray) -> DataFrame:
    """R(length + 1): the words of the merge-join's occurrences that are in the bitmap, ``alive`` where one starts."""
    sent = relation.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator) -> Iterator:
        for batch in chunks(batches):
            langs, rows, places, ids, starts = merge_joined(batch, length)
            hashes = group_hash(language_hashes(langs)[rows[starts]], [ids[starts + j] for j in range(length + 1)])
            starts = starts[marked(sent.value, hashes)]
            alive, held = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            alive[starts] = True
            for j in range(length + 1):
                held[starts + j] = True
            yield relation_batch(langs, rows[held], places[held], ids[held], alive[held])

    return relation.mapInArrow(run, RELATION)


def numbered_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """C1 and the seed with which all its words have numbers of their own."""
    seed = 0
    while True:
        counts = stored(counted_words(docs, seed), "words")
        shared = counts.groupBy("id").agg(F.min("word").alias("_a"), F.max("word").alias("_b")).where("_a <> _b or id = 0")
        if shared.isEmpty():
            return counts, seed
        seed += 1


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows are whole texts, so fewer of them than usual go to a Python worker at once."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(int(before), ROWS_SENT) if int(before) > 0 else ROWS_SENT)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length: (lang, words, a) each, from length 1; and (lang, n), all words of a language."""
    if longest < 2 or least < 1:
        raise ValueError("longest must be at least 2 and least at least 1")
    with small_batches(docs.sparkSession):
        return _mine(docs, least, longest)


def _mine(docs: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    counts, seed = numbered_words(docs)
    frequent = F.col("a") >= least
    names = stored(counts.where(frequent).select("lang", "id", "word", "a"), "names")
    phrases = [names.select("lang", F.array("word").alias("words"), "a")]
    relation = stored(first_relation(docs, seed, bitmap_of(names, ["id"])), "occurrences")
    for length in range(1, longest):
        keys = [f"i{j}" for j in range(length + 1)]
        groups = stored(counted_phrases(relation, length).where(frequent), "groups")
        named = groups
        for k in keys:
            named = named.join(names.select("lang", F.col("id").alias(k), F.col("word").alias(f"w{k}")), ["lang", k])
        phrases.append(stored(named.select("lang", F.array(*[f"w{k}" for k in keys]).alias("words"), "a"), "phrases"))
        if length + 1 < longest:
            grown = stored(next_relation(relation, length, bitmap_of(groups, keys)), "occurrences")
            discard(relation)
            relation = grown
    discard(relation)
    return phrases, counts.groupBy("lang").agg(F.sum("a").alias("n"))


def scored(phrases: list[DataFrame]) -> DataFrame:
    """(lang, words, a, l, r, score) of all phrases of two words and more: the cut with the lowest score, the first of equal ones."""
    parts = reduce(DataFrame.unionByName, [p.select("lang", "words", "a") for p in phrases[:-1]])
    every = reduce(DataFrame.unionByName, [p.select("lang", "words", "a") for p in phrases[1:]])
    cuts = every.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"_l": F.slice("words", F.lit(1), F.col("k")), "_r": F.slice("words", F.col("k") + 1, F.size("words"))})
    for side in ("l", "r"):
        cuts = cuts.join(parts.select("lang", F.col("words").alias(f"_{side}"), F.col("a").alias(side)), ["lang", f"_{side}"])
    big = lambda c: F.col(c).cast(COUNT)
    cuts = cuts.withColumn("_above", big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("_below", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("_above div _below"))
    best = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    return best.select("lang", "words", "a", "_b.l", "_b.r", "_b.score")


def without_covered(candidates: DataFrame, phrases: list[DataFrame], percent: int = COVERED_PERCENT) -> DataFrame:
    """Candidates that no longer phrase covers: a longer one with most of the occurrences holds one that is longer by one word."""
    longer = reduce(DataFrame.unionByName, [p.select("lang", "words", F.col("a").alias("_a")) for p in phrases[2:]])
    inner = F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)))
    most = longer.select("lang", inner.alias("words"), "_a").groupBy("lang", "words").agg(F.max("_a").alias("_a"))
    kept = candidates.join(most, ["lang", "words"], "left")
    return kept.where(F.col("_a").isNull() | (100 * F.col("_a").cast(COUNT) < percent * F.col("a").cast(COUNT))).drop("_a")


def best_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, kept: int = KEPT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``kept`` best phrases."""
    phrases, totals = mine(docs, least, longest)
    found = scored(phrases)
    if longest > 2:
        found = without_covered(found, phrases)
    found = found.withColumn("phrase", F.array_join("words", " "))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= kept)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= kept)
    out = found.join(F.broadcast(totals), "lang") if totals.count() <= SALTS else found.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
