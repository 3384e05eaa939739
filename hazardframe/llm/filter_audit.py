"""Operator 11, filter interaction audit by truth-table survival words.

Five filters fail a document or not. Bit s of a document's 32-bit survival word says whether it survives the
subset s of the filters, that is whether none of those in s fails it: the word is the AND, over the
filters that fail it, of the truth table of "s lacks this filter". The sum of bit s over all documents of
a part and label class is the number of survivors of subset s, for all 32 subsets at once. Whatever order the
filters are applied in, each step only depends on survivors of subsets, so the report of all 120 orders is
read off these sums.

1. one pass over the texts gives each row its failures of filters A to D and a digest of its text;
   equal (id, part, digest) rows merge in the task and at the shuffle, and carry their count;
2. the smallest id per digest (combined in the tasks, so a text that a third of all rows repeat is one row per task)
   decides filter E. A row finds out by joining on (digest, id), which no text makes hot;
3. labels join by id; tasks add up survival words per (part, good, toxic) with a carry-save positional
   popcount: three words of one weight become a sum word and a carry word of twice the weight, bit by bit, until at
   most two words of a weight are left. A row of count n enters at the weights of n's binary digits;
4. 32 sums for at most four label classes per part are added up by Spark, and every part is unfolded into 120 orders
   of 5 steps. Nothing but the closed list of orders comes from the driver.

Defined results: null text is empty, null part the empty string (the same part as an empty one); an empty text has
no word, fails A only (and E, if a smaller id has an empty text too); rows that repeat an id and its text both count
and none makes the other fail E; a null id comes after all others, and has no labels; a document with several label rows is good
(toxic) if one says so; an empty table gives an empty report; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import bounded_batches, documents, spool

LETTERS = "ABCDE"
SUBSETS = 32
#: Per filter, the subsets that lack it, as a word: bit s is 1 if bit i of s is 0.
LACKING = np.array([sum(1 << s for s in range(SUBSETS) if not s >> i & 1) for i in range(5)], np.uint32)
#: Survival word of each set of failed filters.
WORDS = np.array([np.bitwise_and.reduce([LACKING[i] for i in range(5) if f >> i & 1] or [np.uint32(0xFFFFFFFF)]) for f in range(SUBSETS)], np.uint32)
MIN_WORDS = 100
MIN_DISTINCT = 80  # per cent
MAX_UPPER = 10  # per cent
SYMBOLS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))
CELLS_HELD = 4096


def failures(text: bytes) -> int:
    """Failed filters A to D of one text (UTF-8) as bits 0 to 3."""
    words = text.split()
    points = len(text.translate(None, CONTINUATION))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, UPPER))) > MAX_UPPER * points) << 2
            | (len(text.translate(None, SYMBOLS)) != len(text)) << 3)


def _mark(batches):
    for b in batches:
        texts = [t or b"" for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("part"), pa.array([failures(t) for t in texts], pa.int32()),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["id", "part", "fails", "digest"])


def positional_popcount(words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """For each of the 32 bit positions, how many words have that bit, word i counted times[i] times."""
    total = np.zeros(32, np.int64)
    times = np.ones(len(words), np.int64) if times is None else times.astype(np.int64)
    weight, level, carried = 0, words.astype(np.uint32), np.zeros(0, np.uint32)
    while len(carried) or (times >> weight).any():
        level = np.concatenate([carried, words[(times >> weight & 1).astype(bool)]]).astype(np.uint32)
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n:2 * n], level[2 * n:3 * n]
            odd = a ^ b
            carries.append(a & b | odd & c)
            level = np.concatenate([odd ^ c, level[3 * n:]])
        for w in level:
            total += (int(w) >> np.arange(32) & 1) << weight
        carried = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        weight += 1
    return total


def _popcounts(batches):
    held: dict = {}

    def out():
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.bool_()),
             pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], ["part", "good", "toxic", "survivors"])

    for b in batches:
        words = WORDS[b.column("fails").to_numpy(zero_copy_only=False)]
        times = b.column("n").to_numpy(zero_copy_only=False)
        cells: dict = {}
        for i, key in enumerate(zip(b.column("part").to_pylist(), b.column("good").to_pylist(), b.column("toxic").to_pylist())):
            cells.setdefault(key, []).append(i)
        for key, rows in cells.items():
            held[key] = held.get(key, 0) + positional_popcount(words[rows], times[rows])
        if len(held) > CELLS_HELD:
            yield out()
            held.clear()
    yield out()


def survivors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part and class ('all', 'good', 'toxic'): array of 32, element s the survivors of subset s (bit 0 is filter A)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    marked = rows.mapInArrow(_mark, f"id {id_type}, part string, fails int, digest binary")
    marked = spool(marked.groupBy("id", "part", "fails", "digest").agg(F.count(F.lit(1)).alias("n")), "audit-marks")
    first = marked.groupBy("digest").agg(F.min("id").alias("first")).select("first", F.col("digest").alias("won"))
    marked = marked.join(first, F.col("id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("won")), "left")
    fails = F.col("fails") + F.when(F.col("won").isNull(), 1 << 4).otherwise(0)
    said = (labels.groupBy(F.col("doc_id").alias("labelled"))
            .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    joined = marked.select("id", "part", fails.alias("fails"), "n").join(said, F.col("id") == F.col("labelled"), "left")
    flags = [(F.coalesce(F.col(c), F.lit(0)) == 1).alias(c) for c in ("good", "toxic")]
    counted = joined.select("part", "fails", "n", *flags).mapInArrow(_popcounts, "part string, good boolean, toxic boolean, survivors array<long>")
    cells = counted.select("part", "good", "toxic", F.posexplode("survivors").alias("subset", "n"))
    sums = [F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0).cast("long")).alias(c) for c, on in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    per = cells.groupBy("part", "subset").agg(*sums)
    ordered = F.array_sort(F.collect_list(F.struct("subset", "all", "good", "toxic")))  # 32 entries
    return per.groupBy("part").agg(ordered.alias("x")).select("part", *[F.col(f"x.{c}").alias(c) for c in ("all", "good", "toxic")])


def _shapley(i: int) -> Column:
    """Documents that filter i removes, summed over all orders: each subset of the others comes before it in |s|! (4 - |s|)! of them."""
    total = F.lit(0).cast("long")
    orders = (24, 6, 4, 6, 24)  # |s|! (4 - |s|)!
    for s in range(SUBSETS):
        if not s >> i & 1:
            total = total + (F.col("all")[s] - F.col("all")[s | 1 << i]) * orders[bin(s).count("1")]
    return total


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of that step (see the contract of ``op11_filter_audit``)."""
    spark = docs.sparkSession
    steps = []
    for order in permutations(range(5)):
        name, before = "".join(LETTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, i, before, before | 1 << i))
            before |= 1 << i
    columns = list(zip(*steps))
    counts = spool(survivors(docs, labels, id_col, text_col, part_col).withColumn("shapley", F.array(*[_shapley(i) for i in range(5)])), "audit-survivors")
    named = [F.lit(list(c)).alias(k) for k, c in zip(("filter_order", "step", "i", "before", "after"), columns)]
    rows = counts.select("*", F.inline(F.arrays_zip(*named)))
    full = SUBSETS - 1

    def n(of: str, subset) -> Column:
        return F.get(F.col(of), subset)

    alone = F.get(F.lit([1 << i for i in range(5)]), F.col("i"))
    without = F.lit(full) - alone
    removed = {c: n(c, F.col("before")) - n(c, F.col("after")) for c in ("all", "good", "toxic")}
    return rows.select(
        "part", "filter_order", "step", n("all", F.col("after")).alias("kept"), removed["all"].alias("removed"),
        (n("all", F.lit(0)) - n("all", alone) - removed["all"]).alias("redundant"),
        (n("all", without) - n("all", F.lit(full))).alias("unique_fails"),
        removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"), F.get(F.col("shapley"), F.col("i")).alias("shapley"))


def op11_filter_audit(spark, sf_dir):
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley over all documents."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order FROM k a, k b, k x, k y, k z
  WHERE a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, step, (SELECT bit FROM k WHERE letter = substr(filter_order, step, 1)) AS bit,
    (SELECT coalesce(sum(bit), 0) FROM k WHERE position(letter IN substr(filter_order, 1, step - 1)) > 0) AS before
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) n),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & CAST(before + bit AS INTEGER) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS INTEGER) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS INTEGER) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & CAST(before AS INTEGER) = 0), 0) AS good_lost,
    coalesce(sum(bad) FILTER (mask & bit > 0 AND mask & CAST(before AS INTEGER) = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
