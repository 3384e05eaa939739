"""Operator 5, mixing sources to target weights by entropy balancing [native].

Document rates r_i minimise the entropy distance to the natural rate 1,

    sum_i r_i ln r_i - r_i + 1   subject to   sum_{i in s} r_i n_i = T_s,   0 <= r_i <= cap,

with n_i the words of a document and T_s the token target of its source. The dual is convex with
one multiplier per source and gives tilted rates r_i = min(cap, exp(lambda_s n_i / mean_s)).
Safeguarded Newton steps on ln(sum r n) - ln T solve it: each step is one Spark aggregation over
(source, size) cells, which hold all documents of one size (documents of one cell have one rate).
Multipliers stay in a table; the driver sees one number per step, the largest residual.

Rates are rounded into whole copies by systematic rounding along the sizes of a source, so a
source's words miss the target by less than one of its largest documents; of 16 starting points the
one with the smallest miss is taken, and one copy more or less, of the size nearest to what is still
missed, makes up for that. Within a cell the documents with the smallest hashed ids get
the extra copies; cells are ranked in pieces of bounded size, so a third of all rows in one cell
is no single task.

Defined results: null text has 0 words, and documents of 0 words get one copy and 0 words taken; null
source is a source of its own, last in order; targets are 0 if there are no words at all; reruns agree
(ties go by hashed id, then id; rows equal in id, source and size are interchangeable); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.llm.common import documents, packed, row_hash, spool, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
TOLERANCE = 1e-7
MAX_STEPS = 60
STARTS = 16
PIECE = 256


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: key, source_size, target and the statistics the solver needs.

    Water filling: with sources ordered by cap*size/weight, the common level is the largest of
    (budget - capped sizes before) / (weights left); a target is min(cap*size, weight*level).
    The windows here run over one row per source.
    """
    per = (sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"),
                                    F.count(F.when(F.col("size") > 0, 1)).alias("filled"),
                                    F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")))
    place = F.row_number().over(Window.orderBy("key")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("ceiling", cap * F.col("source_size").cast("double"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("ceiling") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    spare = share * F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    per = per.withColumn("level", spare / left)
    per = per.withColumn("level", F.max("level").over(every))
    return per.withColumn("target", F.least("ceiling", F.col("weight") * F.col("level"))).drop("level", "weight")


def _start(per: DataFrame, cap: int) -> DataFrame:
    """Multipliers at 0 between bounds that hold the root: a rate below 1 everywhere, or the cap."""
    x_least = F.col("least") * F.col("filled") / F.col("source_size")
    ratio = F.log(F.col("target") / F.col("source_size"))
    low = F.when(ratio < 0, ratio / x_least).otherwise(F.lit(0.0))
    high = F.when(ratio < 0, F.lit(0.0)).otherwise(F.log(F.lit(float(cap))) / x_least)
    full = F.col("target") >= F.col("ceiling") * (1 - 1e-12)
    return (per.filter("source_size > 0")
            .select("key", "source_size", "target", (F.col("source_size") / F.col("filled")).alias("mean"), low.alias("low"), high.alias("high"), full.alias("done"))
            .withColumn("multiplier", F.when(F.col("done"), F.col("high")).otherwise(F.lit(0.0)))
            .withColumn("residual", F.when(F.col("done"), F.lit(0.0)).otherwise(F.lit(1.0))))


def _rate(cap: int):
    return F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * F.col("size") / F.col("mean")))


def newton_step(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One step for every source that isn't done: sums over the cells, then the new multiplier."""
    words = F.col("docs") * F.col("size")
    rated = cells.join(state.filter("not done").select("key", "multiplier", "mean"), "key").withColumn("rate", _rate(cap))
    sums = rated.groupBy("key").agg(
        F.sum(words * F.col("rate")).alias("sum"),
        F.sum(F.when(F.col("rate") < cap, words * F.col("rate") * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
    s = state.join(sums, "key", "left")
    above = F.col("sum") > F.col("target")
    s = (s.withColumn("low", F.when(F.col("done") | above, F.col("low")).otherwise(F.col("multiplier")))
         .withColumn("high", F.when(~F.col("done") & above, F.col("multiplier")).otherwise(F.col("high")))
         .withColumn("residual", F.when(F.col("done"), F.col("residual")).otherwise(F.abs(F.col("sum") / F.col("target") - 1)))
         .withColumn("next", F.col("multiplier") - (F.log("sum") - F.log("target")) * F.col("sum") / F.when(F.col("slope") > 0, F.col("slope"))))
    inside = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
    s = s.withColumn("next", F.when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2))
    ended = F.col("done") | (F.col("residual") <= TOLERANCE)
    return (s.withColumn("multiplier", F.when(ended, F.col("multiplier")).otherwise(F.col("next")))
            .withColumn("done", ended).select(*state.columns))


def solve(cells: DataFrame, per: DataFrame, cap: int = CAP, max_steps: int = MAX_STEPS) -> DataFrame:
    """Newton steps until every source is within TOLERANCE of its target. Each state is written down.
    Raises if a source is still apart from its target after ``max_steps``."""
    state = spool(_start(per, cap), "mix-state")
    for step in range(max_steps + 1):
        if state.filter("not done").isEmpty():
            return state
        if step < max_steps:
            state = spool(newton_step(cells, state, cap), "mix-state")
    raise RuntimeError(f"{state.filter('not done').count()} sources have not met their targets after {max_steps} steps")


def _cell_copies(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """Copies that each cell gives in all: systematic rounding of the cumulated rates by size."""
    order = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    c = (cells.join(state.select("key", "multiplier", "mean", "target"), "key").withColumn("rate", _rate(cap))
         .withColumn("mass", F.col("docs") * F.col("rate")).withColumn("upto", F.sum("mass").over(order)))

    def copies(start):
        return F.floor(F.col("upto") + start) - F.floor(F.col("upto") - F.col("mass") + start)

    tries = c.groupBy("key").agg(F.first("target").alias("aim"), *[F.sum(copies(F.lit(k / STARTS)) * F.col("size")).alias(f"t{k}") for k in range(STARTS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("aim")).alias("miss"), F.lit(k / STARTS).alias("start")) for k in range(STARTS)]))
    c = c.join(tries.select("key", "aim", best.getField("start").alias("start")), "key")
    c = c.select("key", "size", "docs", "rate", "aim", F.greatest(F.lit(0), F.least(cap * F.col("docs"), copies(F.col("start")))).cast("long").alias("copies"))
    over = F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("key")) - F.col("aim")
    can = F.when(F.col("over") > 0, F.col("copies") > 0).otherwise(F.col("copies") < cap * F.col("docs"))
    left = F.abs(F.abs("over") - F.col("size"))
    c = c.withColumn("over", over).withColumn("left", F.when(can & (left < F.abs("over")), left))
    pick = F.row_number().over(Window.partitionBy("key").orderBy(F.col("left").asc_nulls_last(), "size"))
    fix = F.when((F.col("pick") == 1) & F.col("left").isNotNull(), -F.signum("over")).otherwise(0).cast("long")
    return c.withColumn("pick", pick).select("key", "size", "docs", "rate", (F.col("copies") + fix).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per document: id, mark (hash of its text), source, size, source_size, target, rate, copies."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    text = F.col(f"`{text_col}`")
    sizes = spool(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"))
                  .withColumn("key", key), "mix-sizes")
    per = spool(source_targets(sizes, weights, share, cap), "mix-targets")
    cells = spool(sizes.filter("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-cells")
    counts = spool(_cell_copies(cells, solve(cells, per, cap), cap), "mix-copies")
    extra = F.col("copies") - F.floor(F.col("copies") / F.col("docs")) * F.col("docs")
    d = sizes.join(counts, ["key", "size"], "left").withColumn("extra", F.coalesce(extra, F.lit(0)))
    d = d.withColumn("given", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("copies") / F.col("docs"))).cast("long"))
    d = d.withColumn("hash", F.xxhash64("id")).withColumn("piece", F.pmod("hash", F.ceil(F.col("docs") / PIECE)))
    tied = d.filter("extra > 0")
    before = Window.partitionBy("key", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (tied.groupBy("key", "size", "piece").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "piece").orderBy("hash", "id", "mark"))
    tied = (tied.withColumn("rank", rank).join(pieces, ["key", "size", "piece"])
            .withColumn("given", F.col("given") + F.when(F.col("rank") + F.col("before") <= F.col("extra"), 1).otherwise(0)))
    cols = ["id", "mark", "key", "size", "rate", "given"]
    both = d.filter("extra = 0").select(*cols).unionByName(tied.select(*cols))
    return (both.join(per.select("key", "source", "source_size", "target"), "key")
            .select("id", "mark", "source", "size", "source_size", "target", "rate", F.col("given").alias("copies")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it has copies."""
    plan = mix(docs, id_col, text_col, source_col, **options)
    keys = ["id", "mark", "source"]
    total = plan.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    total = total.select(*[F.col(k).alias(f"{k}_") for k in keys], "copies", "rows")
    d = packed(docs).select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(f"row.`{text_col}`").alias("mark"), F.col(f"row.`{source_col}`").cast("string").alias("source"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    d = d.join(total, same).withColumn("nth", F.row_number().over(Window.partitionBy("id_", "mark_", "source_").orderBy(row_hash())))
    each = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("nth") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return d.withColumn("each", each.cast("int")).filter("each > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("each")))).select("row.*")


def op5_entropy_mix(spark, sf_dir):
    """doc_id, size, source_size, target, taken (and source, rate, copies) for every row of documents."""
    m = mix(documents(spark, sf_dir))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")
