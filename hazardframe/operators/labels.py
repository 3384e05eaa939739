"""Label-table operators: class counts (D3/D4/H7/F3), label frequency (D5/D6/B8), frequent
label filtering (C8/G4/F5/H12) and multi-hot encoding (G6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.functions.text import truncate_text
from hazardframe.session import checkpoint_dir

# Largest frequent-label set that is inlined as a literal array; above it the distinct lists are
# filtered by a semi-join of their items (shuffles, but no size limit, and the same rows).
MAX_INLINE_LABELS = 10_000


def class_counts(df: DataFrame, text_col: str, classify, classes: list[str],
                 class_col: str = "hazard_class") -> DataFrame:
    """D3: rows per normalised class over non-missing texts, every listed class present
    (zero when unseen). The class list is a small literal table; the count is one grouped
    aggregation with map-side combine."""
    spark = df.sparkSession
    k = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{class_col} string, class_idx int")
    c = (df.filter(F.col(text_col).isNotNull())
         .groupBy(classify(F.col(text_col)).alias(class_col)).agg(F.count(F.lit(1)).alias("n")))
    return (k.join(c, class_col, "left")
            .select(class_col, "class_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def class_value_counts(df: DataFrame, text_col: str, classify, class_col: str = "hazard_class",
                       width: int = 200) -> DataFrame:
    """Per class, each raw text with its count (most frequent first when ordered),
    the number of distinct texts of the class, and the text cut to ``width`` for display."""
    g = (df.filter(F.col(text_col).isNotNull())
         .groupBy(classify(F.col(text_col)).alias(class_col), F.col(text_col)).agg(F.count(F.lit(1)).alias("n")))
    per_class = g.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_distinct"))
    return (g.join(per_class, class_col)
            .select(class_col, truncate_text(F.col(text_col), width).alias("display_text"),
                    F.col("n").cast("long").alias("n"), F.col("n_distinct").cast("long").alias("n_distinct"))
            .orderBy(class_col, F.col("n").desc(), "display_text"))


def label_frequency(df: DataFrame, labels_col: str) -> DataFrame:
    """Occurrences of each label over a list column (rows with a missing list skipped)."""
    return (df.filter(F.col(labels_col).isNotNull())
            .select(F.explode(labels_col).alias("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def frequent_labels(freq: DataFrame, min_count: int = 50) -> tuple[DataFrame, DataFrame]:
    """(frequent, removed) split; frequent means count > ``min_count``."""
    return freq.filter(F.col("n") > min_count), freq.filter(F.col("n") <= min_count)


def keep_labels(df: DataFrame, labels_col: str, keep: DataFrame, label_col: str = "label",
                inline_limit: int = MAX_INLINE_LABELS) -> DataFrame:
    """Keep only list items found in ``keep``; rows left with no label are dropped.

    Up to ``inline_limit`` labels the set becomes a hash-set literal (no shuffle of the rows).
    Beyond that each *distinct* list is filtered once by a semi-join of its items and rows find
    their filtered list by the list itself, so rows need no key of their own and repeated rows
    stay repeated.
    """
    # One bounded fetch doubles as the size check: at most inline_limit + 1 rows come back.
    vals = [r[0] for r in keep.select(label_col).limit(inline_limit + 1).collect()]
    if len(vals) <= inline_limit:
        # ``isin`` over a literal list becomes a hash-set lookup (InSet), not a linear scan.
        out = df.withColumn(labels_col, F.filter(labels_col, lambda x: x.isin(*vals) if vals else F.lit(False)))
        return out.filter(F.size(F.coalesce(F.col(labels_col), F.array().cast("array<string>"))) > 0)
    lists = df.select(F.col(labels_col).alias("__list")).filter(F.col("__list").isNotNull()).distinct()
    items = lists.select("__list", F.posexplode("__list").alias("pos", "__l"))
    items = items.join(keep.select(F.col(label_col).alias("__l")).distinct(), "__l", "left_semi")
    kept = (items.groupBy("__list").agg(F.array_sort(F.collect_list(F.struct("pos", "__l"))).alias("__s"))
            .select("__list", F.transform("__s", lambda s: s["__l"]).alias("__kept")))
    out = df.join(kept, F.col(labels_col) == F.col("__list"))
    return out.withColumn(labels_col, F.col("__kept")).select(*df.columns)


def dense_index(df: DataFrame, col: str, name: str = "label_idx") -> DataFrame:
    """Each distinct non-missing value of ``col`` with its place in sorted order, for any number of values.

    The distinct values are dealt into ranges and sorted there (no task sees them all); a value's place is its place in its range plus
    the sizes of the ranges before. Range borders come from a sample, so the ranges are written down once before they are counted."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    values = df.select(F.col(col)).filter(F.col(col).isNotNull()).distinct().repartitionByRange(col).sortWithinPartitions(col)
    # The number holds the range in its upper bits and the place in it in the 33 lower ones.
    placed = values.withColumn("__at", F.monotonically_increasing_id()).checkpoint(eager=True)
    at, low = F.col("__at"), (1 << 33) - 1
    sizes = placed.groupBy(F.shiftright(at, 33).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))  # one row per range
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    starts = sizes.select("__range", before.alias("__before"))
    out = placed.withColumn("__range", F.shiftright(at, 33)).join(F.broadcast(starts), "__range")
    return out.select(col, (at.bitwiseAND(F.lit(low)) + F.col("__before")).cast("long").alias(name))


def label_index(keep: DataFrame, label_col: str = "label") -> DataFrame:
    """each distinct label with its position in sorted order (one row per class)."""
    return dense_index(keep, label_col)


def encode_labels(df: DataFrame, label_col: str = "label", name: str = "label_idx") -> DataFrame:
    """M1 for any number of classes: rows with their label's alphabetical code (NULL for a missing label). The codes join in by label;
    AQE splits a label that many rows have."""
    return df.join(dense_index(df, label_col, name), label_col, "left").select(*df.columns, name)


def sparse_hot(df: DataFrame, labels_col: str, classes: DataFrame, id_col: str, label_col: str = "label", idx_col: str = "label_idx") -> DataFrame:
    """G6 for wide label sets: each id with the ascending codes of its labels among ``classes`` (label, code) and the number
    of classes - a 0/1 vector as the places of its ones, whatever the width. Other labels have no place; ids are unique."""
    items = df.select(id_col, F.explode(F.array_distinct(labels_col)).alias(label_col)).join(classes.select(label_col, idx_col), label_col)
    ones = items.groupBy(id_col).agg(F.array_sort(F.collect_list(idx_col)).alias("ones"))
    width = classes.agg(F.max(idx_col)).first()[0]
    width = 0 if width is None else int(width) + 1
    return df.select(id_col).join(ones, id_col, "left").select(id_col, F.coalesce("ones", F.array().cast("array<long>")).alias("ones"), F.lit(width).cast("long").alias("width"))


def sorted_labels(keep: DataFrame, label_col: str = "label") -> list[str]:
    """the class list in sorted order for encoders whose width is the number of classes."""
    return [r[0] for r in label_index(keep, label_col).orderBy("label_idx").collect()]


def multi_hot(labels: Column, classes: list[str]) -> Column:
    """0/1 per class (sorted class order) for one list column."""
    cl = F.array(*[F.lit(c) for c in classes])
    return F.transform(cl, lambda c: F.array_contains(labels, c).cast("int"))


def ordinal(values: list[str]) -> Column:
    """Fixed-order category index (F4 helper): 1-based position in ``values``, 0 if absent."""
    return F.array(*[F.lit(v) for v in values])


def rank_in_order(col, values: list[str]) -> Column:
    return F.array_position(ordinal(values), col)


def class_set(df: DataFrame, col: str, expected: list[str]) -> DataFrame:
    """M2: every class of ``col`` or ``expected`` with ``seen`` and ``expected`` flags (one row per class)."""
    seen = df.select(F.col(col).alias("label")).filter(F.col("label").isNotNull()).distinct().withColumn("__seen", F.lit(True))
    want = df.sparkSession.createDataFrame([(c, True) for c in expected], "label string, __want boolean")
    return seen.join(want, "label", "full").select(
        "label", F.coalesce("__seen", F.lit(False)).alias("seen"), F.coalesce("__want", F.lit(False)).alias("expected"))


def assert_classes(df: DataFrame, col: str, expected: list[str]) -> None:
    """M2: the set of classes in ``col`` must equal ``expected``. At most len(expected) + 1 classes
    come to the driver; one more than expected is already a failure."""
    seen = {r[0] for r in df.select(col).distinct().limit(len(set(expected)) + 1).collect()}
    if seen != set(expected):
        raise AssertionError(f"Unexpected classes: {sorted(map(str, seen ^ set(expected)))}")
