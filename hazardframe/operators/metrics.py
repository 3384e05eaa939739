"""Classification metrics (D10-D16, G2, G5) as aggregations.

Single-label metrics start from the confusion cells ``groupBy(label, prediction).count()``:
partial aggregation leaves at most K^2 rows per task, so everything after it is tiny no matter
how many predictions there are. Multi-label metrics explode only the labels present in the
truth or the prediction of a row (true negatives follow from the row count), so the work is
proportional to the labels present, not rows x label space.

Conventions (those of the common Python metric library, zero_division=0): precision =
TP/(TP+FP), recall = TP/(TP+FN), F1 = 2TP/(2TP+FP+FN); a zero divisor gives 0. Macro = plain
mean over the classes of truth and prediction; weighted = support-weighted mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion_cells(pred: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Counts per (true class, predicted class), one set of cells per combination of the columns ``by``."""
    return pred.groupBy(*(by or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, tp, support, predicted, precision, recall, f1 - one row per class of truth or prediction."""
    return classes_of(confusion_cells(pred, label, prediction))


def classes_of(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``per_class`` from confusion cells (label, prediction, n), stored ones too, per combination of ``by``.

    Each confusion cell gives a row to its true class and one to its predicted class, so one more
    aggregation over the cells answers everything: one pass over the input, no join."""
    by = by or []
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)
    both = F.array(F.struct(F.col("label").alias("class"), n.alias("support"), none.alias("predicted"), hit.alias("tp")),
                   F.struct(F.col("prediction").alias("class"), none.alias("support"), n.alias("predicted"), none.alias("tp")))
    out = (cells.select(*by, F.inline(both)).groupBy(*by, "class")
           .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))
    return out.select("*", _div(F.col("tp"), F.col("predicted")).alias("precision"),
                      _div(F.col("tp"), F.col("support")).alias("recall"),
                      _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def weighted_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 (one row)."""
    return weighted_of(confusion_cells(pred, label, prediction))


def weighted_of(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``weighted_metrics`` from confusion cells, one row per combination of ``by``."""
    n = F.sum("support")
    return classes_of(cells, by).groupBy(*(by or [])).agg(
        _div(F.sum("tp"), n).alias("accuracy"),
        _div(F.sum(F.col("precision") * F.col("support")), n).alias("precision_weighted"),
        _div(F.sum(F.col("recall") * F.col("support")), n).alias("recall_weighted"),
        _div(F.sum(F.col("f1") * F.col("support")), n).alias("f1_weighted"),
    )


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per class, then 'accuracy' (f1 = accuracy, support = N), 'macro avg' and
    'weighted avg'. Columns: row, precision, recall, f1, support."""
    return report_of(confusion_cells(pred, label, prediction))


def report_of(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``classification_report`` from confusion cells, one report per combination of ``by``.

    Every class row enters four groups - its own and the three averages - and one aggregation sums them.
    The averages are combined in each task before the shuffle, so no task ever holds all classes."""
    by = by or []
    parts = ("precision", "recall", "f1")
    support = F.col("support")

    def entry(kind, row, *values):
        return F.struct(F.lit(kind).alias("__kind"), row.alias("row"), support.alias("support"), F.col("tp").alias("tp"),
                        *[v.alias(c) for c, v in zip(parts, values)])

    own = [F.col(c) for c in parts]
    groups = F.array(entry("class", F.col("class").cast("string"), *own), entry("accuracy", F.lit("accuracy"), *own),
                     entry("macro", F.lit("macro avg"), *own), entry("weighted", F.lit("weighted avg"), *[c * support for c in own]))
    sums = (classes_of(cells, by).select(*by, F.inline(groups)).groupBy(*by, "__kind", "row")
            .agg(*[F.sum(c).alias(c) for c in (*parts, "support", "tp")], F.count(F.lit(1)).alias("k")))
    kind = F.col("__kind")

    def value(c):
        hits = _div(F.col("tp"), support) if c == "f1" else F.lit(None).cast("double")
        return F.when(kind == "class", F.col(c)).when(kind == "macro", _div(F.col(c), F.col("k"))) \
            .when(kind == "weighted", _div(F.col(c), support)).otherwise(hits).alias(c)

    return sums.select(*by, "row", *[value(c) for c in parts], support.cast("double").alias("support"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every (true class, predicted class) cell over the classes seen, zeros included."""
    cells = confusion_cells(pred, label, prediction)
    # The cells seen (at most K^2) are gathered into one row: the classes, exploded twice, and a map from
    # the pair to its count. The input is read once and nothing is joined.
    one = cells.agg(F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("prediction"))).alias("k"),
                    F.map_from_entries(F.collect_list(F.struct(F.struct("label", "prediction").alias("pair"), "n"))).alias("m"))
    grid = one.select(F.explode("k").alias("label"), "k", "m").select("label", F.explode("k").alias("prediction"), "m")
    return grid.select("label", "prediction", F.coalesce(F.try_element_at("m", F.struct("label", "prediction")), F.lit(0)).cast("long").alias("n"))


# ------------------------------------ multi-label ---------------------------------------------

_SUMS = ("tp", "fp", "fn", "rows", "precision", "recall", "f1", "n_true", "exact")


#: Label rows are spread over this many groups, each of which gets the number of rows.
SPREAD = 256


def _label_sums(pred: DataFrame, classes: DataFrame, truth: str, predicted: str) -> DataFrame:
    """A row per label of ``classes`` with tp, fp, fn, and one without a label with the sums over input rows (rows,
    precision, recall, f1, n_true, exact); that one is absent if there are no rows.

    Each input row gives one entry per label of its lists and one without a label that carries the row's own
    sums; the classes join in as entries of zeros. One aggregation by label, over one read of the input; labels stay rows, however many."""
    empty = F.array().cast("array<string>")
    zero_type = {c: "double" if c in ("precision", "recall", "f1") else "long" for c in _SUMS}
    zero = {c: F.lit(0).cast(kind) for c, kind in zero_type.items()}

    def entry(label, given, known):
        return F.struct(label.alias("label"), F.lit(known).alias("known"), *[given.get(c, zero[c]).cast(zero_type[c]).alias(c) for c in _SUMS])

    t, p = F.col("__t"), F.col("__p")
    both = F.size(F.array_intersect(t, p))
    own = entry(F.lit(None).cast("string"), {
        "rows": F.lit(1), "precision": _div(both, F.size(p)), "recall": _div(both, F.size(t)), "f1": _div(2 * both, F.size(t) + F.size(p)),
        "n_true": F.size(t), "exact": (F.size(t) == F.size(p)) & (both == F.size(t))}, True)

    def one(label):
        in_t, in_p = F.array_contains(t, label), F.array_contains(p, label)
        return entry(label, {"tp": in_t & in_p, "fp": ~in_t & in_p, "fn": in_t & ~in_p}, False)

    base = pred.select(F.array_distinct(F.coalesce(F.col(truth), empty)).alias("__t"), F.array_distinct(F.coalesce(F.col(predicted), empty)).alias("__p"))
    # A missing label inside a list is no label; the entry without one is the row's own.
    named = F.filter(F.array_union(t, p), lambda x: x.isNotNull())
    entries = base.select(F.inline(F.concat(F.transform(named, one), F.array(own))))
    listed = classes.select(F.inline(F.array(entry(F.col("label"), {}, True))))
    return entries.unionByName(listed).groupBy("label").agg(F.max("known").alias("known"), *[F.sum(c).alias(c) for c in _SUMS]).filter("known")


def label_counts(pred: DataFrame, classes: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Per label TP, FP, FN, TN (TN = rows - TP - FP - FN), every class of ``classes``."""
    sums = _label_sums(pred, classes, truth, predicted)
    own = F.col("label").isNull()
    groups = F.when(own, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.pmod(F.hash("label"), F.lit(SPREAD))))
    met = sums.withColumn("group", F.explode(groups)).withColumn("all", F.max("rows").over(Window.partitionBy("group")))
    return met.filter(~own).select("label", "tp", "fp", "fn", (F.col("all") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


_PARTS = ("precision", "recall", "f1")


def _scores() -> dict[str, Column]:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return {"precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn), "f1": _div(2 * tp, 2 * tp + fp + fn)}


def multilabel_report(pred: DataFrame, classes: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Per label precision/recall/F1/support, then micro, macro, weighted and samples avg.

    Every label's row enters four groups, its own and three averages, and the row of sums the fourth average; one more
    aggregation adds them up, combined in each task first."""
    sums = _label_sums(pred, classes, truth, predicted)
    is_label = F.col("label").isNotNull()
    support = F.col("tp") + F.col("fn")
    own = _scores()

    def entry(kind, row, values, weight, size):
        return F.struct(F.lit(kind).alias("kind"), row.alias("row"), *[v.alias(c) for c, v in values.items()], weight.cast("double").alias("weight"), size.cast("long").alias("support"),
                        F.col("tp"), F.col("fp"), F.col("fn"))

    one = F.lit(1.0)
    labels = F.array(entry("label", F.col("label"), own, one, support), entry("micro", F.lit("micro avg"), own, one, support),
                     entry("macro", F.lit("macro avg"), own, one, support),
                     entry("weighted", F.lit("weighted avg"), {c: v * support for c, v in own.items()}, support, support))
    rows = F.array(entry("samples", F.lit("samples avg"), {c: F.col(c) for c in _PARTS}, F.col("rows"), F.col("n_true")))
    added = (sums.select(F.inline(F.when(is_label, labels).otherwise(rows))).groupBy("kind", "row")
             .agg(*[F.sum(c).alias(c) for c in (*_PARTS, "weight", "support", "tp", "fp", "fn")]))
    micro = F.col("kind") == "micro"
    return added.select("row", *[F.when(micro, v).otherwise(_div(F.col(c), F.col("weight"))).alias(c) for c, v in _scores().items()], F.col("support").cast("double").alias("support"))


def _overall(sums: DataFrame, wide: list[str]) -> DataFrame:
    """One row: the sums over labels and rows, and the F1 of each class in ``wide``."""
    scores = _scores()
    is_label = F.col("label").isNotNull()
    named = [F.max(F.when(F.col("label") == c, scores["f1"])).alias(f"f1_{c}") for c in wide]
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "rows", "exact")],
                    F.coalesce(F.avg(F.when(is_label, scores["f1"])), F.lit(0.0)).alias("f1_macro"), *named)


def multilabel_metrics(pred: DataFrame, classes: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Exact-match accuracy, micro precision / recall / F1, macro F1 (one row)."""
    one = _overall(_label_sums(pred, classes, truth, predicted), [])
    micro = _scores()
    return one.select(_div(F.col("exact"), F.col("rows")).alias("subset_accuracy"), *[micro[c].alias(f"{c}_micro") for c in _PARTS], "f1_macro")


def multilabel_wide(pred: DataFrame, classes: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """D14/B5 in wide form: the metrics of ``multilabel_metrics`` and one F1 column per class, classes sorted (one row)."""
    wide = sorted(classes)
    one = _overall(_label_sums(pred, pred.sparkSession.createDataFrame([(c,) for c in wide], "label string"), truth, predicted), wide)
    return one.select(_div(F.col("exact"), F.col("rows")).alias("subset_accuracy"), _scores()["f1"].alias("f1_micro"), "f1_macro", *[f"f1_{c}" for c in wide])


# ------------------------------------ tuning ---------------------------------------------------

def tuning_rank(scores: DataFrame, top: int = 4, group: str = "model", config: str = "params",
                score: str = "score") -> DataFrame:
    """Mean fold score per configuration, rank with ties sharing the smallest rank
    (highest mean first), and the first ``top`` configurations per group."""
    means = scores.groupBy(group, config).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n_folds"))
    w = Window.partitionBy(group).orderBy(F.col("mean_score").desc())
    ranked = means.withColumn("rank", F.rank().over(w))
    w2 = Window.partitionBy(group).orderBy("rank", config)
    return ranked.withColumn("pos", F.row_number().over(w2)).filter(F.col("pos") <= top).drop("pos")


def tag_union(frames: dict[str, DataFrame], tag: str = "Class") -> DataFrame:
    """Union of same-shaped frames with a tag column naming their source."""
    out = None
    for name, df in frames.items():
        t = df.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out
