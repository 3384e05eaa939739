"""Model operators on Spark ML.

Spark trees reject NaN/infinite feature values, while the reference's boosters accept them, so
the feature stage clips to [-1e15, 1e15] (H10), imputes means fitted on the training part only
and adds a 0/1 missing indicator per feature that has gaps. ``GBTClassifier`` is binary-only,
so the multiclass booster is ``OneVsRest(GBTClassifier)``; random forest and logistic
regression are the other two families. Fits are distributed, and several run at once.

A search encodes the labels once, for the whole training part, so every fold knows every class, also
one that its rows lack. What a fit predicts is written to a ledger: confusion counts in a folder of
its own under the shared checkpoint folder. Scores, ranks and reports are read from there, and a search that
is started again with the same ledger only does the fits that are missing.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.operators.clean import clip
from hazardframe.operators.metrics import confusion_cells, report_of, tuning_rank, weighted_of
from hazardframe.session import scratch_path

SEED = 42
#: Fits that run at the same time; each is a distributed job of its own.
PARALLEL_FITS = 4

_PARAMS = {"booster": {"maxIter": 10, "maxDepth": 3, "stepSize": 0.1}, "forest": {"numTrees": 20, "maxDepth": 5},
           "linear": {"maxIter": 50, "regParam": 0.0}}


def family(name: str, label: str = "label_idx", features: str = "features", **params):
    """The three model families of the comparison, with any of the settings in ``_PARAMS``."""
    if name not in _PARAMS:
        raise ValueError(f"no model family {name}")
    if unknown := set(params) - set(_PARAMS[name]):
        raise ValueError(f"family {name} has no setting {sorted(unknown)}")
    base = {"booster": GBTClassifier, "forest": RandomForestClassifier, "linear": LogisticRegression}[name]
    given = _PARAMS[name] | params | ({} if name == "linear" else {"seed": SEED})
    est = base(labelCol=label, featuresCol=features, **given)
    return OneVsRest(classifier=est, labelCol=label, featuresCol=features, parallelism=4) if name == "booster" else est


def feature_frame(df: DataFrame, feature_cols: list[str] | None = None, array_col: str | None = None) -> tuple[DataFrame, list[str]]:
    """M3: numeric columns (or one array column, all of one width) -> clipped DOUBLE columns ready
    for assembly, and their names. Vectors of different widths are an error, never cut."""
    if array_col is not None:
        width = df.agg(F.min(F.size(array_col)).alias("least"), F.max(F.size(array_col)).alias("most")).first()
        if width["least"] != width["most"]:
            raise ValueError(f"column {array_col} holds vectors of {width['least']} to {width['most']} values")
        n = width["least"] or 0
        cols = [clip(F.col(array_col)[i].cast("double")).alias(f"f{i}") for i in range(n)]
        return df.select(*[c for c in df.columns if c != array_col], *cols), [f"f{i}" for i in range(n)]
    return df.select(*[clip(F.col(c).cast("double")).alias(c) if c in feature_cols else F.col(c)
                       for c in df.columns]), list(feature_cols)


def label_index(df: DataFrame, label_col: str = "label") -> StringIndexerModel:
    """M1: alphabetical codes of all classes in ``df``; a label that it lacks is an error later, never an extra class."""
    return StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="error").fit(df)


def preparation(feature_cols: list[str], index: StringIndexer | StringIndexerModel, with_gaps: list[str] | None = None) -> list:
    """M3: label codes, means for gaps, feature vector."""
    gaps = with_gaps or []
    stages = [index]
    if gaps:
        stages.append(Imputer(inputCols=gaps, outputCols=[f"{c}__imp" for c in gaps], strategy="mean"))
    assembled = [f"{c}__imp" if c in gaps else c for c in feature_cols] + [f"{c}__missing" for c in gaps]
    return [*stages, VectorAssembler(inputCols=assembled, outputCol="features", handleInvalid="keep")]


def pipeline(feature_cols: list[str], model, label_col: str = "label", with_gaps: list[str] | None = None) -> Pipeline:
    """M1 + M3 + imputation + model + label decoding, as one savable unit."""
    index = StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="error")
    return Pipeline(stages=[*preparation(feature_cols, index, with_gaps), model])


def gap_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Feature columns with a missing value (NULL or NaN), from one aggregate."""
    row = df.agg(*[F.max(_missing(c).cast("int")).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"g{i}"]]


def _missing(c: str):
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def add_missing_indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    """A 0/1 column per feature that has gaps; its NaN become NULL, which the imputer fills."""
    return df.select(*[F.when(~_missing(c), F.col(c).cast("double")).alias(c) if c in cols else F.col(c) for c in df.columns],
                     *[_missing(c).cast("double").alias(f"{c}__missing") for c in cols])


def decode(pred: DataFrame, model: PipelineModel, label_col: str = "label") -> DataFrame:
    """Prediction index -> class name with the labels stored in the fitted indexer."""
    labels = model.stages[0].labels
    return IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels).transform(pred)


def train_and_predict(train: DataFrame, test: DataFrame, feature_cols: list[str], model_name: str = "booster",
                      label_col: str = "label", **params) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training part, predict the held-out part (decoded labels). Features with gaps in
    the training part get its mean and a missing indicator; a gap in any other feature of the held-out
    part is filled with that feature's training mean as well."""
    gaps = gap_columns(train.unionByName(test, allowMissingColumns=True), feature_cols)
    train, test = add_missing_indicators(train, gaps), add_missing_indicators(test, gaps)
    p = pipeline(feature_cols, family(model_name, **params), label_col, gaps)
    m = p.fit(train)
    return m, decode(m.transform(test), m, label_col)


def train_multilabel(train: DataFrame, test: DataFrame, feature_cols: list[str], labels_col: str,
                     classes: list[str], id_col: str, **params) -> DataFrame:
    """M7: one binary booster per class; (id, truth, predicted).

    The feature vectors are assembled once and stored in the shared folder, where every fit reads them;
    ``PARALLEL_FITS`` of them run at once."""
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    tr = _stored(asm.transform(train).select(labels_col, "features"), "multilabel")
    out = asm.transform(test).select(id_col, F.col(labels_col).alias("truth"), "features")

    def fit(i: int):
        gbt = GBTClassifier(labelCol="y", featuresCol="features", seed=SEED, maxIter=params.get("maxIter", 10),
                            maxDepth=params.get("maxDepth", 3), predictionCol=f"p{i}")
        return gbt.fit(tr.select("features", F.array_contains(labels_col, classes[i]).cast("double").alias("y")))

    for m in at_once(train.sparkSession, fit, range(len(classes))):
        out = m.transform(out).drop("rawPrediction", "probability")
    pred = F.filter(F.array(*[F.when(F.col(f"p{i}") == 1.0, F.lit(c)) for i, c in enumerate(classes)]),
                    lambda x: x.isNotNull())
    return out.select(id_col, "truth", pred.alias("predicted"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def at_once(spark: SparkSession, work: Callable, items, parallel: int | None = None) -> list:
    """``work`` on every item, ``parallel`` at a time, results in the order of the items. Threads only start
    Spark jobs; the first error is raised."""
    items = list(items)
    if not items:
        return []
    pool = ThreadPool(min(parallel or PARALLEL_FITS, len(items)))
    try:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)
    finally:
        pool.terminate()


def sample_settings(grid: dict[str, list], n_iter: int, seed: int = SEED) -> list[dict]:
    """M9: ``n_iter`` distinct settings drawn without replacement from the full grid."""
    keys = sorted(grid)
    full = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    rnd = random.Random(seed)
    return full if n_iter >= len(full) else rnd.sample(full, n_iter)


def setting_name(setting: dict) -> str:
    return ", ".join(f"{k}={setting[k]}" for k in sorted(setting))


class FitLedger:
    """Confusion counts of every finished fit, one folder per fit, under a path that all executors and a
    later driver can read. A fit is finished when its folder holds the marker that Spark writes last; a broken
    attempt is overwritten. One ledger belongs to one split of one table and one label index: ``stamp`` names them and
    is part of every folder name, so a ledger of other data is never read by mistake."""

    SCHEMA = "model string, params string, fold int, label string, prediction string, n long"

    def __init__(self, spark: SparkSession, path: str | None = None, stamp: str = ""):
        self.spark, self.path, self.stamp = spark, path or scratch_path(spark, "fits"), stamp

    def folder(self, model: str, setting: dict, fold: int | None) -> str:
        named = json.dumps([self.stamp, model, setting, fold], sort_keys=True)
        return f"{self.path}/{hashlib.sha256(named.encode()).hexdigest()[:32]}"

    def has(self, model: str, setting: dict, fold: int | None) -> bool:
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(model, setting, fold) + "/_SUCCESS")
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker)

    def add(self, model: str, setting: dict, fold: int | None, cells: DataFrame) -> None:
        tags = [F.lit(model).alias("model"), F.lit(setting_name(setting)).alias("params"), F.lit(fold).cast("int").alias("fold")]
        cells = cells.select(*tags, F.col("label").cast("string").alias("label"), F.col("prediction").cast("string").alias("prediction"), "n")
        cells.coalesce(1).write.mode("overwrite").parquet(self.folder(model, setting, fold))

    def cells(self, fits: list[tuple]) -> DataFrame:
        """The counts of the given (model, setting, fold) fits, read with the scan's usual parallelism."""
        return self.spark.read.schema(self.SCHEMA).parquet(*[self.folder(*f) for f in fits])


def _fit_all(train: DataFrame, held: DataFrame, feature_cols: list[str], index: StringIndexerModel, wanted: list[tuple],
             ledger: FitLedger, parallel: int | None, label_col: str) -> None:
    """Fit each wanted (model, setting, fold) on ``train``, predict ``held``, write the counts to the ledger. The
    preparation is fitted on ``train`` once for all of them."""
    gaps = gap_columns(train.unionByName(held, allowMissingColumns=True), feature_cols)
    train, held = add_missing_indicators(train, gaps), add_missing_indicators(held, gaps)
    prepared = Pipeline(stages=preparation(feature_cols, index, gaps)).fit(train)
    train = prepared.transform(train).select("label_idx", "features")
    held = prepared.transform(held).select(label_col, "features")

    def fit(key: tuple) -> None:
        model, setting, fold = key
        pred = family(model, **setting).fit(train).transform(held)
        named = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=index.labels).transform(pred)
        ledger.add(model, setting, fold, confusion_cells(named, label_col, "predicted_label"))

    at_once(train.sparkSession, fit, wanted, parallel)


def cross_validate(df: DataFrame, feature_cols: list[str], model_name: str | list[str], settings: list[dict] | dict[str, list[dict]],
                   fold_col: str = "fold", label_col: str = "label", folds: int | None = None,
                   ledger: FitLedger | None = None, parallel: int | None = None) -> DataFrame:
    """M9: k-fold search with a given fold column, for one family (settings: a list) or several (settings: a list per
    family); one row per (setting, fold): model, params, fold, score (support-weighted F1) and n_rows of the held-out
    fold - the input of ``metrics.tuning_rank`` (M10). A fold without rows has score and n_rows 0.

    Labels are encoded once over all of ``df``; a class that a training fold lacks stays a class of its models."""
    names = [model_name] if isinstance(model_name, str) else list(model_name)
    given = settings if isinstance(settings, dict) else {n: settings for n in names}
    folds = folds if folds is not None else df.agg(F.max(fold_col)).first()[0] + 1
    index = label_index(df, label_col)
    ledger = ledger or FitLedger(df.sparkSession)
    fits = [(n, s, f) for f in range(folds) for n in names for s in given[n]]
    for f in range(folds):
        wanted = [k for k in fits if k[2] == f and not ledger.has(*k)]
        if wanted:
            _fit_all(df.filter(F.col(fold_col) != f), df.filter(F.col(fold_col) == f), feature_cols, index, wanted, ledger, parallel, label_col)
    cells = ledger.cells(fits)
    key = ["model", "params", "fold"]
    scored = weighted_of(cells, key).select(*key, F.col("f1_weighted").alias("score"))
    rows = cells.groupBy(*key).agg(F.sum("n").alias("n_rows"))
    listed = df.sparkSession.createDataFrame([(n, setting_name(s), f) for n, s, f in fits], "model string, params string, fold int")
    return (listed.join(scored, key, "left").join(rows, key, "left")
            .select(*key, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows")))


def refit_best(train: DataFrame, test: DataFrame, feature_cols: list[str], ranked: DataFrame, settings: list[dict] | dict[str, list[dict]],
               model_name: str | list[str], label_col: str = "label", ledger: FitLedger | None = None,
               parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit the ranked settings of each family and its defaults on the whole training part and score the held-out
    part. Two tables from the stored counts:

    grouped   kind ('Default' or 'Tuned'), params, model, position (0 for the defaults, then 1 for the best setting, ...),
              rank and mean_score of the search, and the weighted metrics; ordered by position, then by family as listed
    reports   kind, model, position, and the rows of the per-class report of every fit

    ``ranked`` is ``metrics.tuning_rank`` of the search (a few rows per family)."""
    spark = train.sparkSession
    names = [model_name] if isinstance(model_name, str) else list(model_name)
    given = settings if isinstance(settings, dict) else {n: settings for n in names}
    ledger = ledger or FitLedger(spark)
    known = {(n, setting_name(s)): s for n in names for s in given[n]}
    best = ranked.withColumn("position", F.row_number().over(Window.partitionBy("model").orderBy("rank", "params"))).collect()
    index = label_index(train, label_col)
    # Fold -1 stands for the defaults' fit, no fold for a tuned one: a tuned setting may equal the defaults.
    chosen = [("Tuned", r["model"], r["params"], r["position"], r["rank"], r["mean_score"], names.index(r["model"])) for r in best if r["model"] in names]
    chosen += [("Default", n, "", 0, None, None, i) for i, n in enumerate(names)]
    fits = [(m, known[m, p] if kind == "Tuned" else {}, -1 if kind == "Default" else None) for kind, m, p, *_ in chosen]
    wanted = [k for k in fits if not ledger.has(*k)]
    if wanted:
        _fit_all(train, test, feature_cols, index, wanted, ledger, parallel, label_col)
    listed = spark.createDataFrame(chosen, "kind string, model string, params string, position int, rank int, mean_score double, family int")
    cells = ledger.cells(fits).withColumn("kind", F.when(F.col("fold") == -1, "Default").otherwise("Tuned")).drop("fold")
    key = ["kind", "model", "params"]
    grouped = listed.join(weighted_of(cells, key), key, "left").orderBy("position", "family", "params")
    metrics = [c for c in grouped.columns if c not in {*key, "position", "rank", "mean_score", "family"}]
    reports = listed.select(*key, "position").join(report_of(cells, key), key)
    return (grouped.select("kind", "params", "model", "position", "rank", "mean_score", *metrics),
            reports.select("kind", "model", "position", "row", "precision", "recall", "f1", "support"))


def tune(train: DataFrame, test: DataFrame, feature_cols: list[str], settings: dict[str, list[dict]], folds: int, top: int = 4,
         fold_col: str = "fold", label_col: str = "label", ledger: FitLedger | None = None,
         parallel: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M9 and M10 together: search over all families of ``settings``, refit of the best ``top`` and the defaults. Returns
    the fold scores, the grouped table and the per-class reports. With the ledger of an earlier, broken run it goes on from there."""
    ledger = ledger or FitLedger(train.sparkSession)
    scores = cross_validate(train, feature_cols, list(settings), settings, fold_col, label_col, folds, ledger, parallel)
    grouped, reports = refit_best(train, test, feature_cols, tuning_rank(scores, top=top), settings, list(settings), label_col, ledger, parallel)
    return scores, grouped, reports


def save_model(model: PipelineModel, path: str) -> str:
    """Model + label encoder + feature names in one directory (the pipeline)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
