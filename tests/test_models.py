"""Model operators: better than the majority class, gaps in features, per-fold scores, no extra class."""

import tempfile

from pyspark.sql import functions as F

from hazardframe.operators import metrics as M
from hazardframe.operators import ml as ML
from hazardframe.plans import catalog


def _frame(spark):
    rows = [(i, f"c{i % 3}", float(i % 3) + (i % 7) / 10 if i % 11 else None, float("nan") if i % 13 == 0 else float(i % 5)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label string, a double, b double")
    return df.filter("id % 4 > 0"), df.filter("id % 4 = 0")


def test_gaps_are_filled_and_classes_are_those_of_training(spark):
    train, test = _frame(spark)
    model, pred = ML.train_and_predict(train, test, ["a", "b"], "forest")
    assert model.stages[-1].numClasses == 3
    assert "a__missing" in pred.columns and "b__missing" in pred.columns
    acc = M.weighted_metrics(pred, "label", "predicted_label").first().accuracy
    assert pred.count() == test.count() and acc > 0.8


def test_search_gives_a_row_per_setting_and_fold_and_chains_to_the_refit(spark):
    """Fold and class coincide here: every training part lacks the class of its held-out part."""
    train, test = _frame(spark)
    train, test = train.fillna(0.0), test.fillna(0.0)
    train = train.withColumn("fold", (F.col("id") % 3).cast("int"))
    settings = ML.sample_settings({"regParam": [0.0, 0.1, 1.0]}, 3)
    scores = ML.cross_validate(train, ["a", "b"], "linear", settings)
    assert scores.count() == 9 and {r.fold for r in scores.collect()} == {0, 1, 2}
    assert {r.score for r in scores.collect()} == {0.0}  # none can name a class it never saw
    grouped, _ = ML.refit_best(train, test, ["a", "b"], M.tuning_rank(scores, top=2), settings, "linear")
    out = grouped.collect()
    assert [(r.kind, r.position) for r in out] == [("Default", 0), ("Tuned", 1), ("Tuned", 2)] and all(r.f1_weighted > 0.5 for r in out)


SETTINGS = {"booster": [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 1, "maxDepth": 1}], "forest": [{"numTrees": 3, "maxDepth": 2}],
            "linear": [{"regParam": 0.0, "maxIter": 5}]}


def test_every_family_is_searched_with_gaps_and_a_class_missing_from_a_fold(spark, monkeypatch):
    train, test = _frame(spark)
    # 'rare' has one row, which lies in fold 1: the training part of that fold lacks the class.
    rare = spark.createDataFrame([(1001, "rare", 9.0, 9.0)], train.schema)
    train = train.unionByName(rare).withColumn("fold", F.when(F.col("label") == "rare", 1).otherwise((F.col("id") / 3).cast("int") % 2).cast("int"))
    fitted = []
    family = ML.family
    monkeypatch.setattr(ML, "family", lambda name, **s: fitted.append((name, ML.setting_name(s))) or family(name, **s))
    ledger = ML.FitLedger(spark, stamp="t")
    scores, grouped, reports = ML.tune(train, test, ["a", "b"], SETTINGS, folds=2, top=4, ledger=ledger)
    rows = scores.collect()
    assert len(rows) == 8 and {r.model for r in rows} == set(SETTINGS)
    sizes = dict(train.groupBy("fold").count().collect())
    assert all(r.n_rows == sizes[r.fold] for r in rows)
    assert min(r.score for r in rows if r.model != "booster") > 0.25  # the majority class alone: 0.17
    out = grouped.collect()
    assert [(r.position, r.model) for r in out] == [(0, "booster"), (0, "forest"), (0, "linear"), (1, "booster"), (1, "forest"), (1, "linear"), (2, "booster")]
    per = reports.collect()
    for r in out:  # each report's accuracy row is the grouped row's accuracy, and its classes are those of truth or prediction
        mine = {x.row: x for x in per if (x.kind, x.model, x.position) == (r.kind, r.model, r.position)}
        assert abs(mine["accuracy"].f1 - r.accuracy) < 1e-12 and {"c0", "c1", "c2"} <= set(mine)
        assert mine["accuracy"].support == test.count()
    assert len(fitted) == 8 + 7

    # A second run with the same ledger finds every fit; with one fit lost it does that one again.
    again, regrouped, _ = ML.tune(train, test, ["a", "b"], SETTINGS, folds=2, top=4, ledger=ledger)
    assert sorted(again.collect()) == sorted(rows) and regrouped.collect() == out and len(fitted) == 15
    lost = spark._jvm.org.apache.hadoop.fs.Path(ledger.folder("forest", SETTINGS["forest"][0], 1) + "/_SUCCESS")
    lost.getFileSystem(spark._jsc.hadoopConfiguration()).delete(lost, False)
    assert sorted(ML.tune(train, test, ["a", "b"], SETTINGS, folds=2, ledger=ledger)[0].collect()) == sorted(rows)
    assert fitted[15:] == [("forest", "maxDepth=2, numTrees=3")]
    assert not ML.FitLedger(spark, ledger.path, stamp="other").has("forest", SETTINGS["forest"][0], 0)


def test_unknown_families_and_settings_are_errors():
    for name, setting in (("tree", {}), ("linear", {"maxDepth": 2}), ("booster", {"regParam": 0.1})):
        try:
            ML.family(name, **setting)
        except ValueError:
            continue
        raise AssertionError(name)


def test_one_failing_fit_is_raised(spark):
    def work(i):
        if i == 2:
            raise ValueError("two")
        return i

    assert ML.at_once(spark, lambda i: i * i, range(7), 3) == [i * i for i in range(7)] and ML.at_once(spark, work, []) == []
    try:
        ML.at_once(spark, work, range(4), 2)
    except ValueError as e:
        assert str(e) == "two"
    else:
        raise AssertionError


def test_families_are_compared_with_all_their_rounds(spark, monkeypatch):
    texts = {"en": "the ship will know how", "de": "über dem Haus küsst er", "es": "el niño sueña en español"}
    rows = [(i, f"{texts[lang]} {'z' * (i % 5)}", lang) for i, lang in enumerate(sorted(texts) * 12)]
    folder = tempfile.mkdtemp(prefix="hf-tables-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    fitted = {}
    fit = ML.train_and_predict

    def kept(train, test, cols, name, *given, **settings):
        fitted[name], pred = fit(train, test, cols, name, *given, **settings)
        return fitted[name], pred

    monkeypatch.setattr(ML, "train_and_predict", kept)
    got = catalog.QUERIES["model_compare"](spark, folder).collect()
    booster, forest, linear = (fitted[name].stages[-1] for name in ("booster", "forest", "linear"))
    assert {m.getNumTrees for m in booster.models} == {ML._PARAMS["booster"]["maxIter"]} and {m.getMaxDepth() for m in booster.models} == {3}
    assert forest.getNumTrees == 20 and forest.getMaxDepth() == 5 and linear.getMaxIter() == 50
    assert sorted(map(tuple, got)) == sorted((m, r, n, True) for m in fitted for r, n in [("de", 3.0), ("en", 3.0), ("es", 3.0), ("accuracy", 9.0), ("macro avg", 9.0), ("weighted avg", 9.0)])
