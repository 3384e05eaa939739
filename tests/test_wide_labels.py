"""Label operators with many classes: sorted places, codes, sparse vectors and reports without a task that holds all labels."""

import random

from pyspark.sql import functions as F

from hazardframe.operators import labels as LB
from hazardframe.operators import metrics as M


def test_places_are_those_of_the_sorted_list(spark):
    rnd = random.Random(1)
    values = [f"{rnd.choice('äaZ9é日 ')}{rnd.randrange(5000)}" for _ in range(4000)] + ["", "x" * 300]
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "label string").repartition(7)
    got = {r.label: r.label_idx for r in LB.label_index(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values), key=lambda v: v.encode()))}
    assert LB.label_index(df.limit(0)).count() == 0


def test_a_million_labels_pass_no_single_task(spark):
    n = 1_000_000
    df = spark.range(n).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("label"))
    out = LB.label_index(df)
    right = out.filter(F.col("label_idx") != F.substring("label", 2, 7).cast("long"))
    assert out.count() == n and right.isEmpty()


def test_codes_of_rows(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "c")], "id long, label string")
    assert {r.id: r.label_idx for r in LB.encode_labels(df).collect()} == {1: 1, 2: 0, 3: 1, 4: None, 5: 2}


def test_sparse_vectors_equal_dense_ones(spark):
    rnd = random.Random(2)
    names = [f"n{i:02d}" for i in range(30)]
    rows = [(i, rnd.sample(names, rnd.randrange(6)) + (["n01", "n01"] if i % 9 == 0 else [])) for i in range(80)] + [(900, None), (901, ["other"])]
    df = spark.createDataFrame(rows, "id long, labels array<string>")
    classes = spark.createDataFrame([(v, i) for i, v in enumerate(names)], "label string, label_idx long")
    dense = {r.id: r.hot for r in df.select("id", LB.multi_hot(F.coalesce("labels", F.array().cast("array<string>")), names).alias("hot")).collect()}
    got = LB.sparse_hot(df, "labels", classes, "id").collect()
    assert len(got) == len(rows) and all(r.width == 30 and [int(i in r.ones) for i in range(30)] == dense[r.id] for r in got)
    assert {r.width for r in LB.sparse_hot(df, "labels", classes.limit(0), "id").collect()} == {0}


def _plain_report(rows, classes):
    """Label by label, in Python."""
    def div(a, b):
        return a / b if b else 0.0

    rows = [(set(t or []) - {None}, set(p or []) - {None}) for t, p in rows]
    counts = {c: (sum(c in t and c in p for t, p in rows), sum(c in p and c not in t for t, p in rows), sum(c in t and c not in p for t, p in rows)) for c in classes}
    per = {c: (div(a, a + b), div(a, a + e), div(2 * a, 2 * a + b + e), a + e) for c, (a, b, e) in counts.items()}
    a, b, e = (sum(c[k] for c in counts.values()) for k in range(3))
    support = sum(x[3] for x in per.values())
    out = dict(per)
    out["micro avg"] = (div(a, a + b), div(a, a + e), div(2 * a, 2 * a + b + e), support)
    out["macro avg"] = (*[div(sum(x[k] for x in per.values()), len(per)) for k in range(3)], support)
    out["weighted avg"] = (*[div(sum(x[k] * x[3] for x in per.values()), support) for k in range(3)], support)
    n = len(rows)
    out["samples avg"] = (*[sum(f(t, p) for t, p in rows) / n for f in (lambda t, p: div(len(t & p), len(p)), lambda t, p: div(len(t & p), len(t)), lambda t, p: div(2 * len(t & p), len(t) + len(p)))],
                          sum(len(t) for t, _ in rows))
    return out, counts, sum(t == p for t, p in rows) / n


def test_reports_equal_plain_ones_and_gather_no_labels(spark):
    rnd = random.Random(3)
    classes = [f"c{i}" for i in range(12)] + ["never"]
    rows = [(rnd.sample(classes[:12], rnd.randrange(4)) or None, rnd.sample(classes[:12], rnd.randrange(4))) for _ in range(300)] + [(["c1", "c1"], ["c1"]), (["c1", "beyond"], ["c2"])]
    df = spark.createDataFrame(rows, "truth array<string>, predicted array<string>").repartition(5)
    listed = spark.createDataFrame([(c,) for c in classes], "label string")
    want, counts, exact = _plain_report([([x for x in t or [] if x != "beyond"], p) for t, p in rows[:-1]] + [(["c1", "beyond"], ["c2"])], classes)
    report = {r.row: (r.precision, r.recall, r.f1, r.support) for r in M.multilabel_report(df, listed).collect()}
    assert set(report) == set(want)
    for k, v in want.items():
        assert all(abs(x - y) < 1e-9 for x, y in zip(report[k], v)), (k, report[k], v)
    got = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in M.label_counts(df, listed).collect()}
    assert got == {c: (*x, len(rows) - sum(x)) for c, x in counts.items()}
    one = M.multilabel_metrics(df, listed).first()
    assert abs(one.subset_accuracy - exact) < 1e-12 and abs(one.f1_macro - want["macro avg"][2]) < 1e-9 and abs(one.f1_micro - want["micro avg"][2]) < 1e-9
    wide = M.multilabel_wide(df, classes).first()
    assert abs(wide.f1_c3 - want["c3"][2]) < 1e-9 and wide.f1_never == 0.0
    for out in (M.multilabel_report(df, listed), M.label_counts(df, listed), M.classification_report(df.select(F.lit("a").alias("label"), F.lit("b").alias("prediction")))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "collect_set" not in plan
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
