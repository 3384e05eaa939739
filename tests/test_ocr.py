"""Golden tests: recompute the published CER/WER rows and the engine summaries."""

import csv

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from hazardframe.functions.text import cer, wer, round_ratio
from hazardframe.operators import ocr


def _read(spark, name):
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .csv(str(FIXTURES / "ocr" / name)))


@pytest.mark.parametrize("suffix", ["", "_kaggle"])
def test_cer_wer_equal_published(spark, suffix):
    pairs = _read(spark, f"text_comparison{suffix}.csv").withColumn(
        "predicted_text", F.coalesce("predicted_text", F.lit("")))
    got = pairs.select("image_id", "engine", cer("predicted_text", "actual_text").alias("cer"),
                       wer("predicted_text", "actual_text").alias("wer"))
    got = {(r.image_id, r.engine): (r.cer, r.wer) for r in got.collect()}
    with open(FIXTURES / "ocr" / f"performance_comparison{suffix}.csv") as f:
        exp = {(r["image_id"], r["engine"]): (float(r["cer"]), float(r["wer"])) for r in csv.DictReader(f)}
    assert len(got) == len(exp) > 0
    for k, (c, w) in exp.items():
        assert got[k][0] == pytest.approx(c, abs=1e-9), (k, got[k], c)
        assert got[k][1] == pytest.approx(w, abs=1e-9), (k, got[k], w)


@pytest.mark.parametrize("suffix", ["", "_kaggle"])
def test_summary_equal_published(spark, suffix):
    perf = _read(spark, f"performance_comparison{suffix}.csv").select(
        "image_id", "engine", *[F.col(c).cast("double").alias(c) for c in ("cer", "wer", "time")])
    got = {r.engine: (r.avg_cer, r.avg_wer, r.avg_time) for r in ocr.summarize(perf).collect()}
    with open(FIXTURES / "ocr" / f"summary{suffix}.csv") as f:
        for r in csv.DictReader(f):
            assert got[r["engine"]] == pytest.approx(
                (float(r["avg_cer"]), float(r["avg_wer"]), float(r["avg_time"])), abs=1e-9)


def test_round_ratio_matches_python(spark):
    cases = [(n, m) for m in (1, 3, 7, 32, 160, 800, 4000, 20000, 333) for n in range(0, 3 * m + 1, max(1, m // 50))]
    cases += [(1, 160), (3, 160), (1, 32), (5, 32), (1, 800), (7, 4000), (1, 20000)]
    df = spark.createDataFrame(cases, "n long, m long")
    got = df.select("n", "m", round_ratio("n", "m", 4).alias("r")).collect()
    for r in got:
        assert r.r == round(r.n / r.m, 4), (r.n, r.m, r.r, round(r.n / r.m, 4))


def test_edge_rules(spark):
    rows = [("", "abc"), ("abc", ""), (None, "abc"), ("   ", "   "), ("abc", None), ("a b", "a b"),
            ("Hello\tWorld", "hello world"), ("x", "abc abd")]
    df = spark.createDataFrame(rows, "p string, t string")
    got = [(r.c, r.w) for r in df.select(cer("p", "t").alias("c"), wer("p", "t").alias("w")).collect()]
    assert got[0] == (1.0, 1.0)          # empty prediction
    assert got[1] == (1.0, 1.0)          # empty truth
    assert got[2] == (1.0, 1.0)          # missing prediction
    assert got[3] == (0.0, 0.0)          # both empty after normalising
    assert got[4] == (1.0, 1.0)          # missing truth
    assert got[5] == (0.0, 0.0)
    assert got[6] == (0.0, 0.0)
    assert got[7][1] == 1.0


def test_failed_engine_and_missing_truth(spark):
    truth = spark.createDataFrame([("001", "water, salt"), ("002", "")], "image_id string, text string")
    runs = spark.createDataFrame([("001", "paddleocr", "water salt", 0.5), ("002", "doctr", "x", 1.0)],
                                 "image_id string, engine string, text string, time double")
    m, p = ocr.evaluate_runs(runs, truth)
    m = {(r.image_id, r.engine): (r.cer, r.wer, r.time) for r in m.collect()}
    assert m[("001", "doctr")] == (None, None, None)          # failed run
    assert m[("002", "doctr")] == (None, None, 1.0)           # empty truth
    assert m[("001", "paddleocr")][0] == round(1 / 11, 4)
    p = {(r.image_id, r.engine): r.predicted_text for r in p.collect()}
    assert p[("001", "tesseract")] == ""


def test_ground_truth_json(spark):
    gt = ocr.load_ground_truth(spark, str(FIXTURES / "ocr" / "ground_truth_ph.json"))
    rows = {r.image_id: r.text for r in gt.collect()}
    assert len(rows) == 22 and "001" in rows and "022" in rows
