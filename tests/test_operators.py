"""Property and fixture tests of the operators (similarity join, splits, metrics, JSON pick)."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hazardframe.functions.text import jaro_winkler
from hazardframe.functions.udfs import jaro_winkler_py, jaro_winkler_udf
from hazardframe.operators import jsonpick as JP
from hazardframe.operators import metrics as M
from hazardframe.operators import similarity as S
from hazardframe.operators import splits as SP


def _rand_words(n, seed):
    rnd = random.Random(seed)
    letters = "abcdeilmnorst "
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_jaro_winkler_known_values_and_properties(spark):
    known = [("martha", "marhta", 0.9611111111111111), ("dwayne", "duane", 0.8400000000000001),
             ("dixon", "dicksonx", 0.8133333333333332), ("", "", 0.0), ("a", "", 0.0), ("abc", "abc", 1.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in known], "a string, b string")
    got = [r.s for r in df.select(jaro_winkler("a", "b").alias("s")).collect()]
    assert got == [s for _, _, s in known]
    words = _rand_words(300, 1)
    pairs = [(words[i], words[(i * 7 + 3) % 300]) for i in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", jaro_winkler("a", "b").alias("n"), jaro_winkler_udf("a", "b").alias("u"),
                     jaro_winkler("b", "a").alias("r")).collect()
    for r in rows:
        assert r.n == r.u == jaro_winkler_py(r.a, r.b)     # Column == Arrow helper == plain Python
        assert 0.0 <= r.n <= 1.0
        assert r.n == pytest.approx(r.r, abs=1e-12)      # symmetric


def test_blocked_join_equals_brute_force(spark):
    names = list({w.strip() for w in _rand_words(400, 2) if w.strip()})
    queries = [w[:i] + w[i + 1:i + 2] + w[i:i + 1] + w[i + 2:] if len(w) > 2 else w
               for i, w in enumerate(names[:150])] + ["zzzz", ""]
    nd = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "CID long, Synonyms string")
    qd = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "qid long, name string")
    for scorer in ("arrow", "native"):
        got = {(r.qid, r.lname) for r in S.similarity_pairs(qd, nd, threshold=0.9, scorer=scorer).collect()}
        want = {(i, n.lower()) for i, q in enumerate(queries) for n in names
                if jaro_winkler_py(n.lower(), q.lower()) > 0.9}
        assert got == want
    top = {r.qid: (r.CID, r.score) for r in S.best_match(qd, nd, threshold=0.9).collect()}
    for i, q in enumerate(queries):
        cands = sorted((-jaro_winkler_py(n.lower(), q.lower()), cid) for cid, n in enumerate(names))
        best = cands[0] if cands and -cands[0][0] > 0.9 else None
        assert (top[i][0], top[i][1]) == ((best[1], -best[0]) if best else (None, None))


def test_bounds_are_lossless():
    assert [round(S.jaro_floor(0.9, p), 4) for p in range(5)] == [0.9, 0.8889, 0.875, 0.8571, 0.8333]


def test_similarity_join_long_and_odd_names(spark):
    """Names of 1 to 60 letters, repeated letters, accents, both scorers, without broadcasts; empty matches nothing."""
    rnd = random.Random(8)
    names = ["".join(rnd.choice("aabcdeé s") for _ in range(rnd.randint(1, 60))) for _ in range(150)] + ["", "aaaaaa", "aaaaab"]
    queries = []
    for n in names:
        k = rnd.randrange(len(n)) if n else 0
        queries += [n[:k] + n[k + 1:], n[:k] + "z" + n[k + 1:], n]
    nd = spark.createDataFrame(list(enumerate(names)), "CID long, Synonyms string")
    qd = spark.createDataFrame(list(enumerate(queries)), "qid long, name string")
    want = {(i, n) for i, q in enumerate(queries) for n in set(names) if jaro_winkler_py(n, q) > 0.9}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit, scorer in ((old, "native"), ("-1", "arrow")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            rows = S.similarity_pairs(qd, nd, scorer=scorer).collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert {(r.qid, r.lname) for r in rows} == want and len(rows) == len(want)
    empty = {r.qid: r.CID for r in S.best_match(qd, nd).collect()}
    assert all(empty[i] is None for i, q in enumerate(queries) if not q)


def test_splits_exact_repeatable_partition_independent(spark):
    rows = [(i, f"c{i % 7 if i % 3 else 0}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, cls string")
    a = {r.id: r.is_test for r in SP.stratified_split(df, "id", "cls", 0.2).collect()}
    b = {r.id: r.is_test for r in SP.stratified_split(df.repartition(13), "id", "cls", 0.2).collect()}
    assert a == b and len(a) == 3000
    sizes, tests = {}, {}
    for i, c in rows:
        sizes[c] = sizes.get(c, 0) + 1
        tests[c] = tests.get(c, 0) + int(a[i])
    assert all(tests[c] == math.ceil(0.2 * sizes[c]) for c in sizes)
    folds = SP.fold_column(df, "id", "cls", k=5).groupBy("cls", "fold").count().collect()
    per = {}
    for r in folds:
        per.setdefault(r.cls, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per.values())


def test_classification_report_fixture(spark):
    # class 'c' never predicted, class 'x' never true
    rows = [(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "c", "a"), (5, "b", "x"), (6, "a", "a")]
    df = spark.createDataFrame(rows, "id long, label string, prediction string")
    rep = {r.row: r for r in M.classification_report(df).collect()}
    assert rep["a"].precision == pytest.approx(2 / 3) and rep["a"].recall == pytest.approx(2 / 3)
    assert rep["c"].precision == 0.0 and rep["c"].f1 == 0.0 and rep["c"].support == 1
    assert rep["x"].support == 0 and rep["x"].recall == 0.0
    assert rep["accuracy"].f1 == pytest.approx(3 / 6)
    assert rep["macro avg"].f1 == pytest.approx((2 / 3 + 0.5 + 0 + 0) / 4)
    cm = {(r.label, r.prediction): r.n for r in M.confusion_matrix(df).collect()}
    assert len(cm) == 16 and cm[("a", "a")] == 2 and cm[("c", "c")] == 0


def test_multilabel_fixture(spark):
    rows = [(1, ["a", "b"], ["a", "b"]), (2, ["a"], ["a", "c"]), (3, ["b"], [])]
    df = spark.createDataFrame(rows, "id long, truth array<string>, predicted array<string>")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    m = M.multilabel_metrics(df, classes).first()
    assert m.subset_accuracy == pytest.approx(1 / 3)
    assert m.precision_micro == pytest.approx(3 / 4) and m.recall_micro == pytest.approx(3 / 4)
    lc = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in M.label_counts(df, classes).collect()}
    assert lc == {"a": (2, 0, 0, 1), "b": (1, 0, 1, 1), "c": (0, 1, 0, 2)}


def test_priority_pick_cases(spark):
    iarc, t3db = JP.IARC, JP.T3DB

    def doc(refs, items, section=True):
        rec = {"Reference": [{"ReferenceNumber": n, "SourceName": s} for n, s in refs]}
        if section:
            rec["Section"] = [{"Section": [{"Section": [{"Information": [
                {"Name": nm, "ReferenceNumber": n, "Value": {"StringWithMarkup": [{"String": v}]}}
                for nm, n, v in items]}]}]}]
        return json.dumps({"Record": rec})

    cases = [
        (doc([(1, iarc)], [("x", 1, "no"), (JP.IARC_ITEM_NAME, 1, "Group 1")]), ("Group 1", iarc, "ok")),
        (doc([(2, t3db), (5, t3db)], [("a", 2, "early"), ("b", 5, "late")]), ("late", t3db, "ok")),
        (doc([(3, t3db), (4, iarc)], [("c", 3, "t3"), (JP.IARC_ITEM_NAME, 4, "Group 2A")]), ("Group 2A", iarc, "ok")),
        (doc([(7, "Other")], [("d", 7, "v")]), ("Not Available", "Unknown", "not_available")),
        (doc([(1, iarc)], [], section=False), ("Error", "Error", "error")),
        (None, ("Not Available", "Unknown", "failed_fetch")),
        ("{not json", ("Error", "Error", "error")),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    got = {r.i: (r.r.value, r.r.source, r.r.status) for r in df.select("i", JP.resolve_priority("j").alias("r")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_retry_merge(spark):
    first = spark.createDataFrame([(1, 10, "Not Available", "Unknown"), (2, 10, "Group 1", JP.IARC),
                                   (3, 20, "Not Available", "Unknown"), (4, 30, "Group 3", JP.IARC)],
                                  "row_id long, cid long, value string, source string")
    retry = spark.createDataFrame([(10, "Group 2B", JP.T3DB), (20, "Not Available", "Unknown")],
                                  "cid long, value string, source string")
    merged, ledger = JP.retry_merge(first, retry)
    m = {r.row_id: r.value for r in merged.collect()}
    assert m == {1: "Group 2B", 2: "Group 1", 3: "Not Available", 4: "Group 3"}
    assert [(r.row_id, r.cid) for r in ledger.collect()] == [(3, 20)]


def test_retry_last_success_counts_and_rows_stay(spark):
    first = spark.createDataFrame([(1, 10, "Not Available", "Unknown"), (2, 10, "Error", "Error")], "row_id long, cid long, value string, source string")
    retry = spark.createDataFrame([(10, "Group 1", JP.T3DB, 1), (10, "Group 2B", JP.T3DB, 2), (10, "Not Available", "Unknown", 3)],
                                  "cid long, value string, source string, attempt int")
    merged, _ = JP.retry_merge(first, retry, retry_order="attempt")
    assert {r.row_id: r.value for r in merged.collect()} == {1: "Group 2B", 2: "Error"}


def test_missing_keys_across_a_new_digit(spark):
    from hazardframe.operators.ocr import missing_keys
    present = spark.createDataFrame([("999999",), ("1000000",), ("0999998",), ("x",)], "image_id string")
    got = sorted(r.image_id for r in missing_keys(spark, present, "image_id", 999997, 1000003, width=6).collect())
    assert got == sorted(["999997", "1000001", "1000002", "1000003"])


@pytest.mark.parametrize("limit", [0, 10_000])
def test_keep_labels_same_rows_either_way(spark, limit):
    from hazardframe.operators.labels import keep_labels
    df = spark.createDataFrame([(1, ["a", "x", "b"]), (1, ["b", "b"]), (1, ["b", "b"]), (2, ["x"]), (3, None), (4, [])], "k int, labels array<string>")
    keep = spark.createDataFrame([("a",), ("b",)], "label string")
    got = sorted((r.k, tuple(r.labels)) for r in keep_labels(df, "labels", keep, inline_limit=limit).collect())
    assert got == [(1, ("a", "b")), (1, ("b", "b")), (1, ("b", "b"))]


def test_ragged_vectors_raise(spark):
    from hazardframe.operators.ml import feature_frame
    with pytest.raises(ValueError):
        feature_frame(spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "v array<double>"), array_col="v")


def test_nan_is_a_gap_and_java_numbers_are_none(spark):
    from hazardframe.operators import clean as CL
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert sorted(r.x for r in CL.fill_missing(df).collect()) == [1.0, 2.0, 2.0, 3.0]
    keys = spark.createDataFrame([("12",), ("12d",), ("12f",), ("0x1p4",), (" 7 ",), ("1e2",), ("1.5",), ("nan",), (".",)], "k string")
    assert [r[0] for r in keys.select(CL.coerce_key("k")).collect()] == [12, None, None, None, 7, 100, None, None, None]
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "n int, t string")
    out, report = CL.clean_table(twice)
    assert out.count() == 2 and report.removed_duplicates() == 1


def test_dataset_join_splits_a_hot_toxin_key(spark):
    from hazardframe.operators.features import _outer_join_salted
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "CID long, x string")
    right = spark.createDataFrame([(1, i) for i in range(300)] + [(2, -1), (9, -2), (None, -3)], "CID long, y long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, _outer_join_salted(left, right, right.select("CID"), "CID", 20).collect()), key=repr)
        want = sorted(map(tuple, left.join(right, "CID", "left").collect()), key=repr)
        assert got == want and len(got) == 603
        plain = _outer_join_salted(left, right, right.select("CID"), "CID", 1000)
        assert sorted(map(tuple, plain.collect()), key=repr) == want
        assert "__salt" not in plain._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_metrics_read_their_input_once(spark):
    import tempfile
    d = tempfile.mkdtemp(prefix="hf-m-")
    spark.createDataFrame([("a", "b", ["x"], ["y"])], "label string, prediction string, truth array<string>, predicted array<string>").write.parquet(f"{d}/p")
    df = spark.read.parquet(f"{d}/p")
    classes = spark.createDataFrame([("x",), ("y",)], "label string")
    for out in (M.classification_report(df), M.weighted_metrics(df), M.confusion_matrix(df), M.multilabel_report(df, classes),
                M.multilabel_metrics(df, classes), M.label_counts(df, classes), M.multilabel_wide(df, ["y", "x"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 1, plan
    assert M.multilabel_wide(df, ["y", "x"]).columns[-2:] == ["f1_x", "f1_y"]


def test_keys_beyond_two_to_53_keep_their_digits(spark):
    from hazardframe.operators.clean import coerce_key
    texts = ["9007199254740993", "-9007199254740995", "9223372036854775807", "9223372036854775808", " 007 ", "12.0", "12.5", "1e3", "x", "", None, "12d"]
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(coerce_key("t").alias("k")).collect()]
    assert got == [9007199254740993, -9007199254740995, 9223372036854775807, None, 7, 12, None, 1000, None, None, None, None]


def test_required_columns_are_counted_and_previews_are_ordered(spark):
    from hazardframe.operators import clean as CL
    df = spark.createDataFrame([(3, "c", None), (1, "a", None), (2, None, None)], "id int, name string, x double")
    got = {r.column_name: (r.present, r["values"], r.rows) for r in CL.column_check(df, ["id", "name", "x", "y"]).collect()}
    assert got == {"id": (True, 3, 3), "name": (True, 2, 3), "x": (True, 0, 3), "y": (False, 0, 3)}
    assert [tuple(r) for r in CL.preview(df, 2, 2, ["id"]).collect()] == [(1, "a"), (2, None)]
