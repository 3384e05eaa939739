"""API-level operators without a driver query: required columns, class-set assertion, preview,
file stem / zero padding, clean_table report and step order, fill values."""

import pytest
from pyspark.sql import functions as F

from hazardframe.functions.text import file_stem, zero_pad
from hazardframe.operators import clean as CL
from hazardframe.operators.labels import assert_classes


def test_require_columns_and_classes(spark):
    df = spark.createDataFrame([(1, "Group 1"), (2, "Group 3")], "CID long, label string")
    assert CL.require_columns(df, ["CID"]) is df
    with pytest.raises(ValueError):
        CL.require_columns(df, ["CID", "SMILES"])
    assert_classes(df, "label", ["Group 1", "Group 3"])
    with pytest.raises(AssertionError):
        assert_classes(df, "label", ["Group 1", "Group 2A", "Group 3"])


def test_preview_stem_pad(spark):
    df = spark.createDataFrame([(i, f"/img/{i:03d}.jpg") + tuple(range(10)) for i in range(8)],
                               "id int, path string, " + ", ".join(f"c{i} int" for i in range(10)))
    p = CL.preview(df)
    assert len(p.columns) == 10 and p.count() == 5
    got = [(r.s, r.z) for r in df.select(file_stem("path").alias("s"), zero_pad("id").alias("z")).collect()]
    assert got[3] == ("003", "003")
    assert [r.z for r in spark.createDataFrame([(12345,)], "k long").select(zero_pad("k").alias("z")).collect()] == ["12345"]


def test_clean_table_order_and_report(spark):
    rows = [(" A ", "x,y", "l1\nl2", 1.0), ("A", "x,y", "l1\nl2", 1.0), (" A ", "x,y", "l1\nl2", 1.0),
            (None, "z", None, None)]
    df = spark.createDataFrame(rows, "Name string, Tags string, Notes string, Score double")
    out, rep = CL.clean_table(df, keep_columns=["Name", "Tags", "Notes", "Score", "Missing"],
                              list_columns=["Tags"], newline_to_space_columns=["Notes", "Nope"], fill=True)
    assert rep.missing_keep == ["missing"] and rep.missing_newline == ["nope"]
    got = sorted(((r.name, tuple(r.tags), r.notes, r.score) for r in out.collect()), key=repr)
    # de-duplication runs before trimming: ' A ' and 'A' are two rows that become equal later
    assert got.count(("A", ("x", "y"), "l1 l2", 1.0)) == 2
    # fill: text mode among ties is the smallest value, numbers get the mean
    assert ("A", ("z",), "l1 l2", 1.0) in got


def test_fill_values_mode_and_mean(spark):
    df = spark.createDataFrame([("b", 1), ("a", 3), ("b", None), ("a", None), (None, 5)], "t string, n int")
    vals = CL.fill_values(df)
    assert vals == {"t": "a", "n": 3.0}
