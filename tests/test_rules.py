"""Rule tables as (input, expected) cases: one per rule plus the quirk rows of the blueprint."""

import pytest
from pyspark.sql import functions as F

from hazardframe.functions import rules as R
from hazardframe.functions.text import parse_list_text, split_list, strip_ws, normalize_text

CARC_CASES = [
    ("Group 1", "Group 1"),
    ("group 2A: probably carcinogenic", "Group 2A"),
    ("2a, probably carcinogenic", "Group 2A"),
    ("2B, possibly carcinogenic", "Group 2B"),
    ("IARC category 2b: limited evidence", "Group 2B"),          # 2b is not anchored
    ("3, not classifiable", "Group 3"),
    ("3,x", "No data"),                                           # needs the second blank
    ("Not listed by IARC", "No data"),                            # tier 1
    ("Not directly listed by IARC", "No data"),
    ("Group 1 and group 3", "Group 1"),                           # earliest wins
    ("see group 3, later group 1", "Group 3"),
    ("No indication of carcinogenicity; group 1", "Group 3"),
    ("Agents are not classifiable; Group 2B", "Group 3"),
    ("1, carcinogenic", "Group 1"),
    ("group1", "Group 1"),
    ("group 12", "No data"),
    ("  Group 2B  ", "Group 2B"),
    ("", "No data"),
    (None, "No data"),
    ("   ", "No data"),
    ("nan", "No data"),
]


def test_classify_first_match(spark):
    df = spark.createDataFrame(CARC_CASES, "text string, expected string")
    got = df.select("text", "expected", R.classify_first_match("text").alias("got")).collect()
    bad = [(r.text, r.expected, r.got) for r in got if r.got != r.expected]
    assert not bad, bad


ROUTE_CASES = [
    ("Oral (L2)", "oral"),
    ("parenteral", None),                  # 'enteral' is rejected first
    ("Intravenous injection", "injection"),
    ("Subcutaneous (rat)", "injection"),
    ("eye contact", "ocular"),
    ("Eyes", "ocular"),
    ("Ocular.", "ocular"),                 # one-word fallback
    ("behavioral", "oral"),                # substring match
    ("temporal", "oral"),
    ("50% absorbed", None),
    ("one two three four five six seven", None),
    ("a b c d e oral", "oral"),            # six words
    ("a b c d e f oral", None),            # seven words
    ("Inhalation", "inhalation"),
    ("skin", "dermal"),
    ("Dermal", "dermal"),
    ("radiation", "radiation"),
    ("ingestion", "oral"),
    ("thus, oral", None),
    ("nan", None), ("None", None), ("-", None), ("", None), (None, None),
    ("(L2)", None),
]


def test_normalize_route(spark):
    df = spark.createDataFrame(ROUTE_CASES, "text string, expected string")
    got = df.select("text", "expected", R.normalize_route("text").alias("got")).collect()
    bad = [(r.text, r.expected, r.got) for r in got if r.got != r.expected]
    assert not bad, bad


def test_normalize_routes_lists(spark):
    rows = [(["Oral", "nan", "oral"], ["oral", "oral"]), (["nan"], ["No data"]), ([], ["No data"]),
            (None, ["No data"]), (["skin", "Eyes"], ["dermal", "ocular"])]
    df = spark.createDataFrame(rows, "a array<string>, e array<string>")
    got = df.select("e", R.normalize_routes("a").alias("g")).collect()
    assert [r.g for r in got] == [r.e for r in got]


NAME_CASES = [
    ("Aspirin", True), ("paracetamol", True), ("Thymol", True), ("Styrene", True), ("Hydrazine", True),
    ("Benzene", False), ("water", False), ("salt", False), ("50-00-0", True), ("CHEBI:15377", True),
    ("NaCl", True), ("Acetic acid, sodium salt", True), ("a" * 40, False), ("a" * 41, True), ("ABCD", True),
    ("abcdef1", True), ("abcdefg1", False), ("abcdef1234", False), ("abcde12345", True),
    ("AbcDefGhi", False), ("AbcDefGhiJkl", True), (None, True), ("InChI=1S/H2O", True), ("C[C@H](N)O", True),
    ("UNII-07OP6H4V4A", True), ("DTXSID2048117", True), ("EINECS 201-162-7", True), ("FEMA NO. 3965", True),
    ("(+/-)-limonene", True), ("racemic lactate", True), ("magnesium", True), ("Caswell No. 123", True),
]


def test_identifier_rules(spark):
    df = spark.createDataFrame(NAME_CASES, "name string, expected boolean")
    got = df.select("name", "expected", R.is_identifier("name").alias("got")).collect()
    bad = [(r.name, r.expected, r.got) for r in got if r.got != r.expected]
    assert not bad, bad


def test_unicode_digits_and_capitals(spark):
    # '²' counts as a digit (str.isdigit), 'Ⅻ' as a capital (str.isupper).
    df = spark.createDataFrame([("abc²",), ("ab²cdefgh",), ("ⅫⅫⅫⅫ name",)], "name string")
    got = [r.g for r in df.select(R.is_identifier("name").alias("g")).collect()]
    assert got == [True, False, True]


def test_list_text_and_split(spark):
    df = spark.createDataFrame([("['oral', \"d'x\"]",), ("[]",), ("['No data']",), ("['nan']",), (None,),
                                ("['a\\'b', 'c\\\\d']",)], "t string")
    got = [r.a for r in df.select(parse_list_text("t").alias("a")).collect()]
    assert got == [["oral", "d'x"], [], ["No data"], ["nan"], [], ["a'b", "c\\d"]]
    df2 = spark.createDataFrame([(' a , "b",c,',), ("x.y",)], "t string")
    assert [r.a for r in df2.select(split_list("t", ",").alias("a")).collect()] == [["a", "b", "c", ""], ["x.y"]]
    assert [r.a for r in df2.select(split_list("t", ".").alias("a")).collect()][1] == ["x", "y"]


def test_whitespace(spark):
    df = spark.createDataFrame([("  a\tb\n  ",), (None,)], "t string")
    got = df.select(strip_ws("t").alias("s"), normalize_text("t").alias("n")).collect()
    assert got[0].s == "a\tb" and got[0].n == "a b"
    assert got[1].s is None and got[1].n == ""
