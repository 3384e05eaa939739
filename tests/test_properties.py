"""Property checks: error rates are 0 exactly for equal normalised texts, never
negative; rounding equals Python's round() on the double num/den for random ratios."""

from hypothesis import given, settings, strategies as st

from hazardframe.functions.text import cer, round_ratio, wer

WORDS = st.lists(st.sampled_from(["water", "salt", "acid", "sodium", "e", "x", "Water", "  ", "\t", "é"]),
                 min_size=0, max_size=12).map(" ".join)


def _norm(t):
    return " ".join(t.split()).lower()


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=60, max_size=60))
def test_error_rates_zero_iff_equal(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, t string")
    rows = df.select("p", "t", cer("p", "t").alias("c"), wer("p", "t").alias("w")).collect()
    for r in rows:
        if not r.t:
            assert r.c == 1.0 and r.w == 1.0
            continue
        same = _norm(r.p) == _norm(r.t)
        assert (r.c == 0.0) == same or (_norm(r.t) == "" and _norm(r.p) == "")
        assert (r.w == 0.0) == (_norm(r.p).split() == _norm(r.t).split()) or _norm(r.t) == ""
        assert r.c >= 0.0 and r.w >= 0.0


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(1, 5000)), min_size=300, max_size=300))
def test_round_ratio_random(spark, cases):
    df = spark.createDataFrame(cases, "n long, m long")
    for r in df.select("n", "m", round_ratio("n", "m", 4).alias("r")).collect():
        assert r.r == round(r.n / r.m, 4), (r.n, r.m)
