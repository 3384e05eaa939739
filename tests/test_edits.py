"""Edit distance by diagonals and by columns against the full matrix; error rates of long texts against the built-in ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.functions import edits as E
from hazardframe.functions.text import cer, wer
from hazardframe.operators import ocr as O


def _matrix(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_both_methods_equal_the_matrix(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        k = rnd.choice([1, 2, 5, 50])
        a = [rnd.randrange(k) for _ in range(rnd.randrange(40))]
        b = [rnd.randrange(k) for _ in range(rnd.randrange(40))] if rnd.random() < 0.5 else [x for x in a if rnd.random() > 0.1] + [0] * rnd.randrange(4)
        want, x, y = _matrix(a, b), np.array(a, np.int64), np.array(b, np.int64)
        assert E.bits(x, y) == E.furthest(x, y, 100) == E.edit_distance(x, y) == E.furthest(x, y, want) == want
        assert want == 0 or E.furthest(x, y, want - 1) is None


def test_masks_beyond_the_room_are_built_again(monkeypatch):
    monkeypatch.setattr(E, "MASKS_HELD", 0)
    rnd = random.Random(9)
    a, b = ([rnd.randrange(9) for _ in range(200)] for _ in range(2))
    assert E.bits(np.array(a), np.array(b)) == _matrix(a, b)


def test_long_texts_far_apart_and_near():
    rnd = random.Random(3)
    a = np.array([rnd.randrange(20) for _ in range(6000)])
    b = a.copy()
    at = rnd.sample(range(6000), 400)
    b[at] = 99  # each of these has to be changed
    assert E.edit_distance(a, b) == E.bits(a, b) == 400
    c = np.array([rnd.randrange(20, 40) for _ in range(5000)])
    assert E.edit_distance(a, c) == 6000


def test_error_rates_equal_the_built_in_ones(spark):
    rnd = random.Random(5)
    words = "the quick  brown\nfox\tjumps ÜBER die 日本 😀 lazy dog".split(" ")
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(30))), " ".join(rnd.choices(words, k=rnd.randrange(30)))) for i in range(150)]
    rows += [(1000, None, None), (1001, "a", None), (1002, None, "a"), (1003, "", ""), (1004, " ", " "), (1005, "a", " "), (1006, " ", "a b"), (1007, "A b", "a  B")]
    df = spark.createDataFrame(rows, "id long, p string, t string")
    got = O.error_rates(df, "p", "t").withColumn("c", cer("p", "t")).withColumn("w", wer("p", "t")).filter(~F.col("cer").eqNullSafe(F.col("c")) | ~F.col("wer").eqNullSafe(F.col("w")))
    assert got.collect() == []


def test_bounds_that_meet_settle_the_distance(monkeypatch):
    monkeypatch.setattr(E, "furthest", None)  # not needed here
    monkeypatch.setattr(E, "bits", None)
    truth = E.code_points("the other of the two " * 20_000)
    read = np.where(truth == ord("e"), 0xE000, truth)
    assert E.edit_distance(read, truth) == int((truth == ord("e")).sum()) == 60_000
    assert E.edit_distance(*E.word_numbers("a b x d e", "a b c d y")) == 2


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_change_the_distance(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        n, kinds = rnd.randrange(12), rnd.choice([1, 2, 4, 30])
        a, b = ([rnd.randrange(kinds) for _ in range(k)] for k in (n, rnd.choice([n, rnd.randrange(12)])))
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        assert E.edit_distance(x, y) == _matrix(a, b) >= E.least_edits(x, y)
