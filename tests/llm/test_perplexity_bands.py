"""Operator 4 further: writings of thousands of characters, an independent Kneser-Ney model, bands that don't depend on partitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd import SF_SMALL
from hazardframe.llm import quality_ppl as Q
from hazardframe.llm.common import documents
from hazardframe.llm.queries import QUERIES


def _han(rnd, words, n):
    return " ".join(rnd.choices(words, k=n))


def test_random_characters_cost_more_than_prose_of_a_large_writing(spark):
    rnd = random.Random(4)
    characters = [chr(0x4E00 + i) for i in range(3000)]
    weights = [1 / (1 + i) for i in range(3000)]
    words = ["".join(rnd.choices(characters, weights, k=rnd.randint(1, 3))) for _ in range(2500)]
    prose = [(i, _han(rnd, words, rnd.randint(80, 160)), "zh") for i in range(300)]
    junk = [(1000 + i, " ".join("".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(2)) for _ in range(100)), "zh") for i in range(10)]
    got = {r.doc_id: r for r in Q.score(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")).select("row.doc_id", "m.log_ppl", "kept").collect()}
    assert min(got[i].log_ppl for i, *_ in junk) > max(got[i].log_ppl for i, *_ in prose)
    assert not any(got[i].kept for i, *_ in junk) and sum(got[i].kept for i, *_ in prose) > 290


def test_shares_of_the_others_sum_to_one():
    model = Q.others(np.array([9, 5, 7]), np.array([3, 1, 2]), 4)
    assert model["o"].tolist() == [5, 7, 9] and np.exp(model["po"]).sum() == pytest.approx(1)
    logs = Q.other_logs(model, np.array([97, 98]), ["ab", "a" + chr(9) + chr(7), chr(1)])
    assert logs.tolist() == pytest.approx([0, math.log(3 / 11) + math.log(2 / 11), math.log(5 / 11)])
    assert Q.other_logs(model, np.array([97, 98]), ["ab", "ba"]) is None


def _plain_kneser_ney(words):
    """Interpolated modified Kneser-Ney over symbols 0 to V - 1 in dictionaries: probability of z after x, y."""
    tri = Counter()
    for w, n in words.items():
        codes = [0, 0, *w, 0]
        for k in range(len(codes) - 2):
            tri[tuple(codes[k:k + 3])] += n

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
        return [0.0, *(min(max(x, 0.1), k) for k, x in enumerate(d, 1))]

    bi = defaultdict(set)
    raw = Counter()
    for (x, y, z), n in tri.items():
        bi[y, z].add(x)
        raw[y, z] += n
    two = {(y, z): raw[y, z] if y == 0 else len(xs) for (y, z), xs in bi.items()}
    one = Counter(z for _, z in two)
    d1, d2, d3 = discounts(one.values()), discounts(two.values()), discounts(tri.values())

    def p1(z):
        total = sum(one.values())
        return (one[z] - d1[min(one[z], 3)]) / total + sum(d1[min(c, 3)] for c in one.values()) / total / Q.V

    def p2(y, z):
        row = {b: c for (a, b), c in two.items() if a == y}
        if not row:
            return p1(z)
        c, total = row.get(z, 0), sum(row.values())
        return (c - d2[min(c, 3)]) / total + sum(d2[min(x, 3)] for x in row.values()) / total * p1(z)

    def p3(x, y, z):
        row = {b[2]: c for b, c in tri.items() if b[:2] == (x, y)}
        if not row:
            return p2(y, z)
        c, total = row.get(z, 0), sum(row.values())
        return (c - d3[min(c, 3)]) / total + sum(d3[min(x, 3)] for x in row.values()) / total * p2(y, z)

    return p3


def test_arrays_equal_a_plain_kneser_ney_model():
    rnd = random.Random(7)
    letters = np.array([97, 98, 99, 100])
    words = Counter("".join(rnd.choices("abcd", [5, 3, 2, 1], k=rnd.randint(1, 6))) for _ in range(400))
    hashes, each = Q.grams_of(list(words), letters)
    found, where = np.unique(hashes, return_inverse=True)
    model = Q.kneser_ney(found, np.bincount(where, weights=np.repeat(list(words.values()), each)).astype(np.int64))
    p3 = _plain_kneser_ney({tuple(ord(c) - 97 + 2 for c in w): n for w, n in words.items()})
    for x, y, z in [(rnd.randrange(7), rnd.randrange(7), rnd.randrange(7)) for _ in range(300)] + [(0, 0, 2), (0, 2, 0), (2, 3, 0)]:
        if y == 0 and x != 0:
            continue  # nothing stands between a word's start and its end
        got = Q.gram_logs(model, np.array([(x * Q.V + y) * Q.V + z]))[0]
        assert got == pytest.approx(math.log(p3(x, y, z)), abs=1e-9), (x, y, z)


def test_verdicts_don_t_depend_on_partitions(spark):
    docs = documents(spark, SF_SMALL).select("doc_id", "text", "lang")
    out = [{(r.doc_id, r.kept, r.low, r.high) for r in Q.score(docs.repartition(n)).select("row.doc_id", "kept", "low", "high").collect()} for n in (1, 6)]
    assert out[0] == out[1]


def test_quality_query_has_its_columns(spark):
    out = QUERIES["op4_quality_ppl"](spark, SF_SMALL)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert out.filter("kept and base_failed").count() == 0 and out.count() == documents(spark, SF_SMALL).count()


def _many_languages(n):
    """Three texts of 60 to 90 words in each of n languages, one of the null language, and some without words."""
    rnd = random.Random(11)
    rows = []
    for k in range(n):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyz", 8)
        words = ["".join(rnd.choices(letters, k=rnd.randint(1, 6))) for _ in range(200)]
        rows += [(3 * k + j, " ".join(rnd.choices(words, k=rnd.randint(60, 90))), f"l{k}") for j in range(3)]
    return rows + [(-1, " ".join(rnd.choices(words, k=70)), None), (-2, " ", "blank"), (-3, None, "l0"), (-4, "", None), (-5, " ", "")]


def test_every_language_has_its_model_and_band(spark, monkeypatch):
    rows = _many_languages(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    own, models = Q.train(docs)
    assert own == sorted(["", *(f"xl{k}" for k in range(300))]) and set(models) == {*own, "*"}

    def scored():
        return sorted(Q.score(docs).select("row.doc_id", "row.lang", "m.log_ppl", "base_failed", "kept", "low", "high").collect())

    got = scored()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    of = defaultdict(list)
    for r in got:
        if not r.base_failed:
            of[r.lang].append(round(r.log_ppl, Q.GRAIN))
    assert len(of) == 301
    for r in got:
        if r.lang in of:
            q1, q3 = np.percentile(of[r.lang], [25, 75])
            width = max(q3 - q1, Q.LEAST_WIDTH)
            assert (r.low, r.high) == (pytest.approx(q1 - Q.LOW_FENCE * width), pytest.approx(q3 + Q.HIGH_FENCE * width))
        else:
            assert r.low is None and not r.kept
    # The rows of models that are loaded in portions, and of bands that are not broadcast, are the same.
    total = sum(x.nbytes + 256 for letters, arrays in models.values() for x in (letters, *arrays.values()))
    monkeypatch.setattr(Q, "MODELS_HELD", total // 4)
    monkeypatch.setattr(Q, "BANDS_SENT", 0)
    assert scored() == got


def test_portions_hold_every_key_once():
    keys = ["", "xa", "xb", "xc", "x\U0001F600"]
    for most in (0, 10, 25, 1000):
        ranges = Q.portions({k: 10 for k in keys}, most)
        assert len(ranges) == {0: 5, 10: 5, 25: 3, 1000: 1}[most]
        for k in [*keys, "x", "xaa", "xzz", "x\uffff"]:
            assert sum((a is None or a <= k) and (b is None or k < b) for a, b in ranges) == 1
    assert Q.portions({}, 10) == [(None, None)]


def test_all_characters_of_a_language_have_a_share(spark):
    points = [*range(0x4E00, 0x9F00), 0x10FFFF]  # more than 2^14
    text = " ".join(chr(c) * (1 + i % 3) for i, c in enumerate(points))
    alphabet, arrays = Q.train(spark.createDataFrame([(text, "zh")], "text string, lang string"))[1]["xzh"]
    counts = {c: 1 + i % 3 for i, c in enumerate(points)}
    assert alphabet.tolist() == sorted(sorted(points, key=lambda c: (-counts[c], c))[:Q.ALPHABET])
    rest = sorted(set(points) - set(alphabet.tolist()))
    assert arrays["o"].tolist() == rest and np.exp(arrays["po"]).sum() == pytest.approx(1)
    total = sum(counts[c] for c in rest) + 1
    assert np.exp(arrays["po"]).tolist() == pytest.approx([*(counts[c] / total for c in rest), 1 / total])
