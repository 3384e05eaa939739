"""Operator 6 further: decoding against all tag sequences, rare data, spans that are whole, variants in held-out texts."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd import SF_SMALL
from hazardframe.llm import bilstm_crf as B
from hazardframe.llm import pii_crf as I
from hazardframe.llm.common import documents


@pytest.fixture(scope="module")
def model(spark):
    return I.train(documents(spark, "/root/testdata/sf0.01"), "doc_id", "text")


def _find(model, text):
    starts = I.window_starts(text)
    if not starts:
        return []
    codes = I.symbols(text)
    return I.added_spans(text, I.base_spans(text), starts, B.viterbi(model, np.array([I._window(codes, s) for s in starts])))


def test_viterbi_equals_all_tag_sequences():
    rng = np.random.default_rng(4)
    p = B.initial(6, 3, 4, seed=2)
    p["trans"] = rng.normal(0, 1, (3, 3))
    p["bias"] = rng.normal(0, 1, 3)
    x = rng.integers(0, 6, (8, 6))
    e = B.emissions(p, x)[0]
    for n, tags in enumerate(B.viterbi(p, x)):
        def score(seq):
            return sum(e[k][n, t] for k, t in enumerate(seq)) + sum(p["trans"][a, b] for a, b in zip(seq, seq[1:]))
        assert score(tags) == pytest.approx(max(map(score, itertools.product(range(3), repeat=6))))


def test_variants_in_held_out_texts(spark, model):
    rnd = random.Random(3)
    texts = [r.text for r in documents(spark, "/root/testdata/sf0.1").filter("doc_id % 4 = 1").select("text").collect()]
    plain = [t for t in texts if len(t) > 300 and not I._NEAR.search(t)]
    right, every = Counter(), Counter()
    for kind, datum in [(k, t[s:e]) for t in texts for s, e, k in I.base_spans(t)]:
        if every[kind] > 100:
            continue
        for other in I._variants(kind, datum):
            text = rnd.choice(plain)
            at = text.index(" ", rnd.randrange(200)) + 1
            text = text[:at] + other + " " + text[at:]
            if I.base_spans(text):
                continue
            every[kind] += 1
            right[kind] += (at, at + len(other), kind) in _find(model, text)
    assert set(every) == set(I.KINDS) and all(right[k] >= 0.9 * every[k] for k in every), (right, every)


def test_added_spans_are_no_parts_of_longer_numbers(spark, model):
    rnd = random.Random(8)
    long = ["".join(rnd.choice("0123456789") for _ in range(rnd.randrange(14, 30))) for _ in range(300)]
    texts = [f"the order {x} of the day" for x in long] + [f"ref {x[:6]}/{x[6:10]}-{x[10:]}-{x[:5]} end" for x in long]
    texts += [r.text for r in documents(spark, SF_SMALL).select("text").collect()]
    for t in texts:
        for s, e, kind in _find(model, t):
            assert not re.search(r"[0-9][./-]?$", t[:s]) and not re.match(r"[./-]?[0-9]", t[e:]), (kind, t[max(0, s - 9):e + 9])


def test_rare_data_train_a_tagger(spark):
    """Three rows of 40,003 hold a datum: the tagger is there and finds one that the patterns miss."""
    filler = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("nothing to see in text number "), F.col("id").cast("string")).alias("text"))
    some = [(50_001, "write to jim@mail.example.org today"), (50_002, "card 4587 1215 1940 0672 was used"), (50_003, "the host 10.2.33.4 is down")]
    docs = filler.unionByName(spark.createDataFrame(some, "doc_id long, text string")).repartition(8)
    assert I.train(docs, "doc_id", "text") is not None
    assert I.train(filler, "doc_id", "text") is None
