"""Operator 1 further: decoding against all paths, the short cut for plain words against the long way, the query's columns."""

import random
import re
import zlib

import numpy as np

from odd import SF_SMALL
from hazardframe.llm import toxicity as T

def _all_paths(decoder, run):
    """Every path through the lattice, the best by score then text: Viterbi without states."""
    found = [(0.0, "", 0, 0)]
    for at, c in enumerate(run):
        repeat = None
        if at and run[at - 1] == c:
            repeat = T.REPEAT if at > 1 and run[at - 2] == c or run[at + 1:at + 2] == c else T.DOUBLE if c.isalpha() else T.ODD
        ahead = []
        for score, text, a, b in found:
            for x, cost in decoder._choices(c, repeat):
                if not x:
                    ahead.append((score + cost, text, a, b))
                elif x == " ":
                    if b:
                        ahead.append((score + cost + decoder.logs[a, b, 0], text + " ", 0, 0))
                else:
                    k = decoder.code.get(x, 1)
                    ahead.append((score + cost + decoder.logs[a, b, k], text + x, b, k))
        found = ahead or found
    return max(score + decoder.logs[a, b, 0] for score, _, a, b in found)


def test_viterbi_equals_all_paths_of_short_runs():
    rnd = random.Random(11)
    letters = np.array(sorted(map(ord, "abeilost")), np.int64)
    logs = np.log(np.random.default_rng(2).dirichlet(np.full(T.V, 0.2), (T.V, T.V)) + 1e-9).astype(np.float32)
    decoder = T.Decoder(letters, logs)
    for _ in range(150):
        run = "".join(rnd.choice("abil013$!.-s|oo") for _ in range(rnd.randrange(1, 7)))
        score, text = decoder.best(run)
        assert abs(score - _all_paths(decoder, run)) < 1e-4, run


def test_simple_words_are_read_as_by_the_long_way():
    """The short cut for plain words gives what the general rules give."""
    letters = np.array(sorted(map(ord, "abcdefghijklmnopqrstuvwxyz")), np.int64)
    logs = np.log(np.random.default_rng(5).dirichlet(np.full(T.V, 0.3), (T.V, T.V)) + 1e-9).astype(np.float32)
    decoder = T.Decoder(letters, logs)
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aabbeeté") for _ in range(rnd.randrange(1, 7))) + rnd.choice(["", "", ".", ",", ";:"]) for _ in range(400)]
    short = [decoder.word(w) for w in words]
    decoder.held.clear()
    general = re.compile("(?!)")  # matches nothing: no word is simple
    try:
        T._SIMPLE, kept = general, T._SIMPLE
        assert [decoder.word(w) for w in words] == short
    finally:
        T._SIMPLE = kept


def test_spelled_words_with_wide_gaps():
    letters = np.array(sorted(map(ord, "abcdefghijklmnopqrstuvwxyz")), np.int64)
    flat = np.full((T.V, T.V, T.V), -np.log(T.V), np.float32)
    decoder = T.Decoder(letters, flat)
    assert decoder.spelled("you i  d  i  o  t") == {"idiot"}
    assert decoder.spelled("s t u p i d  f o o l") == {"stupid", "fool"}


def test_toxicity_query_has_its_columns(spark):
    from hazardframe.llm.queries import QUERIES
    out = QUERIES["op1_toxicity"](spark, SF_SMALL)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
