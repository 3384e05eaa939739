"""The similarity join where many texts share their first letters: few meetings, none lost."""

import random

import pytest
from pyspark.sql import functions as F

from hazardframe.functions.udfs import jaro_winkler_py
from hazardframe.operators import similarity as S

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _names(n, seed, prefix="meth", letters=LETTERS, least=4, most=12):
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        out.add(prefix + "".join(rnd.choice(letters) for _ in range(rnd.randint(least, most))))
    return sorted(out)


def _misspelt(names, n, seed):
    rnd, out = random.Random(seed), []
    for name in rnd.sample(names, n):
        i = rnd.randrange(3, len(name))
        out.append(rnd.choice([name[:i] + rnd.choice(LETTERS) + name[i + 1:], name[:i] + name[i + 1:], name[:i] + rnd.choice(LETTERS) + name[i:],
                               name[:i - 1] + name[i:i + 1] + name[i - 1] + name[i + 1:]]))
    return out


def _frames(spark, names, queries):
    return (spark.createDataFrame(list(enumerate(queries)), "qid long, name string"), spark.createDataFrame(list(enumerate(names)), "CID long, Synonyms string"))


def test_one_prefix_for_all_meets_in_few_pairs(spark):
    names = _names(3000, 1)
    queries = _misspelt(names, 300, 2)
    q, c = _frames(spark, names, queries)
    cand = S.name_candidates(c).checkpoint()
    weights = S._letter_weights(cand)
    left, right = S._sided(q.select(F.lower("name").alias("lq")).distinct(), "lq", [], weights), S._sided(cand, "lname", ["rep"], weights)
    heads = S._crowded(left, right, 4)
    assert [r.head for r in heads.collect()] == ["meth"]
    met = S.crowded_meetings(left, right, heads, 0.9, 4).count()
    print("meetings", met)
    assert met <= 0.05 * len(names) * len(set(queries))


@pytest.mark.parametrize("crowd, together, letters", [(0, 4, LETTERS), (0, 2, "aeinst"), (50, 1, "aeinst"), (0, 3, "ab")])
def test_crowded_prefixes_lose_no_pair(spark, monkeypatch, crowd, together, letters):
    monkeypatch.setattr(S, "CROWDED_PAIRS", crowd)
    monkeypatch.setattr(S, "MOST_TOGETHER", together)
    names = _names(60, 3, "meth", letters) + _names(40, 4, "met", letters, 1, 5) + _names(30, 5, "me", letters, 1, 9) + _names(20, 6, "", "abm", 1, 4) + ["meth", "met", "methmethmeth"]
    names = sorted(set(names))
    queries = sorted({*_misspelt([x for x in names if len(x) > 4], 60, 7), "meth", "met", "metha", "éth", "methyl"})
    q, c = _frames(spark, names, queries)
    got = {(r.qid, r.lname) for r in S.similarity_pairs(q, c).collect()}
    assert got == {(i, x) for i, a in enumerate(queries) for x in names if jaro_winkler_py(x, a) > 0.9}


def test_the_length_plan_shares_enough_tokens():
    for p in (3, 4):
        floor = S.overlap_floor(0.9, p)
        for n, m, shared, together in S.length_plan(list(range(p, 30)), list(range(p, 30)), 0.9, p):
            fewest = next(o for o in range(p, min(n, m) + 1) if o / n + o / m > floor)
            assert shared == fewest - p and together <= max(shared, 0) and (together > 0) == (shared > 0)
