"""Operators 11 to 13: audit against applying the filters, clusters against all distances, the class model against its definition."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd import SF_SMALL, no_documents, odd_documents, stored_odd_documents  # noqa: F401
from hazardframe.llm import bisector as B
from hazardframe.llm import brown_lm as L
from hazardframe.llm import filter_audit as A
from hazardframe.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"


# --- 11 -----------------------------------------------------------------------------------------------------

def _words(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _failed(rows):
    """The filters by their text, document by document."""
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = _words(text)
        fails = {k for k, bad in {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                                  "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
                                  "E": any((t or "") == text and i is not None and (doc_id is None or i < doc_id) for i, t, _ in rows)}.items() if bad}
        out.append((doc_id, lang or "", fails))
    return out


def _audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    marked, out = _failed(rows), {}
    for part in {p for _, p, _ in marked}:
        mine = [(i, f) for i, p, f in marked if p == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, k in enumerate(order, 1):
                here, left = [x for x in left if k in x[1]], [x for x in left if k not in x[1]]
                out[part, "".join(order), step] = [len(left), len(here), sum(k in f for _, f in gone), sum(f == {k} for _, f in mine),
                                                   sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
                gone += here
                total[k] += len(here)
        for order in permutations("ABCDE"):
            for step, k in enumerate(order, 1):
                out[part, "".join(order), step].append(total[k])
    return out


def _odd_texts():
    rnd = random.Random(5)
    prose = [" ".join(f"w{rnd.randrange(10_000)}" for _ in range(n)) for n in (99, 100, 150, 400)]
    texts = prose + [" ".join(["a"] * 100), prose[1].upper(), prose[1] + " 50%", "", None, "#", " \t\n", "é" * 30 + "ABC", "AB" + "x" * 18, "ABC" + "x" * 17, prose[2] + " x", "word " * 20_000]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts + prose + texts[6:9], ["en", "de", None, ""] * 20))]
    return rows + [rows[1], rows[1], (None, prose[0], "en"), (None, "alone", "en"), (None, "alone", "fr")]


def test_positional_popcount_is_exact():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 5, 100, 4097):
        words = rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        times = rnd.integers(0, 1000, n)
        bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        assert (A.positional_popcount(words) == bits.sum(axis=0)).all()
        assert (A.positional_popcount(words, times) == (bits * times[:, None]).sum(axis=0)).all()
    assert A.positional_popcount(np.array([1, 3], np.uint32), np.array([1 << 40, 5]))[:2].tolist() == [(1 << 40) + 5, 5]


def test_survival_words_are_truth_tables():
    for fails in range(32):
        assert [int(A.WORDS[fails]) >> s & 1 for s in range(32)] == [int(fails & s == 0) for s in range(32)]


def test_audit_equals_applying_the_filters_in_every_order(spark):
    rows = _odd_texts()
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (4, 0, 0), (5, 1, 0), (5, 0, 1), (8, None, 1), (99, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, part string, good boolean").repartition(5)
    told = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, n string")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in A.audit(docs, told).collect()}
    assert got == _audit(rows, [x for x in labels if x[0] is not None])


def test_audit_of_odd_and_empty_tables(spark, stored_odd_documents, no_documents):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert A.audit(no_documents, labels).count() == 0
    out = A.audit(stored_odd_documents, labels.limit(0)).collect()
    parts = {r.part for r in out}
    assert len(out) == 600 * len(parts) and parts == {r.lang or "" for r in stored_odd_documents.collect()}
    assert sum(r.kept + r.removed for r in out if r.step == 1 and r.filter_order == "ABCDE") == stored_odd_documents.count()
    assert all(r.good_lost == r.toxic_lost == 0 for r in out)


# --- 12 -----------------------------------------------------------------------------------------------------

def _clusters(rows, k=16, rounds=3, dims=64):
    """By all distances, in Python's own whole numbers."""
    kept = []
    for i, vec in rows:
        x = [None if c is None else float(c) for c in vec or []]
        if len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(64 * c) for c in x]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, of) if o == n])] or c for n, c in enumerate(centroids)]
    return sorted([(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], key=repr), centroids


def _vectors(n, seed, dims=64):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([0.0, 0.25, -0.25, 0.015625, rnd.uniform(-2, 2)]) for _ in range(dims)]) for i in range(n)]
    return rows + rows[:n // 4] + [(n + i, list(v)) for i, (_, v) in enumerate(rows[:n // 3])]


@pytest.mark.parametrize("n", [300, 12, 1])
def test_clusters_equal_all_distances_with_ties_and_repeats(spark, n):
    rows = _vectors(n, n)
    rows += [(9001, None), (9002, []), (9003, [0.1] * 63), (9004, [0.1] * 65), (9005, [0.1] * 63 + [None]), (9006, [0.1] * 63 + [float("nan")]),
             (9007, [0.1] * 63 + [float("inf")]), (None, [0.5] * 64), (9008, [1000.0] * 64)]
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(4)
    found, centroids = B.cluster(df)
    want, want_centroids = _clusters(rows)
    assert sorted([(r.id, r.cluster, r.distance) for r in found.collect()], key=repr) == want
    assert centroids == want_centroids


@pytest.mark.parametrize("k", [1, 2, 3, 5, 16, 21])
def test_tournament_of_any_size_favours_the_smaller_number(k):
    rnd = np.random.default_rng(k)
    centroids = rnd.integers(-3, 4, (k, 4)).tolist()
    v = rnd.integers(-4, 5, (500, 4))
    far = ((v[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    meet = B.Tournament(centroids)
    won = meet.winners(v)
    assert (won == far.argmin(axis=1)).all() and (meet.distances(v, won) == far.min(axis=1)).all()


def test_empty_clusters_stay_and_large_components_are_exact_or_refused(spark):
    same = spark.createDataFrame([(i, [1.0] * 64) for i in range(40)], "vec_id long, embedding array<float>")
    found, centroids = B.cluster(same)
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)} and centroids == [[64] * 64] * 16
    big = [(0, [2_000_000.0] * 64), (1, [-2_000_000.0] * 64), (2, [1_999_999.5] * 64)]
    schema = "vec_id long, embedding array<double>"
    got, _ = B.cluster(spark.createDataFrame(big, schema), k=2)
    assert sorted((r.id, r.cluster, r.distance) for r in got.collect()) == _clusters(big, k=2)[0]
    with pytest.raises(Exception, match="beyond"):
        B.cluster(spark.createDataFrame([(0, [1e300] * 64)], schema))[0].collect()
    assert B.cluster(spark.createDataFrame([], schema))[0].count() == 0


def test_cluster_query_has_its_columns(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    empty = QUERIES["op12_bisector_clusters"](spark, str(tmp_path))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0


# --- 13 -----------------------------------------------------------------------------------------------------

def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _split(rows):
    """(id, tokens, held out) by the contract's words."""
    return [(i, _words(_lower(t)) + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]


def _base(rows):
    docs = _split(rows)
    c = Counter(t for _, ts, held in docs if not held for t in ts)
    n, v = sum(c.values()), len(c)
    return {(i, len(ts), sum(c[t] > 0 for t in ts), held, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for i, ts, held in docs}, n


def _model_score(rows, model):
    """The class model by its definition, token by token, given the classes."""
    docs = _split(rows)
    k = len(model.spread)
    keys = {w: i for i, w in enumerate(model.table.keys)}

    def of(token):
        if token is None:
            return model.classes[model.table.end]
        key = L.word_key(token.encode())
        rank = keys.get(key, len(keys))
        return model.classes[rank if rank < model.table.own else model.table.own + zlib.crc32(key[-3:]) % model.table.forms]

    train = [ts for _, ts, held in docs if not held]
    words = Counter(t for ts in train for t in ts)
    pairs = Counter((of(a), of(b)) for ts in train for a, b in zip([None, *ts], ts))
    size, kinds = Counter(), Counter()
    for t, n in words.items():
        size[of(t)] += n
        kinds[of(t)] += 1
    total = sum(pairs.values())
    before = Counter()
    share = Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        share[b] += n

    def p(a, b, token):
        step = (pairs[a, b] + k * (share[b] + 1) / (total + k)) / (before[a] + k)
        return step * (words[token] + 1) / (size[b] + kinds[b] + 1)

    assert all(abs(sum(p(a, b, "\0") * (size[b] + kinds[b] + 1) for b in range(k)) - 1) < 1e-9 for a in range(k))
    return {(i, round(sum(math.log10(p(of(a), of(b), b)) for a, b in zip([None, *ts], ts)), 6)) for i, ts, _ in docs}


def _texts(spark, n=200):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").limit(n).collect()
    rows = [(r.doc_id, r.text) for r in docs]
    return rows + [(10_001, None), (10_002, ""), (10_003, " \n "), (10_004, "Q" * 500 + " plain " + "q" * 500), (10_005, "unheardof İ word"), (rows[3][0], rows[3][1]), (None, "no id")]


@pytest.mark.parametrize("settings", [{}, {"classes": 5, "own": 50, "forms": 7, "rounds": 3, "lookup": 300}, {"classes": 4, "own": 10, "forms": 3, "rounds": 1, "lookup": 0}])
def test_scores_equal_the_definitions(spark, settings):
    rows = _texts(spark)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, word string, n double").repartition(3)
    ready = L.prepared(df, "doc_id", "text", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
    model, words = L.train(ready, **settings)
    got = L.score(ready, model, words).collect()
    base, n = _base(rows)
    assert model.tokens == n and len(got) == len(rows)
    assert {(r.id, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in got} == base
    assert {(r.id, round(r.score, 6)) for r in got} == _model_score(rows, model)
    assert model.classes[model.table.end] == 0 and (model.classes[:-1] > 0).all()


def test_gains_are_differences_of_the_likelihood():
    rnd = np.random.default_rng(1)
    units, k = 12, 4
    n = rnd.integers(0, 6, (units, units)).astype(float)
    classes = rnd.integers(0, k, units)

    def matrix(of):
        m = np.zeros((k, k))
        np.add.at(m, (of[:, None].repeat(units, 1), of[None].repeat(units, 0)), n)
        return m

    for u in range(units):
        after, before = np.bincount(classes, weights=n[u], minlength=k), np.bincount(classes, weights=n[:, u], minlength=k)
        got = L.gains(matrix(classes), after, before, n[u, u], classes[u])
        for c in range(k):
            moved = classes.copy()
            moved[u] = c
            assert abs(got[c] - (L.likelihood(matrix(moved)) - L.likelihood(matrix(classes)))) < 1e-8


def test_exchange_finds_the_classes_of_a_made_up_language(spark):
    """Sentences alternate between two kinds of words: the classes must tell them apart, and held-out text is likelier than without classes."""
    rnd = random.Random(2)
    noun, verb = [f"n{i}x" for i in range(30)], [f"v{i}y" for i in range(30)]
    rows = [(i, " ".join(rnd.choice(verb if j % 2 else noun) for j in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ready = L.prepared(df, "doc_id", "text", F.col("doc_id") % 5 == 0)
    model, words = L.train(ready, classes=3, own=60, forms=1, rounds=12)
    at = {w.decode(): model.classes[i] for i, w in enumerate(model.table.keys)}
    assert len({at[w] for w in noun}) == 1 and len({at[w] for w in verb}) == 1 and at[noun[0]] != at[verb[0]]
    held = L.score(ready, model, words).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b + 60 * 40 * 0.25


def test_better_than_the_base_on_held_out_documents_and_the_same_in_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    out = []
    for parts in (1, 7):
        ready = L.prepared(docs.repartition(parts), "doc_id", "text", held)
        model, words = L.train(ready, rounds=4)
        out.append({r.id: (r.held_out, r.base_score, r.score) for r in L.score(ready, model, words).collect()})
    assert all(abs(a[2] - out[1][i][2]) < 1e-6 and a[0] == out[1][i][0] for i, a in out[0].items())
    assert sum(a[2] for a in out[0].values() if a[0]) > sum(a[1] for a in out[0].values() if a[0])


def test_empty_tables_and_no_training_rows(spark, no_documents):
    ready = L.prepared(no_documents, "doc_id", "text", F.lit(False))
    model, words = L.train(ready)
    assert L.score(ready, model, words).count() == 0
    ready = L.prepared(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), "doc_id", "text", F.lit(True))
    model, words = L.train(ready)
    assert {(r.id, r.n_tokens, r.n_known, r.base_score) for r in L.score(ready, model, words).collect()} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}


def test_class_model_query_has_its_columns(spark):
    out = QUERIES["op13_brown_lm"](spark, SF_SMALL)
    assert out.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
