"""Operators 9 and 5: exact dedup against plain grouping, mixing against its constraints."""

import hashlib

import pytest
from pyspark.sql import functions as F

from odd import SF_SMALL, no_documents, odd_documents, stored_odd_documents  # noqa: F401
from hazardframe.llm import entropy_mix as X
from hazardframe.llm import exact_dedup as E
from hazardframe.llm.common import documents


def _plain(rows):
    groups = {}
    for doc_id, text in rows:
        norm = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(norm, []).append(doc_id)
    return groups


def _weak(norm):
    return F.substring(F.unhex(F.sha2(norm, 256)), 1, 0)  # one digest for all texts


@pytest.mark.parametrize("digest", [E.sha256, _weak])
def test_copies_are_found_also_when_digests_collide(spark, odd_documents, digest):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    want = sorted(((i, max((x for x in ids if x is not None), default=None), len(ids)) for norm, ids in _plain(rows).items() for i in ids), key=repr)
    got = sorted(((r.id, r.keep_id, r.size) for r in E.mark_copies(odd_documents, salts=3, digest=digest).collect()), key=repr)
    assert got == want


def test_one_document_of_each_text_stays_with_all_columns(spark, odd_documents, no_documents):
    kept = E.drop_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    groups = _plain([(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()])
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((max((x for x in ids if x is not None), default=None) for ids in groups.values()), key=repr)
    assert E.drop_copies(no_documents).count() == 0 and E.mark_copies(no_documents).count() == 0


def test_op9_hashes(spark):
    texts = {r.doc_id: r.text for r in documents(spark, SF_SMALL).collect()}
    for r in E.op9_exact_dedup(spark, SF_SMALL).collect():
        norm = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest() and r.kept == (r.doc_id == r.keep_id)


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, budget, fixed = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * sizes[s]}
        if not over:
            return fixed | {s: weight[s] * level for s in left}
        fixed |= {s: 2.0 * sizes[s] for s in over}
        budget, left = 1.5 * sum(sizes.values()) - sum(fixed.values()), left - over
    return fixed


def test_mix_meets_its_targets_and_repeats_itself(spark):
    rows = X.op5_entropy_mix(spark, SF_SMALL).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = _targets(sizes)
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    assert all(abs(taken[s] - want[s]) <= 0.5 * largest[s] for s in sizes)
    again = {r.doc_id: r.taken for r in X.op5_entropy_mix(spark, SF_SMALL).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_rates_are_exponential_in_size_and_balanced(spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 23), "s" + str(i % 2)) for i in range(400)], "doc_id long, text string, source string")
    out = X.mix(rows, weights=(3.0, 1.0), share=1.0).collect()
    import math
    for s in ("s0", "s1"):
        mine = [r for r in out if r.source == s]
        assert sum(r.rate * r.size for r in mine) == pytest.approx(mine[0].target, rel=1e-5)
        tilt = {round(math.log(r.rate) / r.size, 9) for r in mine if r.rate < 2}
        assert max(tilt) - min(tilt) < 1e-6


def test_mix_of_odd_documents(spark, odd_documents, no_documents):
    out = X.mix(odd_documents).collect()
    assert len(out) == odd_documents.count()
    assert all(r.copies == 1 for r in out if r.size == 0) and {r.source for r in out} == {None, "a", "b", "c", "d"}
    mixed = X.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.count() == sum(r.copies for r in out)
    assert X.mix(no_documents).count() == 0 and X.mixed_documents(no_documents).count() == 0


def test_solver_raises_when_a_source_has_not_met_its_target(spark):
    from hazardframe.llm.common import spool
    sizes = spool(spark.createDataFrame([(f"0{s}", s, n) for s in "ab" for n in (3, 7, 40, 90, 500) * 4], "key string, source string, size long"), "solver-sizes")
    per = spool(X.source_targets(sizes), "solver-targets")
    cells = spool(sizes.groupBy("key", "size").agg(F.count("size").alias("docs")), "solver-cells")
    assert X.solve(cells, per).filter("done").count() == 2
    with pytest.raises(RuntimeError, match="1 sources"):
        X.solve(cells, per, max_steps=0)
