"""The pipeline: every stage against brute force over what its predecessor kept."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from odd import SF_SMALL, no_documents, odd_documents, stored_odd_documents  # noqa: F401
from hazardframe.llm.common import documents, spool
from test_repeats_and_joins import _brute_components


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _run(spark, docs, name):
    columns, kept = docs.columns, {}
    for stage_name, stage in P.STAGES:
        docs = spool(stage(spark, docs, SF_SMALL), f"{name}-{stage_name}")
        kept[stage_name] = docs
        assert stage_name == "pack" or docs.columns == columns
    return kept


def _check(kept):
    """Every stage after the first against brute force; returns how many documents came out of each of them."""
    last = {}
    good = [(r.doc_id, r.text) for r in kept["quality"].collect()]
    for i, t in sorted(good, key=lambda r: (r[0] is not None, r)):
        last[_lower(t)] = (i, t)
    exact = sorted((r.doc_id, r.text) for r in kept["exact"].collect())
    assert [(i, _lower(t)) for i, t in exact] == sorted((i, t) for t, (i, _) in last.items())
    want = [i for i, _, c in _brute_components(exact) if i == c]
    assert sorted(r.doc_id for r in kept["near"].collect()) == sorted(want)
    mixed = [r.doc_id for r in kept["mix"].collect()]
    assert set(mixed) <= set(want) and max([mixed.count(i) for i in set(mixed)], default=0) <= 2
    packed = kept["pack"].collect()
    assert {r.doc_id for r in packed} == set(mixed) and sum(r.piece == 0 for r in packed) == len(mixed)
    return len(good), len(exact), len(want), len(mixed)


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    kept = _run(spark, spool(documents(spark, SF_SMALL), "pipeline-test"), "pipeline-test")
    good, *_ = _check(kept)
    assert 0.7 * 200 < good < 200 and all(len(r.text.split()) >= 50 for r in kept["quality"].collect())


def test_odd_and_empty_tables_pass_through(spark, odd_documents, no_documents):
    kept = _run(spark, odd_documents, "pipeline-odd")
    long_enough = {1, 2, 3, None}  # the others have less than 50 words, no text, or repeat one word
    assert {r.doc_id for r in kept["quality"].collect()} <= long_enough
    _check(kept)
    assert _check(_run(spark, no_documents, "pipeline-none")) == (0, 0, 0, 0)


def test_prose_with_repeated_rows_passes_through(spark):
    """Rows that repeat id and text, in upper case, and near copies, one of them without an id, beside a null text."""
    base = [r for r in documents(spark, SF_SMALL).filter("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame(base, documents(spark, SF_SMALL).schema)
    first = docs.filter(F.col("doc_id") == base[0].doc_id)
    docs = (docs.unionByName(docs.limit(20)).unionByName(docs.limit(10).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.upper("text")))
            .unionByName(docs.limit(10).withColumn("doc_id", F.col("doc_id") + 20_000).withColumn("text", F.concat("text", F.lit(" and so on"))))
            .unionByName(first.withColumn("text", F.lit(None).cast("string"))))
    good, exact, near, _ = _check(_run(spark, spool(docs, "pipeline-repeats"), "pipeline-repeats"))
    assert good > exact > near > 0


def test_equal_ids_and_texts_keep_the_same_row_in_every_run(spark):
    rows = [(1, "one two three four five six", "en", f"s{k}", k) for k in range(40)] + [(2, "ONE two three four five six", "en", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (P.exact, P.near):
        kept = [sorted(stage(spark, docs.repartition(n, "n_chars"), SF_SMALL).collect()) for n in (1, 3, 7)]
        assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1
