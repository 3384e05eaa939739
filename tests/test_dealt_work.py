"""Work that must not end up in one task, whatever the bytes of its input; each result held against plain Python."""

from __future__ import annotations

import tempfile
from collections import Counter
from pathlib import Path

from hazardframe.plans import catalog

_PART = "p_partkey long, p_name string, p_brand string, p_size int"


def _tables(spark, **tables):
    """A folder of tables, each in one file."""
    folder = tempfile.mkdtemp(prefix="hf-tables-")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def _swapped(key, name):
    i = key % max(len(name) - 1, 1)
    return name[:i] + name[i + 1:i + 2] + name[i:i + 1] + name[i + 2:]


def test_name_pairs_are_scored_in_many_tasks(spark):
    from hazardframe.functions.udfs import jaro_winkler_py
    names = ["red Bolt", "a", "", None, "Hot plate", "small widget"]
    rows = [(k, names[k % len(names)], "B", 1) for k in range(300)] + [(None, "red bolt", "B", 1), (7, "anvil", "B", 1)]
    df = catalog.QUERIES["jaro_winkler_pairs"](spark, _tables(spark, part=(rows, _PART)))
    want = Counter()
    for k, a, *_ in rows:
        for j, b, *_ in rows if k == 7 else [(k, a)]:
            if k is not None and j == k:
                want[k, None if a is None or b is None else jaro_winkler_py(a.lower(), _swapped(j, b).lower())] += 1
    assert Counter(map(tuple, df.collect())) == want
    sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= 8 and max(sizes) < 100


def test_look_up_of_frequent_names_is_dealt(spark):
    from hazardframe.sources import io as IO
    wanted = [(k, "often" if k % 5 else f"n{k}") for k in range(300)] + [(1, "often"), (1, None), (None, "often"), (9, "absent")]
    held = [(k, "often") for k in range(90)] + [(k, f"n{k}") for k in range(0, 300, 10)] + [(3, "often"), (None, "often"), (4, None), (5, "other")]
    table = IO.save_keyed_table(spark.createDataFrame(held, "CID long, Synonyms string"), "dealt_names", "Synonyms", 4, keep=False)
    frame = spark.createDataFrame(wanted, "p_partkey long, Synonyms string")
    want = Counter((n, k, c) for k, n in wanted for c, m in held if n is not None and n == m)
    for pairs in (500, 1 << 22, 1):
        df = IO.look_up_all(frame, table, "Synonyms", pairs).select("Synonyms", "p_partkey", "CID")
        assert Counter(map(tuple, df.collect())) == want
    sizes = IO.look_up_all(frame, table, "Synonyms", 500).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == sum(want.values()) and max(sizes) < sum(sizes) / 3


def test_shares_copy_rows_in_proportion_to_the_rows(spark):
    """Copies of rows are what a look-up shuffles; pairs of a key grow with the square of its rows."""
    from hazardframe.sources import io as IO

    def shuffled(counts, tasks):
        rows = IO.share_grid(spark.createDataFrame(counts, "Synonyms string, __n long, __m long"), tasks).collect()
        assert [(r["Synonyms"], r["__n"], r["__m"]) for r in rows] == counts
        for r in rows:
            assert 1 <= r["__across"] <= r["__n"] and 1 <= r["__down"] <= r["__m"]
        each = max(IO.PAIRS_DEALT, sum(n * m for _, n, m in counts) / (IO.SHARES_PER_TASK * tasks))
        assert all(-(-r["__n"] // r["__across"]) * -(-r["__m"] // r["__down"]) < 3 * each + r["__n"] + r["__m"] for r in rows)
        return sum(r["__n"] * r["__down"] + r["__m"] * r["__across"] for r in rows)

    for copies in (1, 60, 360, 3600):  # 64 names, 7.2 million part rows at 360 copies
        counts = [(f"n{k}", 312 * copies, 52 * copies) for k in range(64)]
        assert shuffled(counts, 32) <= 4 * sum(n + m for _, n, m in counts)
    assert shuffled([("all", 7_200_000, 1_200_000), ("few", 1, 2)], 32) < 20 * 8_400_000
    assert shuffled([("wide", 3, 1 << 40), ("tall", 1 << 40, 1), ("one", 1, 1)], 32) < 1 << 44
    assert shuffled([], 32) == 0


def test_look_up_on_a_grid_of_shares_gives_each_pair_once(spark, monkeypatch):
    from hazardframe.sources import io as IO
    wanted = [(k, "often" if k % 5 else f"n{k}") for k in range(300)] + [(1, "often"), (None, "often"), (9, None)]
    held = [(k, "often") for k in range(90)] + [(k, f"n{k}") for k in range(0, 300, 10)] + [(3, "often"), (None, "often"), (4, None)]
    table = IO.save_keyed_table(spark.createDataFrame(held, "CID long, Synonyms string"), "grid_names", "Synonyms", 4, keep=False)
    want = Counter((n, k, c) for k, n in wanted for c, m in held if n is not None and n == m)
    grids = []
    made = IO.share_grid
    monkeypatch.setattr(IO, "share_grid", lambda *a: grids.append(made(*a)) or grids[-1])
    for pairs in (1, 700):
        df = IO.look_up_all(spark.createDataFrame(wanted, "p_partkey long, Synonyms string"), table, "Synonyms", pairs)
        assert Counter(map(tuple, df.select("Synonyms", "p_partkey", "CID").collect())) == want
        often = grids[-1].filter("Synonyms = 'often'").first()
        assert often["__across"] > 1 and often["__down"] > 1


def test_part_names_are_looked_up_in_many_tasks(spark):
    rows = [(k, "hot plate" if k % 2 else "red bolt", "B", 1) for k in range(240)] + [(2, None, "B", 1), (None, "hot plate", "B", 1)]
    folder = _tables(spark, part=(rows, _PART), customer=([(1, "Hot plate"), (2, None)], "c_custkey long, c_name string"), supplier=([(1, "Red bolt")], "s_suppkey long, s_name string"))
    names = [(k, n[0].upper() + n[1:]) for k, n, *_ in rows if k is not None and n and k % 6 == 2] + [(1, "Hot plate"), (1, "Red bolt")]
    want = Counter((k, c, s) for k, n, *_ in rows if n for c, s in names if s == n[0].upper() + n[1:])
    assert Counter(map(tuple, catalog.QUERIES["keyed_by_name"](spark, folder).collect())) == want


def test_files_are_written_by_many_tasks_in_few_folders(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="hf-files-")
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: f"{folder}/{name}")
    rows = [(k, f"Supplier {k}") for k in range(1, 401)] + [(5, "twice"), (7, None), (None, "no id")]
    data = _tables(spark, supplier=(rows, "s_suppkey long, s_name string"))
    found = sorted(r.image_id for r in catalog.QUERIES["missing_files"](spark, data).collect())
    assert found == [f"{k:06d}" for k in range(1, 401) if k % 9 == 0 or k % 10 == 3]
    files = {p.name: p for p in Path(folder).rglob("*.txt")}
    kept = [k for k in range(1, 401) if k % 10 != 3 and k % 9]
    assert sorted(files) == sorted(f"id={k}.txt" for k in kept) and len({p.parent for p in files.values()}) < 70
    assert files["id=5.txt"].read_text() == "Supplier 5\ntwice\n" and files["id=7.txt"].read_text() == "\nSupplier 7\n"


def test_no_file_at_all_means_all_are_missing(spark):
    data = _tables(spark, supplier=([(3, "x"), (13, "y")], "s_suppkey long, s_name string"))
    assert catalog.QUERIES["missing_files"](spark, data).count() == 11  # 3 to 13


def test_shares_of_letters_are_read_in_many_tasks(spark):
    texts = ["Être ici, ÉTÉ", "", None, "eee\U0001F600e\n", "üñ nothing"]
    rows = [(k, texts[k % 5], "fr") for k in range(100)]
    df, cols = catalog._language_data(spark, _tables(spark, documents=(rows, "doc_id long, text string, lang string")))
    assert df.rdd.getNumPartitions() >= 4
    for r in df.collect():
        text = (texts[r.doc_id % 5] or "").lower()
        assert [r[c] for c in cols] == [100 * text.count(x) / max(len(text), 1) for x in catalog._LETTERS]
