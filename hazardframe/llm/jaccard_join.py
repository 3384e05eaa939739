"""Operator 8, n-gram Jaccard join: size-aware, heavy and light sets apart.

A set holds the distinct word shingles of a document; two link when 100 * common >= PERCENT * union.

1. Tasks hash shingles and ship them in blocks as sorted arrays of 8 bytes a shingle (48 bits of hash, 16 of the
   document's number in its block), by hash range. Where a range is put together, shingles of one document only are
   dropped: they can't be common to two. The rest goes back to its block. A shingle that several documents of a block have is common
   already: its entries go straight to the block and one, without a document, to the range, so that a line in every document gives a
   range one entry per block. Documents with fewer than
   PERCENT % of their shingles left can't link and leave (``shared_shingles``).
2. Documents with equal sets become one class. Over classes, shingles are counted again, lone ones dropped, the
   rest ordered from rare to frequent (``_reduce``).
3. Light sets (up to ``boundary`` shingles) enumerate subsets of the sizes that a link needs: for sizes n <= m it needs
   t = ceil(PERCENT (n + m) / (100 + PERCENT)) common shingles, so linked light sets share a t-subset. Heavy sets scan the
   inverted lists of their rarest shingles (with n - ceil(PERCENT n / 100) + 1 of them, linked sets meet in a list); light sets near the boundary
   are listed too. The boundary is the size of least total cost, subsets against list entries to scan.
4. Classes that meet under a key are candidates. First each class is checked against the middle of its list, the member with the
   largest part of shingles shared with others, so a list of L near copies gives L checks and not L^2. Verified links form
   components; lists that lie in one component are done. Members of the others are checked against the middle m of the
   list's largest component, which also bounds every overlap: a and b share at most min(|a m|, |b m|) shingles of m and
   min(|a - m|, |b - m|) others. At last every pair across components is checked that sizes, shared shingles and this
   bound allow, from the members outside the list's largest component. So no link is lost, but pairs
   inside a component stay unlisted. Checks intersect the whole sets.

Hashes: sets and sizes use 64 bits, common shingles 48 bits: for two sets of 1000 shingles the chance that a common one is
invented is below 1 in 10^8.

Defined results: documents without words (null, empty or white space) have size 0, no links, and are their own component; ids are
compared as they are, null ids never are a component's id unless there is no other; repeated rows link like any equal texts; an empty table gives an
empty result; other columns are ignored by ``jaccard_components`` and carried by ``drop_near_copies``.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.llm.common import bounded_batches, documents, packed, row_hash, spool
from hazardframe.llm.components import components

PERCENT = 80
WORDS = 5
BLOCK_DOCS = (1 << 16) - 1  # the last number of 16 bits stands for no document
NONE = 0xFFFF
BLOCK_SHINGLES = 1 << 20
RANGE_SHINGLES = 1 << 20
MAX_BOUNDARY = 20
WORDS_HELD = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_HELD:
            self[word] = h
        return h


def shingles(text: str | None, hashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. Fewer words than a shingle: all of them as one."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    width = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * _STEP + h[k:k + n]
        for shift in (33, 29):
            out = (out ^ (out >> np.uint64(shift))) * _STEP
        out ^= out >> np.uint64(32)
    return np.unique(out)


def needed(n, percent: int = PERCENT):
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


# --- step 1: shingles that two documents have ---------------------------------------------------------------

def _ship(ranges: int, words: int):
    """Rows (range, block, postings, ids): sorted postings per range; the block's ids, sizes, classes and the postings of
    shingles that it has more than once as range -1 - block."""
    edges = (np.arange(1, ranges, dtype=np.float64) * (2.0 ** 64 / ranges)).astype(np.uint64)

    def run(batches):
        hashes, part, nth = _Hashes(), TaskContext.get().partitionId(), 0
        held, ids, sizes, classes, total = [], [], [], [], 0
        id_type = None

        def flush():
            block = (part << 24) | nth
            postings = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            again = np.zeros(len(postings), bool)  # the shingle of the entry before
            again[1:] = postings[1:] >> np.uint64(16) == postings[:-1] >> np.uint64(16)
            common = again.copy()
            common[:-1] |= again[1:]
            local = postings[common]
            postings = np.where(common, postings | np.uint64(NONE), postings)[~again]
            parts = np.split(postings, np.searchsorted(postings, edges))
            filled = [k for k, p in enumerate(parts) if len(p)]
            about = np.array(sizes, np.int64).tobytes() + b"".join(classes) + local.tobytes()
            keys = [*filled, -1 - block]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array([*[parts[k].tobytes() for k in filled], about], pa.binary()),
                 pa.array([*[None] * len(filled), ids], pa.list_(id_type))], ["range", "block", "postings", "ids"])

        for b in batches:
            id_type = b.column("id").type
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                s = shingles(text, hashes, words)
                held.append((s & ~np.uint64(0xFFFF)) | np.uint64(len(ids)))
                ids.append(key)
                sizes.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                total += len(s)
                if total >= BLOCK_SHINGLES or len(ids) == BLOCK_DOCS:
                    yield flush()
                    held, ids, sizes, classes, total, nth = [], [], [], [], 0, nth + 1
        if ids:
            yield flush()
    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one range: the postings whose shingle another document has too, per block."""
    if table.column("range")[0].as_py() < 0:
        return table.select(["block", "postings", "ids"])
    blocks = table.column("block").to_numpy()
    arrays = [np.frombuffer(p.as_py(), np.uint64) for p in table.column("postings")]
    postings, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays), dtype=np.int32), [len(a) for a in arrays])
    order = np.argsort(postings, kind="stable")
    ranked = postings[order] >> np.uint64(16)
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(ranked), bool)
    hit[1:] |= same
    hit[:-1] |= same
    kept = order[hit]
    kept = kept[postings[kept] & np.uint64(NONE) != NONE]  # the block has those already
    kept = kept[np.argsort(owner[kept], kind="stable")]
    cuts = np.searchsorted(owner[kept], np.arange(len(arrays) + 1))
    some = [k for k in range(len(arrays)) if cuts[k] < cuts[k + 1]]
    return pa.table({"block": pa.array(blocks[some], pa.int64()), "postings": pa.array([postings[kept[cuts[k]:cuts[k + 1]]].tobytes() for k in some], pa.binary()),
                     "ids": pa.nulls(len(some), table.schema.field("ids").type)})


def _documents_of(percent: int):
    """Of one block: row, id, n, class and, where a link is possible, the shared shingles of each document."""
    def run(table: pa.Table) -> pa.Table:
        mine = table.column("ids").is_valid().to_pylist().index(True)
        ids = table.column("ids")[mine].values
        n = len(ids)
        about = table.column("postings")[mine].as_py()
        sizes = np.frombuffer(about[:8 * n], np.int64)
        hits = [np.frombuffer(table.column("postings")[k].as_py(), np.uint64) for k in range(len(table)) if k != mine]
        hits = np.concatenate([np.frombuffer(about[24 * n:], np.uint64), *hits])
        doc = (hits & np.uint64(0xFFFF)).astype(np.int64)
        hits = (hits >> np.uint64(16)).astype(np.int64)[np.argsort(doc, kind="stable")]
        shared = np.bincount(doc, minlength=n)
        cuts = np.r_[0, np.cumsum(shared)]
        able = (shared >= needed(sizes, percent)) & (sizes > 0)
        tokens = [hits[cuts[k]:cuts[k + 1]] if able[k] else None for k in range(n)]
        block = table.column("block")[mine].as_py()
        return pa.table({"row": pa.array((block << 16) + np.arange(n), pa.int64()), "id": ids, "n": pa.array(sizes, pa.int64()),
                         "class": pa.array([about[8 * n + 16 * k:8 * n + 16 * k + 16] if sizes[k] else None for k in range(n)], pa.binary()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})
    return run


def shared_shingles(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """row, id, n, class, tokens (null where no link is possible) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, int(size // 6 // RANGE_SHINGLES) + 1)
    shipped = rows.mapInArrow(_ship(ranges, words), f"range long, block long, postings binary, ids array<{id_type}>")
    back = shipped.groupBy("range").applyInArrow(_repeated, f"block long, postings binary, ids array<{id_type}>")
    return spool(back.groupBy("block").applyInArrow(_documents_of(percent), f"row long, id {id_type}, n long, class binary, tokens array<long>"), "shingles")


# --- steps 2 and 3: classes, keys ---------------------------------------------------------------------------

def _reduce(found: DataFrame, percent: int) -> DataFrame:
    """One row per class that may link with another: row, class, n, q, tokens from rare to frequent."""
    able = found.filter("tokens is not null")
    first = able.groupBy("class").agg(F.min("row").alias("row"))
    reps = able.join(first.select("row"), "row", "left_semi").select("row", "class", "n", "tokens")
    tokens = reps.select("row", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    kept = tokens.join(often, "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("ft"))
    out = reps.drop("tokens").join(kept, "row").select("row", "class", "n", F.size("ft").cast("long").alias("q"), F.col("ft.f").alias("f"), F.col("ft.token").alias("tokens"))
    return spool(out.filter(F.col("q") * 100 >= percent * F.col("n")), "reduced")


def subset_sizes(n: int, percent: int = PERCENT, boundary: int | None = None) -> list[int]:
    """Sizes of common subsets that links of a set of n with sets of any allowed size (up to boundary) need."""
    top = min(n * 100 // percent, boundary or n * 100 // percent)
    return sorted({-(-percent * (n + m) // (100 + percent)) for m in range(max(1, needed(n, percent)), top + 1)} - {0})


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int = PERCENT, most: int = MAX_BOUNDARY) -> int:
    """The size x that costs least: subsets of the sets up to x, list entries scanned by the larger ones."""
    def light(n, x):
        return sum(comb(n, t) for t in subset_sizes(n, percent, x) if t <= n)

    def heavy(n):
        return (n - needed(n, percent) + 1) * (1 + list_length)

    rest = sum(c * heavy(n) for n, c in sizes.items())
    costs = {x: sum(c * light(n, x) for n, c in sizes.items() if n <= x) + rest - sum(c * heavy(n) for n, c in sizes.items() if n <= x) for x in range(most + 1)}
    return min(costs, key=lambda x: (costs[x], x))


def _keys(boundary: int, percent: int):
    """Rows (key, kind, row, n, q, heavy): kind 0 is a list of a shingle, kind t > 0 a subset of size t."""
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, n, q, tokens in zip(*(b.column(c).to_pylist() for c in ("row", "n", "q", "tokens"))):
                keys = []
                if n <= boundary:
                    for t in subset_sizes(n, percent, boundary):
                        if t <= q:
                            keys += [(xxhash.xxh3_64_intdigest(np.array(s, np.int64).tobytes()) >> 1, t) for s in combinations(sorted(tokens), t)]
                if n * 100 // percent > boundary:  # it may link with a heavy set
                    keys += [(k, 0) for k in tokens[:n - needed(n, percent) + 1 - (n - q)]]
                for x, v in zip(out, ([k for k, _ in keys], [t for _, t in keys], *([v] * len(keys) for v in (row, n, q, n > boundary)))):
                    x += v
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()])], ["key", "kind", "row", "n", "q", "heavy"])
    return run


# --- step 4: candidates and checks --------------------------------------------------------------------------

def _for_pair(kind):
    """Whether lists of this kind are there for the pair a and b: two light sets meet in subset lists only."""
    return (kind > 0) | F.col("heavy") | F.col("heavy_b")


def _may_link(percent: int):
    """Sizes and shared shingles allow a link of a and b, and their list is there for such pairs."""
    fits = F.least("q", "q_b") * (100 + percent) >= percent * (F.col("n") + F.col("n_b"))
    return fits & _for_pair(F.col("kind"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of common shingles of their whole sets and the sizes."""
    left = sets.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", common.cast("long").alias("common"), "n_a", "n_b")


def _linked(percent: int):
    return F.col("common") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))


def _check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by intersecting the whole sets."""
    return _overlaps(pairs, sets).filter(_linked(percent)).select("a", "b")


def _other(df: DataFrame, *names: str) -> DataFrame:
    for c in names:
        df = df.withColumnRenamed(c, f"{c}_b")
    return df


def _open_lists(keys: DataFrame, label: DataFrame) -> DataFrame:
    """Entries of the lists whose members lie in several components, with ``label`` and the list's largest component ``main``."""
    keys = keys.join(label, "row", "left").withColumn("label", F.coalesce("label", "row"))
    per = keys.groupBy("kind", "key", "label").agg(F.count(F.lit(1)).alias("members"))
    split = per.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("members", "label")).alias("main")).filter("labels > 1")
    return keys.join(split.select("kind", "key", F.col("main.label").alias("main")), ["kind", "key"])


def _middle(part):
    """Of several classes the one with the largest part of its shingles shared with others."""
    return F.max(F.struct(part.alias("part"), (-F.col("row")).alias("low"), "row", "n", "q", "heavy"))


def class_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """row, label: components of the classes that link with another one."""
    sizes = {r["n"]: r["c"] for r in sets.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("n") <= MAX_BOUNDARY).collect()}
    mean = sets.agg(F.avg(F.expr("aggregate(f, 0D, (s, x) -> s + x) / q"))).first()[0] or 0.0
    boundary = choose_boundary(sizes, mean, percent)
    keys = sets.select("row", "n", "q", "tokens").mapInArrow(_keys(boundary, percent), "key long, kind int, row long, n long, q long, heavy boolean")
    part = F.col("q") / F.col("n")
    # stars: every member of a list against its middle
    hubs = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("members"), _middle(part).alias("hub")).filter("members > 1")
    keys = spool(keys.join(hubs.select("kind", "key", "hub"), ["kind", "key"]), "join-keys")
    star = (keys.filter(F.col("row") != F.col("hub.row"))
            .select("kind", "row", "n", "q", "heavy", F.col("hub.row").alias("row_b"), F.col("hub.n").alias("n_b"), F.col("hub.q").alias("q_b"), F.col("hub.heavy").alias("heavy_b"))
            .filter(_may_link(percent)).select(F.least("row", "row_b").alias("a"), F.greatest("row", "row_b").alias("b")).distinct())
    links = spool(_check(star, sets, percent), "star-links")
    label = components(links).withColumnRenamed("node", "row")
    # lists still open: their members against the middle of the list's largest component
    lists = _open_lists(keys.drop("hub"), label)
    members = label.join(sets.select("row", "n", "q", F.lit(True).alias("heavy")), "row")
    middles = members.groupBy("label").agg(_middle(part)["row"].alias("middle")).withColumnRenamed("label", "main")
    lists = spool(lists.join(middles, "main", "left").withColumn("middle", F.coalesce("middle", "main")).drop("label", "main"), "open-lists")
    asked = lists.filter("row <> middle").select(F.col("row").alias("a"), F.col("middle").alias("b")).distinct()
    known = spool(_overlaps(asked, sets), "middle-overlaps")
    links = spool(links.unionByName(known.filter(_linked(percent)).select("a", "b")), "links-so-far")
    label = components(links).withColumnRenamed("node", "row")
    # what is left: all pairs across components that the sizes, the shared shingles and the overlaps with that middle allow
    common = known.select(F.col("a").alias("row"), F.col("b").alias("middle"), "common")
    lists = _open_lists(lists.join(common, ["row", "middle"], "left").withColumn("common", F.coalesce("common", "q")), label)
    lists = spool(lists, "open-pairs")
    # a pair is taken up in the first of the lists that are there for it and hold both; all of those are open, as its labels differ
    # (a list is one number here, its last bit says whether it is a subset's: intersecting arrays of numbers takes time in proportion to them)
    lists = lists.withColumn("list", F.shiftleft(F.xxhash64("kind", "key"), 1).bitwiseOR((F.col("kind") > 0).cast("long")))
    own = lists.groupBy("row").agg(F.collect_set("list").alias("own"))
    lists = lists.join(own, "row")
    few = lists.filter("label <> main")
    every = _other(lists.drop("main", "middle", "list"), "row", "n", "q", "heavy", "label", "common", "own")
    most = F.least("common", "common_b") + F.least(F.col("q") - F.col("common"), F.col("q_b") - F.col("common_b"))
    across = (few.join(every, ["kind", "key"]).filter(F.col("label") != F.col("label_b")).filter((F.col("label_b") == F.col("main")) | (F.col("row") < F.col("row_b")))
              .filter(_may_link(percent)).filter(most * (100 + percent) >= percent * (F.col("n") + F.col("n_b")))
              .filter(F.array_min(F.filter(F.array_intersect("own", "own_b"), lambda x: _for_pair(x.bitwiseAND(F.lit(1))))) == F.col("list"))
              .select(F.least("row", "row_b").alias("a"), F.greatest("row", "row_b").alias("b")).distinct())
    return components(links.unionByName(_check(across, sets, percent))).withColumnRenamed("node", "row")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """id, n, component (the least id reachable by links) of every row."""
    found = shared_shingles(docs, id_col, text_col, percent, words)
    sets = _reduce(found, percent)
    label = class_links(sets, percent).join(sets.select("row", "class"), "row").select("class", "label")
    least = found.filter("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    named = least.join(label, "class", "left")
    per_label = named.filter("label is not null").groupBy("label").agg(F.min("least").alias("lowest"))
    named = spool(named.join(per_label, "label", "left").select("class", F.coalesce("lowest", "least").alias("component")), "classes")
    out = found.select("id", "n", "class").join(named, "class", "left")
    return out.select("id", "n", F.coalesce("component", "id").alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that with the least id, with all its columns."""
    rows = packed(docs).withColumn("key", F.struct(F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(f"row.`{text_col}`").alias("mark")))
    found = jaccard_components(rows.select("key", F.col(f"row.`{text_col}`").alias("text")), "key", "text", **options)
    stay = found.filter(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id.id").alias("i"), F.col("id.mark").alias("m")).distinct()
    rows = rows.join(stay, F.col("key.id").eqNullSafe(F.col("i")) & F.col("key.mark").eqNullSafe(F.col("m")))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("i", "m").orderBy(row_hash()))).filter("nth = 1").select("row.*")


def op8_jaccard_join(spark, sf_dir):
    """doc_id, n_shingles, component_id for every row of documents."""
    found = jaccard_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, min(a.n) AS nx, min(b.n) AS ny
      FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM s UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.d)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT d, min(m) AS component_id FROM r GROUP BY d) c ON c.d = s.doc_id
"""
