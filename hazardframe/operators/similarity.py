"""Similarity join of query names against a name table.

Plan (equi-joins only; nothing passes through the driver but a letter table of bounded size):
  1. candidates: distinct lower-cased names, each with its smallest (key, name) - one
     aggregation with map-side combine, so a name held by a third of all rows is one row.
  2. exact hits (score 1.0) by an equi-join; those queries skip the rest (left_anti).
  3. pairs are told apart by p, the length of their common prefix (4 stands for 4 or more). With
     p a Jaro-Winkler value above t needs a Jaro value above (t - 0.1 p) / (1 - 0.1 p) = j, so with o the common
     letters (as a multiset) o/l1 + o/l2 > 3 j - 1. For p = 3 and 4 both sides meet on that prefix. For p = 0, 1, 2 they
     meet on the prefix and one of their rarest letters: a text of length l shares at least
     o_min letters with any partner, so the l - o_min + 1 rarest of its (letter, occurrence) tokens behind the
     prefix hold a common one; a pair is taken up where its first common one is.
     A prefix of 3 or 4 letters that many queries and names share is no filter any more: there both sides meet
     on the prefix, their two lengths and a few of their rarest letters together (``crowded_keys``).
  4. the length and letter bounds drop most of these pairs before the exact score.
  5. best per query = min(struct(-score, key, name)); the threshold is applied after the
     aggregate, so the score expression is evaluated once per pair.
All bounds are lossless; AQE splits crowded (prefix, letter) keys on either side of the inner joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.text import JW_PREFIX_CAP, JW_PREFIX_WEIGHT, jaro_winkler
from hazardframe.functions.udfs import jaro_winkler_udf
from hazardframe.session import checkpoint_dir

#: Letter tokens whose frequency orders them; any others come first, as rare ones.
ORDERED_TOKENS = 1024
SLACK = 1e-9  # bounds are loosened by this much, so rounding can only keep extra pairs
#: A prefix is crowded if that many pairs meet on it; then a text has up to MOST_KEYS keys per partner length.
CROWDED_PAIRS = 200_000
MOST_KEYS = 130
MOST_TOGETHER = 4


def jaro_floor(threshold: float, p: int) -> float:
    """The Jaro value that a pair with a common prefix of p letters must exceed."""
    boost = JW_PREFIX_WEIGHT * p
    return max((threshold - boost) / (1 - boost), min(threshold, 0.7))


def overlap_floor(threshold: float, p: int) -> float:
    """What o/l1 + o/l2 must exceed for such a pair (o: common letters)."""
    return 3 * jaro_floor(threshold, p) - 1 - SLACK


def name_candidates(names: DataFrame, key: str = "CID", name_col: str = "Synonyms") -> DataFrame:
    """Distinct lower-cased names with their smallest (key, name) as tie-break representative."""
    return (names.filter(F.col(name_col).isNotNull())
            .groupBy(F.lower(F.col(name_col)).alias("lname"))
            .agg(F.min(F.struct(F.col(key).alias("key"), F.col(name_col).alias("name"))).alias("rep")))


def _tokens(text: Column) -> Column:
    """The letters of a text with their occurrence number ('e1', 'e2', ...): a multiset as a set."""
    letters = F.split(text, "")
    letters = F.filter(letters, lambda c: c != "")
    return F.transform(letters, lambda c, i: F.concat(c, (F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c))).cast("string")))


def _sided(texts: DataFrame, text: str, rest: list[str], weights: Column) -> DataFrame:
    """text, length, letters, and per p from 0 to 4 the tokens behind the prefix from rare to frequent."""
    df = texts.select(F.col(text).alias("text"), *rest).filter(F.length("text") > 0)
    df = df.withColumn("n", F.length("text")).withColumn("tokens", _tokens(F.col("text")))

    def ordered(tokens):
        ranked = F.array_sort(F.transform(tokens, lambda t: F.struct(F.coalesce(F.try_element_at(weights, t), F.lit(0)).alias("f"), t.alias("t"))))
        return F.transform(ranked, lambda x: x["t"])

    return df.select("*", *[ordered(F.slice("tokens", p + 1, F.greatest(F.col("n") - p, F.lit(0)))).alias(f"t{p}") for p in range(JW_PREFIX_CAP + 1)])


def _letter_weights(cand: DataFrame) -> Column:
    """Map from token to its number of names, for the ORDERED_TOKENS most frequent tokens. Any fixed order of
    tokens finds all pairs; this one makes the lists short. The map comes to the driver: it is
    bounded by that number, and tokens outside it count as rare."""
    counts = cand.select(F.explode(_tokens(F.col("lname"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "t").limit(ORDERED_TOKENS).collect()
    if not top:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return F.map_from_arrays(F.array(*[F.lit(r["t"]) for r in top]), F.array(*[F.lit(int(r["n"])) for r in top]))


def _head(p: int) -> Column:
    return F.substring("text", 1, p) if p else F.lit("")


def length_plan(lengths: list[int], other: list[int], threshold: float, p: int) -> list[tuple[int, int, int, int]]:
    """(n, m, shared, together) for each pair of lengths that the length bound allows.

    Texts of lengths n and m with a common prefix of p letters that the letter bound allows share at least ``shared`` of
    their (letter, occurrence) tokens behind it. Then the first (n - p) - shared + k tokens of each, in one fixed order of all
    tokens, have k in common: at most shared - k of the common ones lie behind them. ``together`` is that k, the largest for which
    neither side has more than MOST_KEYS sets of k tokens."""
    floor = overlap_floor(threshold, p)
    out = []
    for n in lengths:
        for m in other:
            if min(n, m) <= (floor - 1) * max(n, m):
                continue
            shared = max(0, math.floor(floor * n * m / (n + m)) + 1 - p)
            if shared > min(n, m) - p:
                continue
            fits = [k for k in range(1, min(shared, MOST_TOGETHER) + 1) if math.comb(max(n, m) - p - shared + k, k) <= MOST_KEYS]
            out.append((n, m, shared, max(fits, default=min(shared, 1))))
    return out


def _sets(tokens: Column, k: int) -> Column:
    """All sets of k tokens of an array, each as one text, in the order of the array."""
    if k == 0:
        return F.array(F.lit(""))
    if k == 1:
        return tokens
    rest = lambda i: F.slice(tokens, i + 2, F.size(tokens))
    return F.flatten(F.transform(tokens, lambda t, i: F.transform(_sets(rest(i), k - 1), lambda u: F.concat(t, F.lit(" "), u))))


def crowded_keys(side: DataFrame, plan: DataFrame, own: str, partner: str, p: int) -> DataFrame:
    """A row per text, partner length and set of rarest tokens behind the prefix; ``side`` holds n and t<p>."""
    df = side.join(plan.select(F.col(own).alias("n"), F.col(own), F.col(partner), "shared", "together"), "n")
    first = F.slice(f"t{p}", 1, F.col("n") - p - F.col("shared") + F.col("together"))
    keys = F.when(F.col("together") == 0, _sets(first, 0))
    for k in range(1, MOST_TOGETHER + 1):
        keys = keys.when(F.col("together") == k, _sets(first, k))
    return df.withColumn("key", F.explode(keys)).drop("shared", "together")


def _crowded(q: DataFrame, c: DataFrame, p: int) -> DataFrame | None:
    """The heads of p letters that too many pairs meet on, or None. One count per head and side."""
    def heads(df, name):
        return df.filter(F.col("n") >= p).groupBy(_head(p).alias("head")).agg(F.count(F.lit(1)).alias(name))

    both = heads(q, "queries").join(heads(c, "names"), "head").filter(F.col("queries") * F.col("names") > CROWDED_PAIRS).select("head")
    both = both.checkpoint(eager=True)
    return None if both.isEmpty() else both


def _lengths(df: DataFrame, p: int) -> list[int]:
    return sorted(r["n"] for r in df.filter(F.col("n") >= p).select("n").distinct().collect())  # text lengths, not texts


def crowded_meetings(q: DataFrame, c: DataFrame, heads: DataFrame, threshold: float, p: int) -> DataFrame:
    """The rows on which both sides of crowded heads meet, before any bound; a pair may meet more than once."""
    q = q.filter(F.col("n") >= p).withColumn("head", _head(p)).join(heads, "head", "left_semi")
    c = c.filter(F.col("n") >= p).withColumn("head", _head(p)).join(heads, "head", "left_semi")
    rows = length_plan(_lengths(q, p), _lengths(c, p), threshold, p)
    plan = q.sparkSession.createDataFrame(rows, "nq int, nc int, shared int, together int")
    keyed = [crowded_keys(side.select("text", "n", "tokens", "head", f"t{p}", *[x for x in side.columns if x == "rep"]), plan, own, partner, p).drop(f"t{p}")
             for side, own, partner in ((q, "nq", "nc"), (c, "nc", "nq"))]
    left, right = keyed
    for x in ("text", "n", "tokens"):
        right = right.withColumnRenamed(x, f"{x}_c")
    return left.join(right, ["head", "nq", "nc", "key"]).select("text", "n", "tokens", "text_c", "n_c", "tokens_c", "rep")


def candidate_pairs(texts: DataFrame, cand: DataFrame, threshold: float) -> DataFrame:
    """(lq, lname, rep) pairs of different texts that the bounds allow; each pair once. Texts without letters have none."""
    weights = _letter_weights(cand)
    q = _sided(texts, "lq", [], weights)
    c = _sided(cand, "lname", ["rep"], weights)
    found = None
    for p in range(JW_PREFIX_CAP + 1):
        floor = overlap_floor(threshold, p)
        n, m = F.col("n"), F.col("n_c")
        crowded = _crowded(q, c, p) if p > 2 else None

        def side(df: DataFrame) -> DataFrame:
            df = df.filter(F.col("n") >= p).withColumn("head", _head(p))
            if p > 2:
                df = df if crowded is None else df.join(crowded, "head", "left_anti")
                return df.select("text", "n", "tokens", "head", *[x for x in df.columns if x == "rep"])
            # A partner has at least (floor - 1) n letters, and no partner of that size shares fewer.
            least = F.floor(n * (floor - 1)) + 1
            shared = F.floor(floor * n * least / (n + least)) + 1
            some = F.greatest(F.lit(0), F.least(F.size(f"t{p}"), (n - shared + 1).cast("int")))
            # Short texts may share the prefix alone: they also meet under a token of no letter.
            rare = F.slice(f"t{p}", 1, some)
            df = df.withColumn("rare", F.when(shared <= p, F.concat(F.array(F.lit("")), rare)).otherwise(rare))
            return df.select("text", "n", "tokens", "head", "rare", F.explode("rare").alias("token"), *[x for x in df.columns if x == "rep"])

        def bounded(pairs: DataFrame) -> DataFrame:
            pairs = pairs.filter(F.least(n, m) > (floor - 1) * F.greatest(n, m))
            if p < JW_PREFIX_CAP:  # the prefix ends here
                pairs = pairs.filter(F.expr(f"substring(text, {p + 1}, 1) <> substring(text_c, {p + 1}, 1)"))
            else:
                pairs = pairs.filter("text <> text_c")
            if p < 3:  # at their first common rare token
                pairs = pairs.filter(F.array_intersect("rare", "rare_c")[0] == F.col("token"))
            common = F.size(F.array_intersect("tokens", "tokens_c"))
            pairs = pairs.filter(common / n + common / m > floor)
            return pairs.select(F.col("text").alias("lq"), F.col("text_c").alias("lname"), "rep")

        left, right = side(q), side(c)
        for x in right.columns:
            if x not in ("head", "token", "rep"):
                right = right.withColumnRenamed(x, f"{x}_c")
        pairs = bounded(left.join(right, ["head", "token"] if p < 3 else "head"))
        if crowded is not None:
            pairs = pairs.unionByName(bounded(crowded_meetings(q, c, crowded, threshold, p)).distinct())
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _scored_texts(texts: DataFrame, cand: DataFrame, threshold: float, scorer: str, exact_first: bool) -> DataFrame:
    """(lq, lname, score, key, name) for distinct lower-cased query texts ``lq``."""
    if threshold <= 2 / 3:
        # At or below 2/3 no length bound exists and every pair is a candidate; that would be a cross
        # join, which this operator does not run.
        raise ValueError("the blocked similarity join needs a threshold above 2/3 (the reference uses 0.9)")
    texts, cand = texts.filter(F.length("lq") > 0), cand.filter(F.length("lname") > 0)
    exact = (texts.join(cand, texts["lq"] == cand["lname"], "inner")
             .select("lq", "lname", F.lit(1.0).alias("score"), F.col("rep.key").alias("key"),
                     F.col("rep.name").alias("name")))
    if exact_first:
        # Top-1 only: a text equal to a name cannot score higher elsewhere, so it skips the
        # fuzzy part. (All-pairs output keeps every text in the fuzzy part.)
        texts = texts.join(exact.select("lq"), "lq", "left_anti")
    pairs = candidate_pairs(texts, cand, threshold)
    score_fn = jaro_winkler_udf if scorer == "arrow" else jaro_winkler
    # Score through a generator so the threshold filter cannot be copied below it.
    scored = pairs.select("lq", "lname", "rep",
                          F.explode(F.array(score_fn(F.col("lname"), F.col("lq")))).alias("score"))
    fuzzy = (scored.filter(F.col("score") > threshold)
             .select("lq", "lname", "score", F.col("rep.key").alias("key"), F.col("rep.name").alias("name")))
    return exact.unionByName(fuzzy)


def _prepare(queries, names, qid, query_col, key, name_col, candidates):
    """Candidates, queries and distinct query texts. The candidate and text tables feed several joins each; a
    reliable checkpoint in the shared folder computes them once."""
    checkpoint_dir(names.sparkSession)
    cand = candidates if candidates is not None else name_candidates(names, key, name_col).checkpoint(eager=True)
    q = queries.select(F.col(qid).alias("qid"), F.col(query_col), F.lower(F.col(query_col)).alias("lq"))
    # Equal texts give equal results: score each distinct text once (a hot text held by a
    # third of the queries is one row here).
    texts = q.select("lq").filter(F.col("lq").isNotNull()).distinct().checkpoint(eager=True)
    return cand, q, texts


def similarity_pairs(queries: DataFrame, names: DataFrame, qid: str = "qid", query_col: str = "name",
                     key: str = "CID", name_col: str = "Synonyms", threshold: float = 0.9,
                     candidates: DataFrame | None = None, scorer: str = "arrow") -> DataFrame:
    """All (query, distinct lower-cased name) pairs with Jaro-Winkler > threshold; empty texts match nothing.

    ``scorer``: 'arrow' (batched pandas UDF, measured faster) or 'native' (Column expression).
    Columns: qid, lname, score, key, name (key/name = smallest holder of that lower-cased name).
    """
    cand, q, texts = _prepare(queries, names, qid, query_col, key, name_col, candidates)
    scored = _scored_texts(texts, cand, threshold, scorer, False)
    return q.select("qid", "lq").join(scored, "lq").select("qid", "lname", "score", "key", "name")


def best_match(queries: DataFrame, names: DataFrame, qid: str = "qid", query_col: str = "name",
               key: str = "CID", name_col: str = "Synonyms", threshold: float = 0.9,
               candidates: DataFrame | None = None, scorer: str = "arrow") -> DataFrame:
    """Best name per query (score desc, then key, then name); unmatched queries get NULLs.

    Columns: <qid>, <query_col>, <key>, <name_col>, score.
    """
    cand, q, texts = _prepare(queries, names, qid, query_col, key, name_col, candidates)
    scored = _scored_texts(texts, cand, threshold, scorer, True)
    best = (scored.groupBy("lq")
            .agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("key"), F.col("name"))).alias("b"))
            .select("lq", F.col("b.key").alias(key), F.col("b.name").alias(name_col),
                    (-F.col("b.neg")).alias("score")))
    return (q.join(best, "lq", "left")
            .select(F.col("qid").alias(qid), query_col, key, name_col, "score"))


def first_per_key(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """B12 in batch form: one deterministic row per key (smallest tuple of ``cols``)."""
    return (df.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in cols])).alias("__r"))
            .select(key, *[F.col(f"__r.{c}").alias(c) for c in cols]))


def annotate(matches: DataFrame, structures: DataFrame, annotations: DataFrame, key: str = "CID",
             structure_cols: list[str] | None = None, annotation_cols: list[str] | None = None) -> DataFrame:
    """C4: matched key -> first structure -> first annotation row; unmatched stay as NULL rows.

    The big tables are first semi-joined to the matched keys (a small, broadcastable set), so
    the per-key de-duplication only touches rows that can be used.
    """
    structure_cols = structure_cols or [c for c in structures.columns if c != key]
    annotation_cols = annotation_cols or [c for c in annotations.columns if c != key]
    # The matches feed three branches (main side and two key sets); a reliable checkpoint in the
    # shared checkpoint folder computes the similarity search once and cuts its lineage.
    checkpoint_dir(matches.sparkSession)
    matches = matches.checkpoint(eager=True)
    keys = matches.select(key).filter(F.col(key).isNotNull())
    s = first_per_key(structures.join(keys, key, "left_semi"), key, structure_cols)
    a = first_per_key(annotations.join(keys, key, "left_semi"), key, annotation_cols)
    return matches.join(s, key, "left").join(a, key, "left")
