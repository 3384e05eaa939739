"""Registered queries: one per operator row of the blueprint, each over whole driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name]`` (DuckDB, same column
names). Queries are grouped by the module that implements the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.functions.text import jaro_winkler
from hazardframe.operators import names as N
from hazardframe.operators import similarity as S
from hazardframe.plans import oracle_rules as OR
from hazardframe.plans import standins as T
from hazardframe.session import dealt_partitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ============================== names: prune / semi-join ======================================

_KEPT_SQL = f"SELECT CID, Synonyms FROM ({T.SYNONYMS_SQL}) s WHERE NOT {OR.is_identifier_sql('Synonyms')}"


@register("prune_names", _KEPT_SQL)
def q_prune_names(spark, d):
    return N.prune_names(T.synonyms(spark, d))


@register("prune_reasons", f"""
SELECT coalesce({OR.identifier_reason_sql('Synonyms')}, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n
FROM ({T.SYNONYMS_SQL}) s GROUP BY 1""")
def q_prune_reasons(spark, d):
    return N.prune_reasons(T.synonyms(spark, d))


@register("drop_audit", f"""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(sum(CASE WHEN {OR.is_identifier_sql('Synonyms')} THEN 0 ELSE 1 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN {OR.is_identifier_sql('Synonyms')} THEN 1 ELSE 0 END) AS BIGINT) AS dropped
FROM ({T.SYNONYMS_SQL}) s""")
def q_drop_audit(spark, d):
    return N.drop_audit(T.synonyms(spark, d))


@register("semi_join_keys", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
WHERE l_partkey IN (SELECT CID FROM ({_KEPT_SQL}) k)""")
def q_semi_join_keys(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    kept = N.prune_names(T.synonyms(spark, d))
    return N.semi_filter(li, kept, key="l_partkey", keys_key="CID")


# ============================== similarity join ===============================================

_CAND_SQL = f"""
SELECT lname, CID, Synonyms FROM (
  SELECT lower(Synonyms) AS lname, CID, Synonyms,
         row_number() OVER (PARTITION BY lower(Synonyms) ORDER BY CID, Synonyms) AS rn
  FROM ({_KEPT_SQL}) k WHERE Synonyms IS NOT NULL) WHERE rn = 1 AND length(lname) > 0"""

_PAIRS_SQL = f"""
SELECT q.qid, c.lname, c.CID, c.Synonyms, jaro_winkler_similarity(c.lname, lower(q.name)) AS score
FROM ({T.MISSPELT_SQL}) q, ({_CAND_SQL}) c
WHERE jaro_winkler_similarity(c.lname, lower(q.name)) > 0.9"""

_TOP1_SQL = f"""
SELECT q.qid, q.name, b.CID, b.Synonyms, b.score
FROM ({T.MISSPELT_SQL}) q LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CID, Synonyms) AS rn
                 FROM ({_PAIRS_SQL}) p) WHERE rn = 1) b ON q.qid = b.qid"""


def _top1(spark, d):
    kept = N.prune_names(T.synonyms(spark, d))
    return S.best_match(T.misspelt_names(spark, d), kept, threshold=0.9)


@register("fuzzy_top1", _TOP1_SQL)
def q_fuzzy_top1(spark, d):
    return _top1(spark, d)


@register("fuzzy_join", f"SELECT qid, lname, score FROM ({_PAIRS_SQL}) p")
def q_fuzzy_join(spark, d):
    kept = N.prune_names(T.synonyms(spark, d))
    return S.similarity_pairs(T.misspelt_names(spark, d), kept, threshold=0.9).select("qid", "lname", "score")


@register("jaro_winkler_pairs", f"""
SELECT p.p_partkey, jaro_winkler_similarity(lower(p.p_name), lower(q.name)) AS score
FROM part p JOIN ({T.MISSPELT_SQL}) q ON p.p_partkey = q.qid""")
def q_jaro_winkler_pairs(spark, d):
    part = T.table(spark, d, "part").select("p_partkey", "p_name")
    q = T.misspelt_names(spark, d)
    # The join may run in one task (a broadcast beside a table of one split); the pairs are dealt to all before they are scored.
    pairs = part.join(q, part["p_partkey"] == q["qid"]).select("p_partkey", "p_name", "name").repartition(dealt_partitions(spark))
    return pairs.select("p_partkey", jaro_winkler(F.lower("p_name"), F.lower("name")).alias("score"))


@register("annotate_names", f"""
SELECT t.qid, t.name, t.CID, t.Synonyms, t.score, s.SMILES, a.Categories, a.Route, a.avg_price
FROM ({_TOP1_SQL}) t
LEFT JOIN (SELECT CID, min(SMILES) AS SMILES FROM ({T.STRUCTURES_SQL}) x GROUP BY CID) s ON t.CID = s.CID
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CID ORDER BY Categories, Route, avg_price) rn
                          FROM ({T.ANNOTATIONS_SQL}) y) WHERE rn = 1) a ON t.CID = a.CID""")
def q_annotate_names(spark, d):
    top = _top1(spark, d)
    out = S.annotate(top, T.structures(spark, d), T.annotations(spark, d), key="CID")
    return out.select("qid", "name", "CID", "Synonyms", "score", "SMILES", "Categories", "Route", "avg_price")


# ============================== recognised-text scoring ======================================

from hazardframe.functions import text as TX  # noqa: E402
from hazardframe.operators import ocr as O  # noqa: E402
from hazardframe.plans import oracle_text as OT  # noqa: E402

_ENGINES_SQL = "(VALUES (0, 'paddleocr'), (1, 'doctr'), (2, 'tesseract')) e(engine_idx, engine)"
_CELLS_SQL = f"""
SELECT t.image_id, e.engine, e.engine_idx, r.text AS pred, r.time, r.image_id IS NOT NULL AS ran, t.text AS truth
FROM ({T.OCR_TRUTH_SQL}) t CROSS JOIN {_ENGINES_SQL}
LEFT JOIN ({T.OCR_RUNS_SQL}) r ON r.image_id = t.image_id AND r.engine = e.engine"""
_METRICS_SQL = f"""
SELECT image_id, engine, engine_idx,
  CASE WHEN ran AND truth IS NOT NULL AND truth <> '' THEN {OT.error_rate_sql("coalesce(pred, '')", 'truth', 'char')} END AS cer,
  CASE WHEN ran AND truth IS NOT NULL AND truth <> '' THEN {OT.error_rate_sql("coalesce(pred, '')", 'truth', 'word')} END AS wer,
  CASE WHEN ran THEN time END AS time
FROM ({_CELLS_SQL}) c"""


def _ocr(spark, d):
    return O.evaluate_runs(T.ocr_runs(spark, d), T.ocr_truth(spark, d))


@register("ocr_eval", _METRICS_SQL)
def q_ocr_eval(spark, d):
    return _ocr(spark, d)[0]


@register("ocr_eval_missing", f"""
SELECT image_id, engine, engine_idx,
  CASE WHEN ran THEN {OT.normalize_sql("coalesce(pred, '')")} ELSE '' END AS predicted_text,
  {OT.normalize_sql('truth')} AS actual_text
FROM ({_CELLS_SQL}) c""")
def q_ocr_eval_missing(spark, d):
    return _ocr(spark, d)[1]


def _mean_sql(c):
    return OT.round_ratio_sql(f"sum(CAST(round({c} * 10000) AS BIGINT))", f"count({c}) * 10000")


@register("ocr_summary", f"""
SELECT e.engine, e.engine_idx, a.avg_cer, a.avg_wer, a.avg_time
FROM {_ENGINES_SQL} LEFT JOIN (
  SELECT engine, {_mean_sql('cer')} AS avg_cer, {_mean_sql('wer')} AS avg_wer, {_mean_sql('time')} AS avg_time
  FROM ({_METRICS_SQL}) m WHERE time IS NOT NULL GROUP BY engine) a ON a.engine = e.engine""")
def q_ocr_summary(spark, d):
    return O.summarize(_ocr(spark, d)[0])


@register("normalize_text", f"""
SELECT doc_id, {OT.normalize_sql('text')} AS norm_text FROM documents""")
def q_normalize_text(spark, d):
    return T.table(spark, d, "documents", spread=True).select("doc_id", TX.normalize_text("text").alias("norm_text"))


_GAP = "\ue000"  # a character that no document holds
_ALTERED_SQL = f"replace(text, 'the', 'th' || chr({ord(_GAP)}))"
_WORDS_SQL = f"string_split({OT.normalize_sql('text')}, ' ')"
_WRONG_WORDS_SQL = f"len(list_filter(string_split({OT.normalize_sql(_ALTERED_SQL)}, ' '), lambda w: contains(w, chr({ord(_GAP)}))))"


@register("long_error_rates", f"""
SELECT doc_id, {OT.round_ratio_sql("edits", "n_chars")} AS cer, {OT.round_ratio_sql("wrong", "n_words")} AS wer FROM (
  SELECT doc_id, CAST(length({_ALTERED_SQL}) - length(replace({_ALTERED_SQL}, chr({ord(_GAP)}), '')) AS BIGINT) AS edits,
    CAST(length({OT.normalize_sql('text')}) AS BIGINT) AS n_chars, CAST({_WRONG_WORDS_SQL} AS BIGINT) AS wrong, CAST(len({_WORDS_SQL}) AS BIGINT) AS n_words
  FROM documents WHERE text <> '') x""")
def q_long_error_rates(spark, d):
    """Error rates of all documents against a copy in which one letter of every "the" is a character that no text holds. Each of these
    characters and words has to be changed, so their numbers are the edit distances, at any length."""
    docs = T.table(spark, d, "documents", spread=True).filter("text <> ''")
    altered = F.replace(F.col("text"), F.lit("the"), F.lit("th" + _GAP))
    return O.error_rates(docs.select("doc_id", "text", altered.alias("read")), "read", "text").select("doc_id", "cer", "wer")


@register("missing_files", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS image_id FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 10 = 3""")
def q_missing_files(spark, d):
    """A folder of files per supplier: some are never written, some removed afterwards; the expected ids without a file."""
    path = scratch_path(spark, "images")
    suppliers = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    ends = suppliers.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).first()
    written = suppliers.filter("id % 10 <> 3").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.coalesce("s_name", F.lit("")))), "\n").alias("text"))
    part = F.when(F.col("id") % 9 == 0, "removed").otherwise("kept")
    group = F.pmod(F.xxhash64("id"), F.lit(ends["n"] // 1000 + 64))  # folders of about 1000 files are listed by many tasks
    IO.write_files(written.select(F.concat(F.lit("part="), part, F.lit("/group="), group, F.lit("/id="), "id", F.lit(".txt")).alias("name"), F.concat("text", F.lit("\n")).alias("text")), path)
    removed = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=removed")
    removed.getFileSystem(spark._jsc.hadoopConfiguration()).delete(removed, True)
    return O.missing_files(spark, path, ends["lo"], ends["hi"], 6, "*.txt", r"/id=([0-9]+)\.txt$")


@register("missing_keys", """
SELECT CASE WHEN length(CAST(k AS VARCHAR)) >= 6 THEN CAST(k AS VARCHAR) ELSE lpad(CAST(k AS VARCHAR), 6, '0') END AS image_id
FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders)) t(k)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k)""")
def q_missing_keys(spark, d):
    hi = T.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    li = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    return O.missing_keys(spark, li, "image_id", 0, int(hi), width=6)


@register("json_map_explode", """
SELECT event_id, je.key AS key, CAST(je.value AS VARCHAR) AS value FROM events, json_each(props) je""")
def q_json_map_explode(spark, d):
    ev = T.table(spark, d, "events").select("event_id", "props")
    return ev.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


# ============================== domain rules =================================================

from hazardframe.functions import rules as RU  # noqa: E402


@register("classify_first_match", f"""
SELECT o_orderkey, {OR.classify_first_match_sql('text')} AS hazard_class FROM ({T.HAZARD_TEXTS_SQL}) h""")
def q_classify_first_match(spark, d):
    return T.hazard_texts(spark, d).select("o_orderkey", RU.classify_first_match("text").alias("hazard_class"))


@register("classify_documents", f"""
SELECT doc_id, {OR.classify_first_match_sql('text')} AS hazard_class FROM documents""")
def q_classify_documents(spark, d):
    docs = T.table(spark, d, "documents", spread=True).select("doc_id", "text")
    return docs.select("doc_id", RU.classify_first_match("text").alias("hazard_class"))


_CLASSES_SQL = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(RU.CARCINOGENICITY_CLASSES)) + \
    ") k(class_idx, hazard_class)"


@register("class_counts", f"""
SELECT k.hazard_class, k.class_idx, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM {_CLASSES_SQL} LEFT JOIN (
  SELECT {OR.classify_first_match_sql('text')} AS hazard_class, count(*) AS n
  FROM ({T.HAZARD_TEXTS_SQL}) h WHERE text IS NOT NULL GROUP BY 1) c ON c.hazard_class = k.hazard_class""")
def q_class_counts(spark, d):
    from hazardframe.operators import labels as L
    return L.class_counts(T.hazard_texts(spark, d), "text", RU.classify_first_match, RU.CARCINOGENICITY_CLASSES)


@register("class_value_counts", f"""
SELECT hazard_class, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS display_text,
       CAST(n AS BIGINT) AS n, CAST(n_distinct AS BIGINT) AS n_distinct
FROM (SELECT hazard_class, text, n, count(*) OVER (PARTITION BY hazard_class) AS n_distinct
      FROM (SELECT {OR.classify_first_match_sql('text')} AS hazard_class, text, count(*) AS n
            FROM ({T.HAZARD_TEXTS_SQL}) h WHERE text IS NOT NULL GROUP BY 1, 2) g) x""")
def q_class_value_counts(spark, d):
    from hazardframe.operators import labels as L
    return L.class_value_counts(T.hazard_texts(spark, d), "text", RU.classify_first_match)


@register("normalize_route", f"""
SELECT l_orderkey, l_linenumber,
  array_to_string({OR.normalize_routes_sql(OR.parse_list_text_sql('route_text'))}, '|') AS routes
FROM ({T.ROUTE_TEXTS_SQL}) r""")
def q_normalize_route(spark, d):
    r = T.route_list_texts(spark, d)
    return r.select("l_orderkey", "l_linenumber",
                    F.array_join(RU.normalize_routes(TX.parse_list_text("route_text")), "|").alias("routes"))


@register("parse_list_text", f"""
SELECT l_orderkey, l_linenumber, len({OR.parse_list_text_sql('route_text')}) AS n_items,
  array_to_string({OR.parse_list_text_sql('route_text')}, chr(1)) AS items
FROM ({T.ROUTE_TEXTS_SQL}) r""")
def q_parse_list_text(spark, d):
    r = T.route_list_texts(spark, d)
    items = TX.parse_list_text("route_text")
    return r.select("l_orderkey", "l_linenumber", F.size(items).cast("long").alias("n_items"),
                    F.array_join(items, "\u0001").alias("items"))


@register("split_lists", f"""
SELECT doc_id, len({OR.split_list_sql('text', '.')}) AS n_items,
  array_to_string({OR.split_list_sql('text', '.')}, chr(1)) AS items FROM documents""")
def q_split_lists(spark, d):
    docs = T.table(spark, d, "documents", spread=True)
    items = TX.split_list("text", ".")
    return docs.select("doc_id", F.size(items).cast("long").alias("n_items"), F.array_join(items, "\u0001").alias("items"))


@register("route_sentences", f"""
SELECT doc_id, array_to_string({OR.normalize_routes_sql(OR.split_list_sql('text', '.'))}, '|') AS routes
FROM documents""")
def q_route_sentences(spark, d):
    docs = T.table(spark, d, "documents", spread=True)
    return docs.select("doc_id", F.array_join(RU.normalize_routes(TX.split_list("text", ".")), "|").alias("routes"))


# ============================== cleaning =====================================================

from hazardframe.operators import clean as CL  # noqa: E402
from hazardframe.plans.oracle_rules import strip_sql  # noqa: E402


def _docs_labels(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = T.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(lab, "doc_id", "left")


@register("clean_table", f"""
SELECT {strip_sql('lang')} AS lang, {strip_sql('source')} AS source,
       regexp_replace({strip_sql('text')}, '[\\r\\n]+', ' ', 'g') AS text, quality
FROM (SELECT DISTINCT d.lang, d.source, d.text, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) x""")
def q_clean_table(spark, d):
    df = _docs_labels(spark, d)
    out, _report = CL.clean_table(df, keep_columns=["lang", "source", "text", "quality", "no_such_column"],
                                  fill=False, newline_to_space_columns=["text"])
    return out


@register("dedupe_rows", "SELECT DISTINCT text, lang FROM documents")
def q_dedupe_rows(spark, d):
    return CL.dedupe(T.table(spark, d, "documents").select("text", "lang"))


_IMPUTE_BASE = """SELECT d.doc_id, l.quality, l.toxic, CASE WHEN d.doc_id % 3 > 0 THEN CAST(d.n_chars AS DOUBLE) END AS chars,
  CASE l.toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END AS tag FROM documents d LEFT JOIN labels l USING (doc_id)"""


@register("impute_mean_mode", f"""
WITH b AS ({_IMPUTE_BASE})
SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM b)) AS quality,
       coalesce(CAST(toxic AS DOUBLE), (SELECT avg(toxic) FROM b)) AS toxic,
       round(coalesce(chars, (SELECT avg(chars) FROM b)), 6) AS chars,
       coalesce(tag, (SELECT tag FROM b WHERE tag IS NOT NULL GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1)) AS tag
FROM b""")
def q_impute_mean_mode(spark, d):
    # Of the missing character counts a part is NULL, a part NaN: both are gaps.
    third = F.pmod(F.col("doc_id"), F.lit(3))
    chars = F.when(third > 0, F.col("n_chars").cast("double")).when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.lit(float("nan")))
    df = _docs_labels(spark, d).select(
        "doc_id", "quality", "toxic", chars.alias("chars"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("tag"))
    return CL.fill_missing(df, ["quality", "toxic", "chars", "tag"]).withColumn("chars", F.round("chars", 6))


_KEY_TEXT_SQL = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 25 = 0 THEN CAST(9007199254740993 + event_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END
  WHEN 1 THEN CAST(user_id AS VARCHAR) || '.0' WHEN 2 THEN CAST(user_id AS VARCHAR) || '.5'
  WHEN 3 THEN (CASE event_id % 4 WHEN 0 THEN 'x' || CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) || 'd'
    WHEN 2 THEN '0x' || CAST(user_id AS VARCHAR) || 'p4' ELSE CAST(user_id AS VARCHAR) || 'f' END)
  ELSE CAST(user_id AS VARCHAR) || 'e1' END AS raw FROM events"""


@register("coerce_key", f"""
SELECT event_id, raw, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN TRY_CAST(raw AS BIGINT) WHEN NOT regexp_matches(raw, '[dfxp]') AND TRY_CAST(raw AS DOUBLE) IS NOT NULL AND isfinite(TRY_CAST(raw AS DOUBLE))
  AND TRY_CAST(raw AS DOUBLE) = floor(TRY_CAST(raw AS DOUBLE)) THEN CAST(TRY_CAST(raw AS DOUBLE) AS BIGINT) END AS cid
FROM ({_KEY_TEXT_SQL}) k""")
def q_coerce_key(spark, d):
    ev = T.table(spark, d, "events")
    u = F.col("user_id").cast("string")
    m, q = F.pmod(F.col("event_id"), F.lit(5)), F.pmod(F.col("event_id"), F.lit(4))
    large = F.lit(9007199254740993) + F.col("event_id")  # beyond 2^53: a double would change its last digits
    raw = (F.when(F.pmod("event_id", F.lit(25)) == 0, large.cast("string")).when(m == 0, u).when(m == 1, F.concat(u, F.lit(".0"))).when(m == 2, F.concat(u, F.lit(".5")))
           .when(m == 3, F.when(q == 0, F.concat(F.lit("x"), u)).when(q == 1, F.concat(u, F.lit("d")))
                 .when(q == 2, F.concat(F.lit("0x"), u, F.lit("p4"))).otherwise(F.concat(u, F.lit("f"))))
           .otherwise(F.concat(u, F.lit("e1"))))
    return ev.select("event_id", raw.alias("raw")).select("event_id", "raw", CL.coerce_key("raw").alias("cid"))


@register("clip_features", """
SELECT event_id, least(greatest(value * 1e14::DOUBLE * CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END,
       -1e15::DOUBLE), 1e15::DOUBLE) AS clipped FROM events""")
def q_clip_features(spark, d):
    ev = T.table(spark, d, "events")
    x = F.col("value") * F.lit(1e14) * F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return ev.select("event_id", CL.clip(x).alias("clipped"))


@register("safe_names", """
SELECT p_partkey, translate(p_type || '/' || p_brand || ' ' || p_name, ' /', '__') AS safe_name FROM part""")
def q_safe_names(spark, d):
    p = T.table(spark, d, "part")
    return p.select("p_partkey", TX.safe_name(F.concat_ws("", "p_type", F.lit("/"), "p_brand", F.lit(" "), "p_name"))
                    .alias("safe_name"))


# Category order of the stand-in report (like a fixed model order).
SEGMENT_ORDER = ["MACHINERY", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


@register("custom_order", f"""
SELECT c_custkey, c_nationkey, c_mktsegment,
  CAST(list_position([{", ".join("'" + s + "'" for s in SEGMENT_ORDER)}], c_mktsegment) AS BIGINT) AS seg_order FROM customer""")
def q_custom_order(spark, d):
    from hazardframe.operators.labels import rank_in_order
    c = T.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (c.withColumn("seg_order", rank_in_order(F.col("c_mktsegment"), SEGMENT_ORDER))
            .orderBy("c_nationkey", "seg_order", "c_custkey"))


@register("sentinel_filter", """
SELECT doc_id, tag FROM (SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'No data' END AS tag
  FROM documents d LEFT JOIN labels l USING (doc_id)) x WHERE tag IS DISTINCT FROM 'No data'""")
def q_sentinel_filter(spark, d):
    df = _docs_labels(spark, d).select(
        "doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "No data").alias("tag"))
    return df.filter(CL.not_sentinel("tag"))


# ============================== metrics ======================================================

from hazardframe.operators import labels as LB  # noqa: E402
from hazardframe.operators import metrics as M  # noqa: E402


def _r(df, cols, digits=12):
    """Round floating results for the cross-engine check (sums of floats may differ in the
    last bit between engines); the operators themselves return full precision."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _rs(x, digits=12):
    return f"round({x}, {digits})"


def _per_class_sql(pred_sql: str) -> str:
    return f"""
WITH p AS ({pred_sql}),
cells AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction),
t AS (SELECT label AS class, sum(n) AS support FROM cells GROUP BY 1),
pp AS (SELECT prediction AS class, sum(n) AS predicted FROM cells GROUP BY 1),
tp AS (SELECT label AS class, n AS tp FROM cells WHERE label = prediction),
pc0 AS (SELECT coalesce(t.class, pp.class) AS class, coalesce(t.support, 0) AS support,
               coalesce(pp.predicted, 0) AS predicted FROM t FULL JOIN pp ON t.class = pp.class),
pc AS (SELECT pc0.class, CAST(coalesce(tp.tp, 0) AS BIGINT) AS tp, CAST(support AS BIGINT) AS support,
              CAST(predicted AS BIGINT) AS predicted FROM pc0 LEFT JOIN tp ON tp.class = pc0.class),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
             CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM pc)"""


@register("clf_weighted_metrics", _per_class_sql(T.predictions_sql()) + f"""
SELECT {_rs('sum(tp) / sum(support)')} AS accuracy, {_rs('sum(precision * support) / sum(support)')} AS precision_weighted,
       {_rs('sum(recall * support) / sum(support)')} AS recall_weighted, {_rs('sum(f1 * support) / sum(support)')} AS f1_weighted
FROM m""")
def q_clf_weighted_metrics(spark, d):
    out = M.weighted_metrics(T.predictions(spark, d))
    return _r(out, out.columns)


_REPORT_SQL = f"""
SELECT class AS row, {_rs('precision')} AS precision, {_rs('recall')} AS recall, {_rs('f1')} AS f1,
       CAST(support AS DOUBLE) AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, {_rs('sum(tp) / sum(support)')}, CAST(sum(support) AS DOUBLE) FROM m
UNION ALL SELECT 'macro avg', {_rs('avg(precision)')}, {_rs('avg(recall)')}, {_rs('avg(f1)')}, CAST(sum(support) AS DOUBLE) FROM m
UNION ALL SELECT 'weighted avg', {_rs('sum(precision * support) / sum(support)')}, {_rs('sum(recall * support) / sum(support)')},
       {_rs('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS DOUBLE) FROM m"""


@register("clf_report", _per_class_sql(T.predictions_sql()) + _REPORT_SQL)
def q_clf_report(spark, d):
    return _r(M.classification_report(T.predictions(spark, d)), ["precision", "recall", "f1"])


@register("confusion_matrix", f"""
WITH p AS ({T.predictions_sql()}), c AS (SELECT label AS c FROM p UNION SELECT prediction FROM p)
SELECT a.c AS label, b.c AS prediction,
  CAST((SELECT count(*) FROM p WHERE p.label = a.c AND p.prediction = b.c) AS BIGINT) AS n FROM c a, c b""")
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(T.predictions(spark, d))


@register("union_tagged", f"""
SELECT 'by_length' AS Model, * FROM ({_per_class_sql(T.predictions_sql('by_length')) + _REPORT_SQL}) a
UNION ALL SELECT 'by_lang' AS Model, * FROM ({_per_class_sql(T.predictions_sql('by_lang')) + _REPORT_SQL}) b""")
def q_union_tagged(spark, d):
    frames = {m: _r(M.classification_report(T.predictions(spark, d, m)), ["precision", "recall", "f1"])
              for m in ("by_length", "by_lang")}
    return M.tag_union(frames, "Model")


def _classes_df(spark):
    return spark.createDataFrame([(c,) for c in T.MULTILABEL_CLASSES], "label string")


_CLASSES_VALUES = "(VALUES " + ", ".join(f"('{c}')" for c in T.MULTILABEL_CLASSES) + ") k(label)"
_LABEL_COUNTS_SQL = f"""
WITH r AS ({T.MULTILABEL_SQL}),
cells AS (SELECT u.label, list_contains(r.truth, u.label) AS t, list_contains(r.predicted, u.label) AS p
          FROM r, unnest(list_distinct(list_concat(r.truth, r.predicted))) u(label)),
c AS (SELECT label, sum(CASE WHEN t AND p THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT t THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS fn FROM cells GROUP BY label),
lc AS (SELECT k.label, CAST(coalesce(c.tp, 0) AS BIGINT) AS tp, CAST(coalesce(c.fp, 0) AS BIGINT) AS fp,
              CAST(coalesce(c.fn, 0) AS BIGINT) AS fn FROM {_CLASSES_VALUES} LEFT JOIN c ON c.label = k.label),
n AS (SELECT count(*) AS n_rows FROM r)"""


@register("multilabel_confusion", _LABEL_COUNTS_SQL + """
SELECT label, tp, fp, fn, CAST(n_rows - tp - fp - fn AS BIGINT) AS tn FROM lc, n""")
def q_multilabel_confusion(spark, d):
    return M.label_counts(T.multilabel_rows(spark, d), _classes_df(spark))


_ML_REPORT_SQL = _LABEL_COUNTS_SQL + f""",
per AS (SELECT label AS row, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
               CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
               CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
               CAST(tp + fn AS DOUBLE) AS support FROM lc),
tot AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM lc),
smp AS (SELECT len(list_intersect(list_distinct(truth), list_distinct(predicted))) AS i, len(list_distinct(truth)) AS nt,
               len(list_distinct(predicted)) AS np,
               list_sort(list_distinct(truth)) = list_sort(list_distinct(predicted)) AS exact FROM r),
rep AS (
  SELECT * FROM per
  UNION ALL SELECT 'micro avg', CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, CAST(tp + fn AS DOUBLE) FROM tot
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), sum(support) FROM per
  UNION ALL SELECT 'samples avg', avg(CASE WHEN np = 0 THEN 0.0 ELSE i / np END), avg(CASE WHEN nt = 0 THEN 0.0 ELSE i / nt END),
         avg(CASE WHEN nt + np = 0 THEN 0.0 ELSE 2 * i / (nt + np) END), CAST(sum(nt) AS DOUBLE) FROM smp)"""


@register("multilabel_report", _ML_REPORT_SQL + f"""
SELECT row, {_rs('precision')} AS precision, {_rs('recall')} AS recall, {_rs('f1')} AS f1, support FROM rep""")
def q_multilabel_report(spark, d):
    return _r(M.multilabel_report(T.multilabel_rows(spark, d), _classes_df(spark)), ["precision", "recall", "f1"])


@register("multilabel_metrics", _ML_REPORT_SQL + f"""
SELECT {_rs('(SELECT avg(CAST(exact AS DOUBLE)) FROM smp)')} AS subset_accuracy,
  {_rs("(SELECT precision FROM rep WHERE row = 'micro avg')")} AS precision_micro,
  {_rs("(SELECT recall FROM rep WHERE row = 'micro avg')")} AS recall_micro,
  {_rs("(SELECT f1 FROM rep WHERE row = 'micro avg')")} AS f1_micro,
  {_rs("(SELECT f1 FROM rep WHERE row = 'macro avg')")} AS f1_macro""")
def q_multilabel_metrics(spark, d):
    out = M.multilabel_metrics(T.multilabel_rows(spark, d), _classes_df(spark))
    return _r(out, out.columns)


@register("multi_hot", f"""
SELECT l_orderkey, l_linenumber, array_to_string(list_transform([{", ".join("'" + c + "'" for c in T.MULTILABEL_CLASSES)}],
  lambda c: CAST(list_contains(truth, c) AS INTEGER)), '') AS multi_hot FROM ({T.MULTILABEL_SQL}) r""")
def q_multi_hot(spark, d):
    r = T.multilabel_rows(spark, d)
    return r.select("l_orderkey", "l_linenumber",
                    F.array_join(LB.multi_hot(F.col("truth"), T.MULTILABEL_CLASSES), "").alias("multi_hot"))


@register("label_profile", f"""
SELECT u.label, CAST(count(*) AS BIGINT) AS n FROM ({T.LABEL_LISTS_SQL}) r, unnest(r.labels) u(label) GROUP BY u.label""")
def q_label_profile(spark, d):
    return LB.label_frequency(T.label_lists(spark, d), "labels")


@register("frequent_labels", f"""
WITH r AS ({T.LABEL_LISTS_SQL}),
f AS (SELECT u.label FROM r, unnest(r.labels) u(label) GROUP BY u.label HAVING count(*) > 50),
fl AS (SELECT list(label) AS fl FROM f),
k AS (SELECT l_orderkey, l_linenumber, list_filter(labels, lambda x: list_contains(fl.fl, x)) AS labels FROM r, fl)
SELECT l_orderkey, l_linenumber, array_to_string(labels, chr(1)) AS labels FROM k WHERE len(labels) > 0""")
def q_frequent_labels(spark, d):
    rows = T.label_lists(spark, d)
    freq, _removed = LB.frequent_labels(LB.label_frequency(rows, "labels"), 50)
    kept = LB.keep_labels(rows, "labels", freq)
    return kept.select("l_orderkey", "l_linenumber", F.array_join("labels", "\u0001").alias("labels"))


@register("sorted_labels", f"""
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_idx
FROM (SELECT DISTINCT u.label FROM ({T.LABEL_LISTS_SQL}) r, unnest(r.labels) u(label))""")
def q_sorted_labels(spark, d):
    return LB.label_index(LB.label_frequency(T.label_lists(spark, d), "labels"))


@register("class_set", f"""
SELECT coalesce(s.label, k.label) AS label, s.label IS NOT NULL AS seen, k.label IS NOT NULL AS expected
FROM (SELECT DISTINCT u.label FROM ({T.MULTILABEL_SQL}) r, unnest(r.truth) u(label)) s
FULL JOIN {_CLASSES_VALUES} ON s.label = k.label""")
def q_class_set(spark, d):
    rows = T.multilabel_rows(spark, d).select(F.explode("truth").alias("label"))
    return LB.class_set(rows, "label", T.MULTILABEL_CLASSES)


@register("tuning_rank", f"""
SELECT model, params, mean_score, n_folds, rnk AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY rnk, params) AS pos FROM (
    SELECT model, params, avg(score) AS mean_score, CAST(count(*) AS BIGINT) AS n_folds,
           CAST(rank() OVER (PARTITION BY model ORDER BY avg(score) DESC) AS INTEGER) AS rnk
    FROM ({T.SEARCH_SCORES_SQL}) s GROUP BY model, params) a) b WHERE pos <= 4""")
def q_tuning_rank(spark, d):
    return M.tuning_rank(T.search_scores(spark, d), top=4)


# ============================== splits and encoding ==========================================

from hazardframe.operators import splits as SP  # noqa: E402


def _emb(spark, d):
    return T.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"))


_EMB_SQL = "SELECT vec_id, 'L' || CAST(label AS VARCHAR) AS label FROM embeddings"
_RANK_SQL = f"""SELECT vec_id, label,
  row_number() OVER (PARTITION BY {{part}} ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) AS rk,
  count(*) OVER (PARTITION BY {{part}}) AS n FROM ({_EMB_SQL}) e"""


@register("label_encode", f"SELECT vec_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_idx FROM ({_EMB_SQL}) e")
def q_label_encode(spark, d):
    from pyspark.ml.feature import StringIndexer
    df = _emb(spark, d)
    model = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc").fit(df)
    return model.transform(df)


@register("label_encode_wide", """
SELECT o_orderkey, word, CAST(dense_rank() OVER (ORDER BY word) - 1 AS BIGINT) AS label_idx FROM (
  SELECT o_orderkey, o_orderpriority || '/' || CAST(o_custkey AS VARCHAR) AS word FROM orders) x""")
def q_label_encode_wide(spark, d):
    """Codes of as many classes as there are pairs of priority and customer, without one task that holds them all."""
    rows = T.table(spark, d, "orders").select("o_orderkey", F.concat_ws("/", "o_orderpriority", F.col("o_custkey").cast("string")).alias("word"))
    return LB.encode_labels(rows, "word")


@register("sparse_hot", """
WITH l AS (SELECT DISTINCT o_custkey AS id, p_name AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM l) x)
SELECT id, array_to_string(list(idx ORDER BY idx), ' ') AS ones, CAST((SELECT count(*) FROM k) AS BIGINT) AS width FROM l JOIN k USING (label) GROUP BY id""")
def q_sparse_hot(spark, d):
    """The parts that each customer has bought, as places in the sorted list of all part names."""
    lines = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    bought = (lines.join(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id")), "l_orderkey")
              .join(T.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"))
    lists = bought.groupBy("id").agg(F.collect_set("p_name").alias("labels"))
    classes = LB.label_index(lists.select(F.explode("labels").alias("label")))
    return LB.sparse_hot(lists, "labels", classes, "id").select("id", F.array_join(F.transform("ones", lambda x: x.cast("string")), " ").alias("ones"), "width")


@register("stratified_split", f"SELECT vec_id, label, rk <= ceil(n * 0.2) AS is_test FROM ({_RANK_SQL.format(part='label')}) r")
def q_stratified_split(spark, d):
    return SP.stratified_split(_emb(spark, d), "vec_id", "label", 0.2, seed=42)


@register("random_split", f"SELECT vec_id, label, rk <= ceil(n * 0.2) AS is_test FROM ({_RANK_SQL.format(part='1')}) r")
def q_random_split(spark, d):
    return SP.stratified_split(_emb(spark, d), "vec_id", None, 0.2, seed=42)


@register("cv_folds", f"SELECT vec_id, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM ({_RANK_SQL.format(part='label')}) r")
def q_cv_folds(spark, d):
    return SP.fold_column(_emb(spark, d), "vec_id", "label", k=5, seed=42)


# ============================== stored documents and retries =================================

from hazardframe.operators import jsonpick as JP  # noqa: E402

_DUCK_DOC_STRUCT = ('{"Record":{"Reference":[{"ReferenceNumber":"INTEGER","SourceName":"VARCHAR"}],'
                    '"Section":[{"Section":[{"Section":[{"Information":[{"Name":"VARCHAR","ReferenceNumber":"INTEGER",'
                    '"Value":{"StringWithMarkup":[{"String":"VARCHAR"}]}}]}]}]}]}}')


@register("json_priority_pick", f"""
WITH d AS (SELECT cid, json, from_json(json, '{_DUCK_DOC_STRUCT}') AS doc FROM ({T.STORED_DOCUMENTS_SQL}) s),
r AS (SELECT cid, json, doc, coalesce(doc.Record.Reference, []) AS refs FROM d),
c AS (SELECT *, CASE WHEN len(list_filter(refs, lambda x: x.SourceName = '{JP.IARC}')) > 0
                     THEN list_filter(refs, lambda x: x.SourceName = '{JP.IARC}')[1]
                     WHEN len(list_filter(refs, lambda x: x.SourceName = '{JP.T3DB}')) > 0
                     THEN list_filter(refs, lambda x: x.SourceName = '{JP.T3DB}')[-1] END AS chosen,
                doc.Record.Section[1].Section[1].Section[1] AS s3,
                (doc.Record.Section[1] IS NOT NULL AND doc.Record.Section[1].Section[1] IS NOT NULL
                 AND doc.Record.Section[1].Section[1].Section[1] IS NOT NULL) AS sections_ok FROM r),
i AS (SELECT *, coalesce(chosen.SourceName, 'Unknown') AS src0, coalesce(chosen.ReferenceNumber, 0) AS ref_no FROM c),
j AS (SELECT *, CASE WHEN src0 = '{JP.IARC}' THEN list_filter(coalesce(s3.Information, []), lambda x: x.Name = '{JP.IARC_ITEM_NAME}')[1]
                     WHEN src0 = '{JP.T3DB}' THEN list_filter(coalesce(s3.Information, []), lambda x: coalesce(x.ReferenceNumber, 0) = ref_no)[1]
                END AS item FROM i),
k AS (SELECT *, CASE WHEN json IS NULL THEN 'failed_fetch' WHEN doc IS NULL OR NOT sections_ok THEN 'error'
                     WHEN item IS NULL THEN 'not_available' WHEN item.Value.StringWithMarkup[1] IS NULL THEN 'error'
                     ELSE 'ok' END AS status FROM j)
SELECT cid,
  CASE status WHEN 'failed_fetch' THEN 'Not Available' WHEN 'error' THEN 'Error' WHEN 'not_available' THEN 'Not Available'
       ELSE coalesce(item.Value.StringWithMarkup[1].String, '') END AS value,
  CASE status WHEN 'failed_fetch' THEN 'Unknown' WHEN 'error' THEN 'Error' ELSE src0 END AS source, status
FROM k""")
def q_json_priority_pick(spark, d):
    docs = T.stored_documents(spark, d)
    return docs.select("cid", JP.resolve_priority("json").alias("r")).select("cid", "r.value", "r.source", "r.status")


def _retry(spark, d):
    first = T.first_pass(spark, d)
    return JP.retry_merge(first, T.retry_pass(spark, d, first), key="cid", order="row_id")


@register("retry_merge", f"""
WITH f AS ({T.FIRST_PASS_SQL}), ok AS ({T.RETRY_OK_SQL}),
firsts AS (SELECT cid, min(row_id) AS first_row FROM f GROUP BY cid)
SELECT f.row_id, f.cid,
  CASE WHEN ok.cid IS NOT NULL AND f.row_id = firsts.first_row THEN 'Group 2B' ELSE f.value END AS value,
  CASE WHEN ok.cid IS NOT NULL AND f.row_id = firsts.first_row THEN '{JP.T3DB}' ELSE f.source END AS source
FROM f JOIN firsts USING (cid) LEFT JOIN ok USING (cid)""")
def q_retry_merge(spark, d):
    return _retry(spark, d)[0]


@register("retry_ledger", f"""
WITH f AS ({T.FIRST_PASS_SQL}), ok AS ({T.RETRY_OK_SQL})
SELECT row_id, cid FROM f WHERE (value = 'Not Available' OR source = 'Unknown' OR value = 'Error')
  AND cid NOT IN (SELECT cid FROM ok)""")
def q_retry_ledger(spark, d):
    return _retry(spark, d)[1]


# ============================== features and dataset build ===================================

from pyspark.sql import types as PT  # noqa: E402

from hazardframe.operators import features as FE  # noqa: E402


def _cnt(s, tok):
    return f"CAST((length({s}) - length(replace({s}, '{tok}', ''))) / {len(tok)} AS INTEGER)"


def _balanced_sql(s, o, c):
    return (f"(list_reduce(string_split({s}, ''), lambda acc, ch: CASE WHEN acc < 0 THEN acc WHEN ch = '{o}' THEN acc + 1 "
            f"WHEN ch = '{c}' THEN (CASE WHEN acc = 0 THEN -1000000 ELSE acc - 1 END) ELSE acc END, 0) = 0)")


def _features_sql(s):
    cols = {}
    for tok in FE.ELEMENT_TOKENS:
        e = _cnt(s, tok) if tok != "C" else f"({_cnt(s, 'C')} - {_cnt(s, 'Cl')})"
        cols[f"n_{tok}" if tok.isupper() or len(tok) > 1 else f"n_arom_{tok}"] = e
    for name, tok in FE.BOND_TOKENS.items():
        cols[name] = _cnt(s, tok)
    cols["ring_digits"] = f"CAST(length(regexp_replace({s}, '[^0-9%]', '', 'g')) AS INTEGER)"
    cols["length"] = f"CAST(length({s}) AS INTEGER)"
    cols["heavy_atoms"] = "CAST(" + " + ".join(v for k, v in cols.items() if k.startswith("n_")) + " AS INTEGER)"
    cols["fragments"] = f"CAST({cols['fragments_sep']} + 1 AS INTEGER)"
    ok = (f"coalesce({s} IS NOT NULL AND length({s}) > 0 AND {_balanced_sql(s, '(', ')')} "
          f"AND {_balanced_sql(s, '[', ']')}, false)")
    return ok, cols


def _features_select_sql(s):
    ok, cols = _features_sql(s)
    return f"{ok} AS desc_ok, " + ", ".join(f"CASE WHEN {ok} THEN {v} END AS {k}" for k, v in cols.items())


@register("smiles_descriptors", f"SELECT CID, {_features_select_sql('SMILES')} FROM ({T.COMPOUNDS_SQL}) c")
def q_smiles_descriptors(spark, d):
    return FE.with_structure_features(T.compounds(spark, d), "SMILES").drop("SMILES", "Carcinogenicity")


def demo_feature_fn(smiles):
    """A user feature function of the plug-in kind: raises on unbalanced branches."""
    if smiles is None or smiles.count("(") != smiles.count(")"):
        raise ValueError("unparsable structure")
    return {"n_carbon": smiles.count("C") - smiles.count("Cl"), "n_branch": smiles.count("(")}


_DEMO_SCHEMA = PT.StructType([PT.StructField("n_carbon", PT.LongType()), PT.StructField("n_branch", PT.LongType())])


@register("featurize_rows", f"""
SELECT CID, SMILES IS NOT NULL AND {_cnt('SMILES', '(')} = {_cnt('SMILES', ')')} AS desc_ok,
  CASE WHEN SMILES IS NOT NULL AND {_cnt('SMILES', '(')} = {_cnt('SMILES', ')')}
       THEN CAST({_cnt('SMILES', 'C')} - {_cnt('SMILES', 'Cl')} AS BIGINT) END AS n_carbon,
  CASE WHEN SMILES IS NOT NULL AND {_cnt('SMILES', '(')} = {_cnt('SMILES', ')')}
       THEN CAST({_cnt('SMILES', '(')} AS BIGINT) END AS n_branch
FROM ({T.COMPOUNDS_SQL}) c""")
def q_featurize_rows(spark, d):
    return FE.featurize(T.compounds(spark, d), demo_feature_fn, "SMILES", _DEMO_SCHEMA, keep=["CID"])


def per_feature_fn(smiles):
    """A user function whose features are computed one by one; any of them may fail alone."""
    def branches():
        if smiles.count("(") != smiles.count(")"):
            raise ValueError("unbalanced branches")
        return smiles.count("(")

    return {"n_carbon": lambda: smiles.count("C") - smiles.count("Cl"), "n_branch": branches}


@register("featurize_per_feature", f"""
SELECT CID, true AS desc_ok, CASE WHEN SMILES IS NOT NULL THEN CAST({_cnt('SMILES', 'C')} - {_cnt('SMILES', 'Cl')} AS BIGINT) END AS n_carbon,
  CASE WHEN {_cnt('SMILES', '(')} = {_cnt('SMILES', ')')} THEN CAST({_cnt('SMILES', '(')} AS BIGINT) END AS n_branch
FROM ({T.COMPOUNDS_SQL}) c""")
def q_featurize_per_feature(spark, d):
    return FE.featurize(T.compounds(spark, d), per_feature_fn, "SMILES", _DEMO_SCHEMA, keep=["CID"], per_feature=True)


@register("required_columns", """
SELECT w.c AS column_name, w.c <> 'smiles' AS present, (SELECT count(*) FROM labels) AS rows,
  CASE w.c WHEN 'doc_id' THEN (SELECT count(doc_id) FROM labels) WHEN 'quality' THEN (SELECT count(quality) FROM labels)
    WHEN 'toxic' THEN (SELECT count(toxic) FROM labels) ELSE 0 END AS values
FROM (VALUES ('doc_id'), ('quality'), ('smiles'), ('toxic')) w(c)""")
def q_required_columns(spark, d):
    return CL.column_check(T.table(spark, d, "labels"), ["doc_id", "quality", "smiles", "toxic"])


@register("preview_rows", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem ORDER BY ALL LIMIT 5""")
def q_preview_rows(spark, d):
    """The first five rows in the order of the first five columns, and these columns."""
    return CL.preview(T.table(spark, d, "lineitem"), 5, 5, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])


_LABELLED_SQL = f"""
SELECT c.cid0 AS CID, {OR.classify_first_match_sql("coalesce(c.carc_raw, 'nan')")} AS Carcinogenicity,
  CASE WHEN t.Categories IS NULL OR len(t.Categories) = 0 THEN ['No data'] ELSE t.Categories END AS Categories,
  {OR.normalize_routes_sql('t."Route of Exposure"')} AS Route, c.* EXCLUDE (cid0, carc_raw, SMILES)
FROM (SELECT CID AS cid0, Carcinogenicity AS carc_raw, SMILES, {_features_select_sql('SMILES')} FROM ({T.COMPOUNDS_SQL}) x) c
LEFT JOIN ({T.TOXINS_SQL}) t ON t.CID = c.cid0"""


@register("build_dataset", f"""
SELECT CID, Carcinogenicity, array_to_string(Categories, '|') AS Categories, array_to_string(Route, '|') AS Route,
  {", ".join(_features_sql('SMILES')[1].keys())}
FROM ({_LABELLED_SQL}) y
WHERE desc_ok AND NOT (Carcinogenicity = 'No data' AND Categories = ['No data'] AND Route = ['No data'])""")
def q_build_dataset(spark, d):
    ds = FE.build_dataset(T.compounds(spark, d), T.toxins(spark, d))
    return (ds.withColumn("Categories", F.array_join("Categories", "|"))
            .withColumn("Route", F.array_join("Route", "|")))


@register("dataset_audit", f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN NOT desc_ok THEN 1 ELSE 0 END) AS BIGINT) AS desc_failures,
  CAST(sum(CASE WHEN desc_ok AND no_tox THEN 1 ELSE 0 END) AS BIGINT) AS no_tox_data,
  CAST(sum(CASE WHEN desc_ok AND NOT no_tox THEN 1 ELSE 0 END) AS BIGINT) AS kept
FROM (SELECT desc_ok, (Carcinogenicity = 'No data' AND Categories = ['No data'] AND Route = ['No data']) AS no_tox
      FROM ({_LABELLED_SQL}) l) z""")
def q_dataset_audit(spark, d):
    return FE.drop_counts(FE.label_dataset(T.compounds(spark, d), T.toxins(spark, d)))


# ============================== sources and sinks ============================================

from hazardframe.session import scratch_path  # noqa: E402
from hazardframe.sources import io as IO  # noqa: E402

_PART_COLS = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
_PART_DDL = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"


@register("csv_roundtrip", """
SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS p_name, p_brand, p_type,
  CASE WHEN p_partkey % 10 > 0 THEN CAST(p_size AS BIGINT) END AS p_size,
  CASE WHEN p_partkey % 11 > 0 THEN p_retailprice END AS p_retailprice FROM part""")
def q_csv_roundtrip(spark, d):
    """Missing-token cells in text and numeric columns, types inferred without a schema."""
    def gaps(c, n, token):
        return F.when(F.pmod("p_partkey", F.lit(n)) == 0, token).otherwise(F.col(c).cast("string")).alias(c)

    part = T.table(spark, d, "part").select("p_partkey", gaps("p_name", 7, "None"), "p_brand", "p_type", gaps("p_size", 10, "NA"), gaps("p_retailprice", 11, "#N/A"))
    return IO.read_csv(spark, IO.write_csv(part, scratch_path(spark, "csv")))


_BROKEN_SQL = """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN p_partkey || ',"' || p_name || '",' || p_size || ',,left over'
    WHEN 2 THEN p_partkey || ',"a, b"' ELSE p_partkey || ',"' || p_name || ', x",' || p_size END AS line FROM part"""


def _broken_csv(spark, d):
    """A CSV file without quotation care: some lines have cells too many, some too few, all have separators inside quotes."""
    part = T.table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("size"), F.col("p_partkey").cast("string").alias("key"))
    m = F.pmod("p_partkey", F.lit(5))
    line = (F.when(m == 1, F.concat("key", F.lit(',"'), "p_name", F.lit('",'), "size", F.lit(",,left over")))
            .when(m == 2, F.concat("key", F.lit(',"a, b"'))).otherwise(F.concat("key", F.lit(',"'), "p_name", F.lit(', x",'), "size")))
    path = scratch_path(spark, "broken")
    part.select(line.alias("value")).write.text(path)
    return path


@register("rejected_lines", f"""
SELECT line, CASE WHEN p_partkey % 5 = 1 THEN 5 ELSE 2 END AS cells, 3 AS expected,
  CASE WHEN p_partkey % 5 = 1 THEN 'surplus cells' ELSE 'missing cells' END AS reason
FROM ({_BROKEN_SQL}) x WHERE p_partkey % 5 IN (1, 2)""")
def q_rejected_lines(spark, d):
    return IO.delimited_ledger(spark, _broken_csv(spark, d), ",", False, {"CID": "BIGINT", "name": "TEXT", "size": "INTEGER"}, '"').drop("file")


@register("accepted_lines", """
SELECT p_partkey AS CID, p_name || ', x' AS name, p_size AS size FROM part WHERE p_partkey % 5 NOT IN (1, 2)""")
def q_accepted_lines(spark, d):
    return IO.read_delimited(spark, _broken_csv(spark, d), ",", False, {"CID": "BIGINT", "name": "TEXT", "size": "INTEGER"}, '"', on_bad="skip")


@register("csv_schema_roundtrip", f"SELECT {_PART_COLS} FROM part")
def q_csv_schema_roundtrip(spark, d):
    path = IO.write_csv(T.table(spark, d, "part").select(*_PART_COLS.split(", ")), scratch_path(spark, "csv"))
    return IO.read_csv(spark, path, schema=_PART_DDL)


@register("csv_float_format", """
SELECT event_id, CASE WHEN event_id % 7 > 0 THEN printf('%.4f', event_id / 32.0::DOUBLE) END AS ties,
  CASE WHEN value IS NOT NULL THEN printf('%.4f', value / 7.0::DOUBLE) END AS value FROM events""")
def q_csv_float_format(spark, d):
    """Four decimals, exact ties (multiples of 1/32) and missing cells through a CSV file."""
    x = T.table(spark, d, "events").select("event_id", F.when(F.pmod("event_id", F.lit(7)) > 0, F.col("event_id") / F.lit(32.0)).alias("ties"), (F.col("value") / F.lit(7.0)).alias("value"))
    path = IO.write_csv(x, scratch_path(spark, "csv-floats"), float_digits=4)
    return IO.read_csv(spark, path, schema="event_id BIGINT, ties STRING, value STRING")


@register("delimited_roundtrip", f"SELECT p_partkey AS CID, p_name AS name, p_size AS size FROM part")
def q_delimited_roundtrip(spark, d):
    src = scratch_path(spark, "tsv")
    (T.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
     .write.option("sep", "\t").option("header", False).option("quote", "").csv(src))
    out, _ = IO.convert_delimited(spark, src, delim="\t", header=False,
                                  columns={"CID": "BIGINT", "name": "TEXT", "size": "INTEGER"}, compression="zstd")
    return spark.read.parquet(out)


@register("schema_report", """
SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
  WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS column_type,
  CAST(row_number() OVER () - 1 AS INTEGER) AS position
FROM (DESCRIBE SELECT * FROM part) x""")
def q_schema_report(spark, d):
    out = IO.write_parquet(T.table(spark, d, "part"), scratch_path(spark, "parquet"), compression="gzip")
    return IO.schema_report(spark.read.parquet(out))


@register("keyed_tables", f"""
SELECT k.CID, k.Synonyms, s.SMILES FROM ({_KEPT_SQL}) k JOIN ({T.STRUCTURES_SQL}) s ON s.CID = k.CID""")
def q_keyed_tables(spark, d):
    import uuid
    tag = uuid.uuid4().hex[:8]
    from hazardframe.session import shuffle_partitions
    n = shuffle_partitions(spark)
    names = IO.save_keyed_table(N.prune_names(T.synonyms(spark, d)), f"synonyms_{tag}", "CID", n, keep=False)
    smiles = IO.save_keyed_table(T.structures(spark, d), f"smiles_{tag}", "CID", n, keep=False)
    return names.join(smiles, "CID").select("CID", "Synonyms", "SMILES")


@register("keyed_by_name", f"""
SELECT p.p_partkey, k.CID, k.Synonyms FROM part p JOIN ({_KEPT_SQL}) k
  ON k.Synonyms = upper(substr(p.p_name, 1, 1)) || substr(p.p_name, 2)""")
def q_keyed_by_name(spark, d):
    """The layout by name: exact look-ups of capitalised part names."""
    import uuid
    from hazardframe.session import shuffle_partitions
    names = IO.save_keyed_table(N.prune_names(T.synonyms(spark, d)), f"names_{uuid.uuid4().hex[:8]}", "Synonyms",
                                shuffle_partitions(spark), keep=False)
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    wanted = T.table(spark, d, "part").select("p_partkey", name.alias("Synonyms"))
    return IO.look_up_all(wanted, names, "Synonyms").select("p_partkey", "CID", "Synonyms")


# ============================== models =======================================================
# Fitted values differ between engines; the queries return what is fixed by definition (held-out
# rows, true labels, supports, fold sizes, whether predictions are known classes), next to what the
# oracle can only bound. Quality is tested in tests/test_models.py.

from hazardframe.operators import ml as ML  # noqa: E402


def _stored(spark, df, name):
    """Written to the shared folder once: every fit reads the split instead of computing it again."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _model_data(spark, d):
    e = T.table(spark, d, "embeddings").select(
        "vec_id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), "embedding")
    return ML.feature_frame(e, array_col="embedding")


def _parts(spark, d, strata="label"):
    df, cols = _model_data(spark, d)
    s = _stored(spark, SP.stratified_split(df, "vec_id", strata, 0.2, seed=42), "split")
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter("is_test").drop("is_test"), cols


def _known(spark, train):
    labels = [r[0] for r in train.select("label").distinct().collect()]  # the classes
    return F.col("predicted_label").isin(*labels)


_HELD_SQL = f"SELECT vec_id, label FROM ({_RANK_SQL.format(part='label')}) r WHERE rk <= ceil(n * 0.2)"
_MODELS = ("booster", "forest", "linear")
_MODELS_VALUES = "(VALUES " + ", ".join(f"('{m}')" for m in _MODELS) + ") m(\"Model\")"


@register("train_multiclass", f"SELECT vec_id, label, true AS known FROM ({_HELD_SQL}) h")
def q_train_multiclass(spark, d):
    train, test, cols = _parts(spark, d)
    _, pred = ML.train_and_predict(train, test, cols, "booster", maxIter=5)
    return pred.select("vec_id", "label", _known(spark, train).alias("known"))


# Families are compared, searched and refitted on a label that can be learnt: the language of a document
# from the shares of some letters in its text. Besides supports and fold sizes, each row says whether the model
# beats naming the largest class always (a weighted F1 of 2 p^2 / (1 + p) at its share p).

_LETTERS = "enisratduolhwkyzéüñ"
_LANG_RANK_SQL = """SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS rk,
  count(*) OVER (PARTITION BY lang) AS n FROM documents"""
_LANG_HELD_SQL = f"SELECT doc_id, label FROM ({_LANG_RANK_SQL}) r WHERE rk <= ceil(n * 0.2)"


def _language_data(spark, d):
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    share = {f"f{i}": 100 * (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.greatest(F.length(text), F.lit(1)) for i, c in enumerate(_LETTERS)}
    df = T.table(spark, d, "documents", spread=True).select("doc_id", F.col("lang").alias("label"), *[v.alias(k) for k, v in share.items()])
    return df, list(share)


def _language_parts(spark, d):
    df, cols = _language_data(spark, d)
    s = _stored(spark, SP.stratified_split(df, "doc_id", "label", 0.2, seed=42), "split")
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter("is_test").drop("is_test"), cols


def _largest(held, by=()):
    """Per combination of ``by``: the rows, those of the largest class, and the F1 that naming it always gets."""
    n = held.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("all"), F.max("n").alias("majority"))
    p = F.col("majority") / F.col("all")
    return n.select(*by, "majority", (2 * p * p / (1 + p)).alias("least"))


@register("model_compare", f"""
SELECT "Model", row, support, true AS better FROM {_MODELS_VALUES}, (
  SELECT label AS row, CAST(count(*) AS DOUBLE) AS support FROM ({_LANG_HELD_SQL}) h GROUP BY label
  UNION ALL SELECT t.r, (SELECT CAST(count(*) AS DOUBLE) FROM ({_LANG_HELD_SQL}) h)
  FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) t(r)) x""")
def q_model_compare(spark, d):
    """Per-class rows and averages of three families with their own settings, tagged by model."""
    train, test, cols = _language_parts(spark, d)
    least = _largest(test).first()["least"]
    frames = {}
    for name in _MODELS:
        _, pred = ML.train_and_predict(train, test, cols, name)
        frames[name] = M.classification_report(pred, "label", "predicted_label")
    out = M.tag_union(frames, "Model")
    model = Window.partitionBy("Model")
    # Whether every value of the report is there and a share (the accuracy row has an F1 only), so that none is left uncomputed.
    values = F.least(*[F.coalesce(F.col(c).between(0.0, 1.0), (F.col("row") == "accuracy") & F.lit(c != "f1")) for c in ("precision", "recall", "f1")])
    good = (F.max(F.when(F.col("row") == "weighted avg", F.col("f1"))).over(model) > least) & F.min(values).over(model)
    return out.select("Model", "row", "support", good.alias("better"))


_TAGS = ["even", "low", "pos"]
_TAGGED_SQL = f"""SELECT r.vec_id, r.label, list_filter([
    CASE WHEN r.label IN ('L0', 'L2', 'L4', 'L6', 'L8') THEN 'even' END, CASE WHEN r.label < 'L5' THEN 'low' END,
    CASE WHEN e.embedding[1] > 0 THEN 'pos' END], lambda x: x IS NOT NULL) AS truth
  FROM ({_RANK_SQL.format(part='1')}) r JOIN embeddings e USING (vec_id) WHERE r.rk <= ceil(r.n * 0.2)"""


def _tagged(df):
    tags = F.array(F.when(F.col("label").isin("L0", "L2", "L4", "L6", "L8"), "even"),
                   F.when(F.col("label") < "L5", "low"), F.when(F.col("f0") > 0, "pos"))
    return df.withColumn("labels", F.filter(tags, lambda x: x.isNotNull()))


@register("train_multilabel", f"SELECT vec_id, array_to_string(truth, '|') AS truth, true AS known FROM ({_TAGGED_SQL}) t")
def q_train_multilabel(spark, d):
    train, test, cols = _parts(spark, d, None)
    pred = ML.train_multilabel(_tagged(train), _tagged(test), cols, "labels", _TAGS, "vec_id", maxIter=5)
    known = F.size(F.array_except("predicted", F.array(*map(F.lit, _TAGS)))) == 0
    return pred.select("vec_id", F.array_join("truth", "|").alias("truth"), known.alias("known"))


@register("compare_multilabel_wide", """
SELECT m."Model", true AS subset_accuracy, true AS f1_micro, true AS f1_macro, true AS f1_even, true AS f1_low, true AS f1_pos
FROM (VALUES ('deep'), ('flat')) m("Model")""")
def q_compare_multilabel_wide(spark, d):
    """Two depths of boosters side by side: one row per model with an F1 column per label; values as
    whether they lie between 0 and 1."""
    train, test, cols = _parts(spark, d, None)
    frames = {}
    for name, depth in (("flat", 2), ("deep", 4)):
        pred = ML.train_multilabel(_tagged(train), _tagged(test), cols, "labels", _TAGS, "vec_id", maxIter=3, maxDepth=depth)
        frames[name] = M.multilabel_wide(pred, _TAGS)
    out = M.tag_union(frames, "Model")
    return out.select("Model", *[F.col(c).between(0.0, 1.0).alias(c) for c in out.columns if c != "Model"])


_GRIDS = {"booster": {"maxIter": [2, 3], "maxDepth": [2, 3]}, "forest": {"numTrees": [5, 10], "maxDepth": [4, 5]},
          "linear": {"regParam": [0.0, 0.01], "maxIter": [10, 20]}}
_SETTINGS = {name: ML.sample_settings(grid, n_iter=4) for name, grid in _GRIDS.items()}
_SEARCHED_VALUES = "(VALUES " + ", ".join(f"('{m}', '{ML.setting_name(x)}')" for m, xs in _SETTINGS.items() for x in xs) + ") s(model, params)"


@register("cv_search", f"""
SELECT s.model, s.params, f.fold, f.n_rows, f.majority, true AS better FROM {_SEARCHED_VALUES}, (
  SELECT fold, CAST(sum(n) AS BIGINT) AS n_rows, CAST(max(n) AS BIGINT) AS majority FROM (
    SELECT CAST((rk - 1) % 3 AS INTEGER) AS fold, label, count(*) AS n FROM ({_LANG_RANK_SQL}) r GROUP BY 1, 2) c GROUP BY fold) f""")
def q_cv_search(spark, d):
    """Settings of three families over three folds."""
    df, cols = _language_data(spark, d)
    df = _stored(spark, SP.fold_column(df, "doc_id", "label", k=3, seed=42), "folds")
    scores = ML.cross_validate(df, cols, list(_SETTINGS), _SETTINGS, folds=3)
    return (scores.join(_largest(df, ["fold"]), "fold")
            .select("model", "params", "fold", "n_rows", "majority", (F.col("score") > F.col("least")).alias("better")))


@register("tune_refit", f"""
SELECT kind, m."Model" AS model, position, row, support, true AS better FROM {_MODELS_VALUES}, (
  SELECT 'Default' AS kind, 0 AS position UNION ALL SELECT 'Tuned', CAST(k AS INTEGER) FROM range(1, 5) t(k)) x, (
  SELECT label AS row, CAST(count(*) AS DOUBLE) AS support FROM ({_LANG_HELD_SQL}) h GROUP BY label
  UNION ALL SELECT t.r, (SELECT CAST(count(*) AS DOUBLE) FROM ({_LANG_HELD_SQL}) h)
  FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) t(r)) y""")
def q_tune_refit(spark, d):
    """Search over three families on the training part, refit of the best four and the defaults of each on all of it: the
    per-class report of every refitted model on the held-out part, next to whether its row of the grouped table is better than the largest class."""
    train, test, cols = _language_parts(spark, d)
    folds = _stored(spark, SP.fold_column(train, "doc_id", "label", k=3, seed=42), "folds")
    _, grouped, reports = ML.tune(folds, test, cols, _SETTINGS, folds=3, top=4)
    better = grouped.select("kind", "model", "position", (F.col("f1_weighted") > _largest(test).first()["least"]).alias("better"))
    return reports.select("kind", "model", "position", "row", "support").join(better, ["kind", "model", "position"])


@register("model_roundtrip", f"SELECT vec_id, label, true AS same FROM ({_HELD_SQL}) h")
def q_model_roundtrip(spark, d):
    """Predictions of the saved and loaded model equal those of the fitted one."""
    train, test, cols = _parts(spark, d)
    model, pred = ML.train_and_predict(train, test, cols, "forest")
    again = ML.load_model(ML.save_model(model, scratch_path(spark, "model")))
    loaded = ML.decode(again.transform(test), again).select("vec_id", F.col("predicted_label").alias("later"))
    return pred.join(loaded, "vec_id").select("vec_id", "label", (F.col("predicted_label") == F.col("later")).alias("same"))
