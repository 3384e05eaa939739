"""Stand-in inputs built from the driver tables.

The driver tables hold no chemistry, so each domain table is derived from a real table by
expressions that Spark and DuckDB evaluate identically. Every stand-in grows with its source
table; nothing is sampled or capped. Each Spark builder has a SQL twin used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.functions.text import zero_pad
from hazardframe.session import ensure_parallelism


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One driver table. ``spread=True`` for inputs that feed heavy per-row work (regex rules,
    JSON parsing, descriptors): a single-split file is then spread over the cores. Cheap
    projections read the file as it is (the round-robin shuffle would cost more than it
    saves). Large inputs already have many splits and are never reshuffled."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return ensure_parallelism(df) if spread else df


# ---------------------------------------------------------------------------------------------
# Name table (CID, Synonyms): customer and supplier names, plus one derived name per part
# whose form depends on the part key (code, CAS number, capitalised, salt, upper case, brand).
# ---------------------------------------------------------------------------------------------

def _cap_first(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    n = F.col("p_name")
    form = F.pmod(k, F.lit(6))
    derived = (
        F.when(form == 0, F.concat(F.lit("CHEBI:"), k.cast("string")))
        .when(form == 1, F.concat(zero_pad(k, 5), F.lit("-"),
                                  F.lpad(F.pmod(k, F.lit(100)).cast("string"), 2, "0"), F.lit("-"),
                                  F.pmod(k, F.lit(10)).cast("string")))
        .when(form == 2, _cap_first(n))
        .when(form == 3, F.concat(n, F.lit(" sodium")))
        .when(form == 4, F.upper(n))
        .otherwise(F.concat(n, F.lit(" "), F.col("p_brand")))
    )
    parts = part.select(k.alias("CID"), derived.alias("Synonyms"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CID"), F.col("c_name").alias("Synonyms"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("CID"), F.col("s_name").alias("Synonyms"))
    return parts.unionByName(cust).unionByName(supp)


SYNONYMS_SQL = """
SELECT p_partkey AS CID,
  CASE p_partkey % 6
    WHEN 0 THEN 'CHEBI:' || CAST(p_partkey AS VARCHAR)
    WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), greatest(5, length(CAST(p_partkey AS VARCHAR)))::INTEGER, '0') || '-' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')
                || '-' || CAST(p_partkey % 10 AS VARCHAR)
    WHEN 2 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2)
    WHEN 3 THEN p_name || ' sodium'
    WHEN 4 THEN upper(p_name)
    ELSE p_name || ' ' || p_brand END AS Synonyms
FROM part
UNION ALL SELECT c_custkey AS CID, c_name AS Synonyms FROM customer
UNION ALL SELECT s_suppkey AS CID, s_name AS Synonyms FROM supplier
"""


# ---------------------------------------------------------------------------------------------
# Misspelt query names: each part name with two neighbouring letters swapped at a position
# chosen by the key.
# ---------------------------------------------------------------------------------------------

def misspelt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = F.col("p_name")
    i = F.pmod(F.col("p_partkey"), F.greatest(F.length(n) - 1, F.lit(1))) + 1
    swapped = F.concat(F.expr("substr(p_name, 1, i - 1)"), F.expr("substr(p_name, i + 1, 1)"),
                       F.expr("substr(p_name, i, 1)"), F.expr("substr(p_name, i + 2)"))
    return (part.select("p_partkey", "p_name", i.alias("i"))
            .select(F.col("p_partkey").alias("qid"), swapped.alias("name")))


MISSPELT_SQL = """
SELECT p_partkey AS qid,
  substr(p_name, 1, i - 1) || substr(p_name, i + 1, 1) || substr(p_name, i, 1) || substr(p_name, i + 2) AS name
FROM (SELECT p_partkey, p_name, (p_partkey % greatest(length(p_name) - 1, 1)) + 1 AS i FROM part)
"""


# ---------------------------------------------------------------------------------------------
# Structures (CID, SMILES) and annotations (CID, Categories, Route, mean price).
# ---------------------------------------------------------------------------------------------

def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure text from the part's size and name (a data column, like a real structure
    column - not a function of the key alone)."""
    part = table(spark, sf_dir, "part", spread=True)
    z = F.col("p_size")
    tail = (F.when(F.pmod(z, F.lit(3)) == 0, F.lit("O"))
            .when(F.pmod(z, F.lit(3)) == 1, F.lit("N")).otherwise(F.lit("(=O)O")))
    ring = F.when(F.length("p_name") > 9, F.lit("c1ccccc1")).otherwise(F.lit(""))
    return part.select(F.col("p_partkey").alias("CID"),
                       F.concat(F.expr("repeat('C', CAST(p_size % 7 + 1 AS INT))"), ring, tail).alias("SMILES"))


STRUCTURES_SQL = """
SELECT p_partkey AS CID,
  repeat('C', CAST(p_size % 7 + 1 AS INTEGER)) || CASE WHEN length(p_name) > 9 THEN 'c1ccccc1' ELSE '' END ||
  CASE p_size % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'N' ELSE '(=O)O' END AS SMILES
FROM part
"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem")
    # Mean of cent amounts as an exact integer sum over the count (no summation-order effects).
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = li.groupBy(F.col("l_partkey").alias("CID")).agg(
        (F.sum(cents) / (F.count(F.lit(1)) * 100.0)).alias("avg_price"))
    return (part.select(F.col("p_partkey").alias("CID"), F.col("p_type").alias("Categories"),
                        F.col("p_brand").alias("Route"))
            .join(price, "CID", "left"))


ANNOTATIONS_SQL = """
SELECT p.p_partkey AS CID, p.p_type AS Categories, p.p_brand AS Route, l.avg_price
FROM part p LEFT JOIN (SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
                               / (count(*) * 100.0)::DOUBLE AS avg_price FROM lineitem GROUP BY l_partkey) l
  ON p.p_partkey = l.l_partkey
"""


# ---------------------------------------------------------------------------------------------
# Recognised text: ground truth = benchmark texts; three engines' outputs are altered copies
# (letters replaced, commas dropped, words split); the third engine fails on every fifth image.
# ---------------------------------------------------------------------------------------------

def ocr_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.format_string("%03d", F.col("item_id")).alias("image_id"), F.col("text"))


def ocr_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    t = F.col("text")
    base_time = (F.pmod(F.col("item_id"), F.lit(7)) + 2).cast("double") / 10.0
    runs = [
        ("paddleocr", 0, F.replace(t, F.lit("e"), F.lit("c"))),
        ("doctr", 1, F.replace(t, F.lit(","), F.lit(""))),
        ("tesseract", 2, F.replace(t, F.lit("th"), F.lit("t h"))),
    ]
    parts = [b.select(F.format_string("%03d", F.col("item_id")).alias("image_id"), F.lit(e).alias("engine"),
                      txt.alias("text"), (base_time + F.lit(float(i))).alias("time"),
                      (F.pmod(F.col("item_id"), F.lit(5)) == 3).alias("fails"))
             for e, i, txt in runs]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.filter(~((F.col("engine") == "tesseract") & F.col("fails"))).drop("fails")


OCR_TRUTH_SQL = "SELECT printf('%03d', item_id) AS image_id, text FROM benchmark"

OCR_RUNS_SQL = """
SELECT printf('%03d', b.item_id) AS image_id, e.engine,
  CASE e.engine WHEN 'paddleocr' THEN replace(b.text, 'e', 'c') WHEN 'doctr' THEN replace(b.text, ',', '')
                ELSE replace(b.text, 'th', 't h') END AS text,
  CAST(b.item_id % 7 + 2 AS DOUBLE) / 10.0::DOUBLE + CAST(e.engine_idx AS DOUBLE) AS time
FROM benchmark b, (VALUES (0, 'paddleocr'), (1, 'doctr'), (2, 'tesseract')) e(engine_idx, engine)
WHERE NOT (e.engine = 'tesseract' AND b.item_id % 5 = 3)
"""


# ---------------------------------------------------------------------------------------------
# Hazard-class statements: two phrases per order, picked by the order key, so texts carry
# competing rules in either order.
# ---------------------------------------------------------------------------------------------

# Phrase book for the stand-in statements (our own wording, covering each rule).
HAZARD_PHRASES = [
    "Group 1: carcinogenic to humans",
    "group 2A probably carcinogenic",
    "2B, possibly carcinogenic to humans",
    "3, not classifiable",
    "Not listed by IARC",
    "No indication of carcinogenicity to humans",
    "Agents are not classifiable as to carcinogenicity",
    "1, carcinogenic (sufficient evidence)",
    "see the group 3 monograph",
    "IARC category 2b: limited evidence",
    "Not directly listed by IARC but by NTP",
    "unknown",
    "",
]


def hazard_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", spread=True)
    n = len(HAZARD_PHRASES)
    ph = F.array(*[F.lit(p) for p in HAZARD_PHRASES])
    k = F.col("o_orderkey")
    first = F.element_at(ph, (F.pmod(k, F.lit(n)) + 1).cast("int"))
    second = F.element_at(ph, (F.pmod(F.floor(k / n), F.lit(n)) + 1).cast("int"))
    return o.select(k, F.concat_ws(" ", first, second).alias("text"))


HAZARD_TEXTS_SQL = ("SELECT o_orderkey, concat_ws(' ', [" + ", ".join("'" + p.replace("'", "''") + "'"
                    for p in HAZARD_PHRASES) + f"][o_orderkey % {len(HAZARD_PHRASES)} + 1], ["
                    + ", ".join("'" + p.replace("'", "''") + "'" for p in HAZARD_PHRASES)
                    + f"][(o_orderkey // {len(HAZARD_PHRASES)}) % {len(HAZARD_PHRASES)} + 1]) AS text FROM orders")


# ---------------------------------------------------------------------------------------------
# Route lists: Python-list text per line item, three items picked by its keys.
# ---------------------------------------------------------------------------------------------

# Route item book for the stand-in lists (our own wording, covering each rule).
ROUTE_ITEMS = [
    "Oral (L2)", "inhalation", "Dermal", "eye contact", "Intravenous injection", "parenteral",
    "50% absorbed orally", "ingestion", "skin", "radiation", "ocular", "behavioral changes",
    "rapidly absorbed after oral dose in hours", "nan", "-", "", "Ocular.",
    "one two three four five six seven words", "Subcutaneous (rat)", "oral; dermal",
]


def route_list_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", spread=True)
    n = len(ROUTE_ITEMS)
    items = F.array(*[F.lit(p) for p in ROUTE_ITEMS])

    def pick(c):
        return F.element_at(items, (F.pmod(c, F.lit(n)) + 1).cast("int"))

    text = F.concat(F.lit("['"), pick(F.col("l_orderkey")), F.lit("', \""), pick(F.col("l_partkey")),
                    F.lit("\", '"), pick(F.col("l_suppkey") + F.col("l_linenumber")), F.lit("']"))
    return li.select("l_orderkey", "l_linenumber", text.alias("route_text"))


def _route_items_sql():
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in ROUTE_ITEMS) + "]"


ROUTE_TEXTS_SQL = (f"SELECT l_orderkey, l_linenumber, '[''' || {_route_items_sql()}[l_orderkey % {len(ROUTE_ITEMS)} + 1]"
                   f" || ''', \"' || {_route_items_sql()}[l_partkey % {len(ROUTE_ITEMS)} + 1] || '\", '''"
                   f" || {_route_items_sql()}[(l_suppkey + l_linenumber) % {len(ROUTE_ITEMS)} + 1] || ''']' AS route_text"
                   f" FROM lineitem")


# ---------------------------------------------------------------------------------------------
# Predictions: labelled documents; the true class is (quality, toxic); two rule-based
# predictors (by length and by language) stand in for trained models.
# ---------------------------------------------------------------------------------------------

def predictions(spark: SparkSession, sf_dir: str, model: str = "by_length") -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    truth = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    if model == "by_length":
        pred = (F.when(F.col("n_chars") < 500, "q0t0").when(F.col("n_chars") < 1500, "q1t0")
                .when(F.col("n_chars") < 4000, "q1t1").otherwise("unsure"))
    else:
        pred = F.when(F.col("lang") == "en", "q1t0").when(F.col("lang") == "de", "q0t0").otherwise("q1t1")
    return j.select(F.col("doc_id").alias("id"), truth.alias("label"), pred.alias("prediction"))


def predictions_sql(model: str = "by_length") -> str:
    if model == "by_length":
        pred = ("CASE WHEN d.n_chars < 500 THEN 'q0t0' WHEN d.n_chars < 1500 THEN 'q1t0' "
                "WHEN d.n_chars < 4000 THEN 'q1t1' ELSE 'unsure' END")
    else:
        pred = "CASE WHEN d.lang = 'en' THEN 'q1t0' WHEN d.lang = 'de' THEN 'q0t0' ELSE 'q1t1' END"
    return (f"SELECT d.doc_id AS id, 'q' || CAST(l.quality AS VARCHAR) || 't' || CAST(l.toxic AS VARCHAR) AS label, "
            f"{pred} AS prediction FROM documents d JOIN labels l USING (doc_id)")


# ---------------------------------------------------------------------------------------------
# Multi-label rows: line items with label lists from their own columns (truth) and a
# rule-based guess (prediction). 'rush' is never true, 'untaxed' never predicted.
# ---------------------------------------------------------------------------------------------

MULTILABEL_CLASSES = ["bulk", "discounted", "returned", "rush", "untaxed"]


def multilabel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", spread=True)

    def lst(*items):
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    truth = lst(F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_discount") >= 0.05, "discounted"),
                F.when(F.col("l_quantity") > 25, "bulk"), F.when(F.col("l_tax") == 0, "untaxed"))
    pred = lst(F.when(F.col("l_returnflag") != "N", "returned"), F.when(F.col("l_discount") > 0.05, "discounted"),
               F.when(F.col("l_quantity") >= 25, "bulk"), F.when(F.col("l_linenumber") == 1, "rush"))
    return li.select("l_orderkey", "l_linenumber", truth.alias("truth"), pred.alias("predicted"))


MULTILABEL_SQL = """
SELECT l_orderkey, l_linenumber,
  list_filter([CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_discount >= 0.05 THEN 'discounted' END,
               CASE WHEN l_quantity > 25 THEN 'bulk' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda x: x IS NOT NULL) AS truth,
  list_filter([CASE WHEN l_returnflag <> 'N' THEN 'returned' END, CASE WHEN l_discount > 0.05 THEN 'discounted' END,
               CASE WHEN l_quantity >= 25 THEN 'bulk' END, CASE WHEN l_linenumber = 1 THEN 'rush' END], lambda x: x IS NOT NULL) AS predicted
FROM lineitem"""


# ---------------------------------------------------------------------------------------------
# Label lists with a wide frequency range (for the frequent-label threshold of 50).
# ---------------------------------------------------------------------------------------------

def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", spread=True)
    labels = F.filter(F.array(
        F.concat(F.lit("rf"), F.col("l_returnflag")),
        F.concat(F.lit("p"), F.pmod(F.col("l_partkey"), F.lit(1500)).cast("string")),
        F.when(F.col("l_quantity") > 45, F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")))),
        lambda x: x.isNotNull())
    return li.select("l_orderkey", "l_linenumber", labels.alias("labels"))


LABEL_LISTS_SQL = """
SELECT l_orderkey, l_linenumber, list_filter(['rf' || l_returnflag, 'p' || CAST(l_partkey % 1500 AS VARCHAR),
  CASE WHEN l_quantity > 45 THEN 'q' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END], lambda x: x IS NOT NULL) AS labels
FROM lineitem"""


# ---------------------------------------------------------------------------------------------
# Search scores: per embedding row a (family, setting, fold, score in thousandths).
# ---------------------------------------------------------------------------------------------

def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    fam = F.element_at(F.array(F.lit("booster"), F.lit("forest"), F.lit("linear")),
                       (F.pmod(F.col("label"), F.lit(3)) + 1).cast("int"))
    return e.select(fam.alias("model"), F.concat(F.lit("depth="), F.pmod("vec_id", F.lit(8)).cast("string")).alias("params"),
                    F.pmod("vec_id", F.lit(5)).alias("fold"),
                    F.round(F.element_at("embedding", 1).cast("double") * 1000).cast("long").alias("score"))


SEARCH_SCORES_SQL = """
SELECT ['booster', 'forest', 'linear'][label % 3 + 1] AS model, 'depth=' || CAST(vec_id % 8 AS VARCHAR) AS params,
  vec_id % 5 AS fold, CAST(round(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) AS score FROM embeddings"""


# ---------------------------------------------------------------------------------------------
# Stored classification documents: one JSON text per event, shaped by the event key into the
# six cases of the source-priority rule (IARC only; T3DB twice; T3DB then IARC; neither source;
# no section; failed fetch = NULL). Built by plain concatenation so both engines hold the same text.
# ---------------------------------------------------------------------------------------------

_IARC = "International Agency for Research on Cancer (IARC)"
_T3DB = "Toxin and Toxin Target Database (T3DB)"


def _ref(no, name):
    return f'{{"ReferenceNumber":{no},"SourceName":"{name}"}}'


def _item(name, no, text_parts):
    return [f'{{"Name":"{name}","ReferenceNumber":{no},"Value":{{"StringWithMarkup":[{{"String":"'] + text_parts + ['"}]}}']


def _doc(refs, items):
    out = ['{"Record":{"Reference":[' + ",".join(refs) + '],"Section":[{"Section":[{"Section":[{"Information":[']
    for i, it in enumerate(items):
        if i:
            out.append(",")
        out.extend(it)
    out.append("]}]}]}]}}")
    return out


_GROUP = ("col", "grp")   # 'Group ' || (user_id % 3 + 1)
_ETYPE = ("col", "etype")  # event_type

DOC_CASES = [
    _doc([_ref(1, _IARC)], [_item("Other", 1, ["x"]), _item("IARC Carcinogenic Classes", 1, [_GROUP])]),
    _doc([_ref(2, _T3DB), _ref(5, _T3DB)], [_item("a", 2, [_ETYPE, " early"]), _item("b", 5, [_ETYPE, " late"])]),
    _doc([_ref(3, _T3DB), _ref(4, _IARC)], [_item("c", 3, ["t3db text"]), _item("IARC Carcinogenic Classes", 4, ["Group 2A"])]),
    _doc([_ref(7, "Other Source")], [_item("d", 7, [_ETYPE])]),
    ['{"Record":{"Reference":[' + _ref(1, _IARC) + "]}}"],
    None,
]


def _pieces_spark(parts):
    cols = {"grp": F.concat(F.lit("Group "), (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("string")),
            "etype": F.col("event_type")}
    return F.concat(*[cols[p[1]] if isinstance(p, tuple) else F.lit(p) for p in parts])


def _pieces_sql(parts):
    cols = {"grp": "('Group ' || CAST(user_id % 3 + 1 AS VARCHAR))", "etype": "event_type"}
    return " || ".join(cols[p[1]] if isinstance(p, tuple) else "'" + p.replace("'", "''") + "'" for p in parts)


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", spread=True)
    k = F.pmod(F.col("event_id"), F.lit(len(DOC_CASES)))
    doc = None
    for i, parts in enumerate(DOC_CASES):
        val = F.lit(None).cast("string") if parts is None else _pieces_spark(parts)
        doc = F.when(k == i, val) if doc is None else doc.when(k == i, val)
    return ev.select(F.col("event_id").alias("cid"), doc.alias("json"))


STORED_DOCUMENTS_SQL = ("SELECT event_id AS cid, CASE event_id % " + str(len(DOC_CASES)) + " "
                        + " ".join(f"WHEN {i} THEN " + ("NULL" if p is None else _pieces_sql(p))
                                   for i, p in enumerate(DOC_CASES)) + " END AS json FROM events")


# ---------------------------------------------------------------------------------------------
# Retry passes: events as input rows keyed by user; an 'error' event is a failed first pass;
# the retry succeeds for users with an even number of 'purchase' events.
# ---------------------------------------------------------------------------------------------

def first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    err = F.col("event_type") == "error"
    return ev.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("cid"),
                     F.when(err, F.lit("Not Available")).otherwise(
                         F.concat(F.lit("Group "), (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("string"))).alias("value"),
                     F.when(err, F.lit("Unknown")).otherwise(F.lit(_IARC)).alias("source"))


def retry_pass(spark: SparkSession, sf_dir: str, first: DataFrame) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    skipped = first.filter((F.col("value") == "Not Available") | (F.col("source") == "Unknown")).select("cid").distinct()
    # The retry succeeds for users with an even, non-zero number of purchase events.
    buyers = (ev.filter(F.col("event_type") == "purchase").groupBy(F.col("user_id").alias("cid"))
              .agg(F.count(F.lit(1)).alias("n")).filter(F.pmod("n", F.lit(2)) == 0).select("cid"))
    return (skipped.join(buyers.withColumn("ok", F.lit(True)), "cid", "left")
            .select("cid", F.when(F.col("ok"), F.lit("Group 2B")).otherwise(F.lit("Not Available")).alias("value"),
                    F.when(F.col("ok"), F.lit(_T3DB)).otherwise(F.lit("Unknown")).alias("source"),
                    F.explode(F.sequence(F.lit(1), F.when(F.pmod("cid", F.lit(4)) == 0, 2).otherwise(1))).alias("attempt")))


FIRST_PASS_SQL = f"""SELECT event_id AS row_id, user_id AS cid,
  CASE WHEN event_type = 'error' THEN 'Not Available' ELSE 'Group ' || CAST(user_id % 3 + 1 AS VARCHAR) END AS value,
  CASE WHEN event_type = 'error' THEN 'Unknown' ELSE '{_IARC}' END AS source FROM events"""

RETRY_OK_SQL = f"""SELECT DISTINCT f.cid FROM ({FIRST_PASS_SQL}) f
  WHERE (f.value = 'Not Available' OR f.source = 'Unknown')
    AND f.cid IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) % 2 = 0)"""


# ---------------------------------------------------------------------------------------------
# Dataset build inputs: compounds from parts (structures of length 11 made malformed, some statements
# missing) and a toxin table from line items (one-to-many on the part key).
# ---------------------------------------------------------------------------------------------

def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds: structure text and a hazard statement, both chosen by data columns of the
    part (size, name), not by the key - so no predicate on them is a predicate on the key."""
    s = structures(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("CID"), "p_size", "p_name")
    n = len(HAZARD_PHRASES)
    ph = F.array(*[F.lit(x) for x in HAZARD_PHRASES])
    pick = F.pmod(F.col("p_size") * 31 + F.length("p_name"), F.lit(n)) + 1
    smiles = F.when(F.length("SMILES") == 11, F.concat(F.col("SMILES"), F.lit("("))).otherwise(F.col("SMILES"))
    carc = F.when(F.pmod(F.col("p_size"), F.lit(17)) == 0, F.lit(None).cast("string")).otherwise(
        F.element_at(ph, pick.cast("int")))
    return s.join(p, "CID").select("CID", smiles.alias("SMILES"), carc.alias("Carcinogenicity"))


def _phrases_sql(items):
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in items) + "]"


COMPOUNDS_SQL = f"""SELECT s.CID, CASE WHEN length(s.SMILES) = 11 THEN s.SMILES || '(' ELSE s.SMILES END AS SMILES,
  CASE WHEN p.p_size % 17 = 0 THEN NULL
       ELSE {_phrases_sql(HAZARD_PHRASES)}[(p.p_size * 31 + length(p.p_name)) % {len(HAZARD_PHRASES)} + 1] END AS Carcinogenicity
FROM ({STRUCTURES_SQL}) s JOIN part p ON p.p_partkey = s.CID"""


def toxins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardframe.functions.text import split_list

    li = table(spark, sf_dir, "lineitem", spread=True)
    n = len(ROUTE_ITEMS)
    items = F.array(*[F.lit(p) for p in ROUTE_ITEMS])
    cats = F.when(F.col("l_returnflag") == "N", F.lit(None).cast("array<string>")).otherwise(
        split_list(F.concat(F.lit("flag "), F.col("l_returnflag"), F.lit(", status "), F.col("l_linestatus")), ","))
    route = F.array(F.element_at(items, (F.pmod("l_suppkey", F.lit(n)) + 1).cast("int")),
                    F.element_at(items, (F.pmod("l_orderkey", F.lit(n)) + 1).cast("int")))
    return li.select(F.col("l_partkey").alias("CID"), cats.alias("Categories"), route.alias("Route of Exposure"))


TOXINS_SQL = f"""SELECT l_partkey AS CID,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE ['flag ' || l_returnflag, 'status ' || l_linestatus] END AS Categories,
  [{_phrases_sql(ROUTE_ITEMS)}[l_suppkey % {len(ROUTE_ITEMS)} + 1], {_phrases_sql(ROUTE_ITEMS)}[l_orderkey % {len(ROUTE_ITEMS)} + 1]]
    AS "Route of Exposure"
FROM lineitem"""
