"""Nested-document source priority (A10, E2, H13, Q17) and retry reconciliation.

Documents are stored JSON texts (the fetch itself is outside this engine); a NULL text is a
failed fetch. Everything is array/struct expressions on one row - no shuffle - except the
retry merge, which is two joins and a grouped minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.text import _let

# Sources in priority order and the item name that carries the class.
IARC = "International Agency for Research on Cancer (IARC)"
T3DB = "Toxin and Toxin Target Database (T3DB)"
IARC_ITEM_NAME = "IARC Carcinogenic Classes"
NOT_AVAILABLE = "Not Available"
UNKNOWN = "Unknown"
ERROR = "Error"

DOC_SCHEMA = (
    "Record STRUCT<Reference: ARRAY<STRUCT<ReferenceNumber: INT, SourceName: STRING>>, "
    "Section: ARRAY<STRUCT<Section: ARRAY<STRUCT<Section: ARRAY<STRUCT<Information: ARRAY<STRUCT<"
    "Name: STRING, ReferenceNumber: INT, Value: STRUCT<StringWithMarkup: ARRAY<STRUCT<String: STRING>>>>>>>>>>>>"
)


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def resolve_priority(json_col) -> Column:
    """Struct(value, source, status) for one stored document.

    source: the first IARC reference if any, else the last T3DB reference, else 'Unknown'.
    value:  for IARC the first information item named 'IARC Carcinogenic Classes', for T3DB
            the first item whose ReferenceNumber equals the chosen one (missing numbers = 0).
    status: 'ok', 'not_available' (no source or no item), 'error' (missing sections or
            markup, unreadable document) or 'failed_fetch' (NULL document).
    """
    j = F.col(json_col) if isinstance(json_col, str) else json_col

    def with_doc(doc: Column) -> Column:
        refs = F.coalesce(doc["Record"]["Reference"],
                          F.array().cast("array<struct<ReferenceNumber:int,SourceName:string>>"))
        iarc = F.filter(refs, lambda r: r["SourceName"] == IARC)
        t3db = F.filter(refs, lambda r: r["SourceName"] == T3DB)
        chosen = F.coalesce(_first(iarc), F.try_element_at(t3db, F.lit(-1)))
        s3 = _first(_first(_first(doc["Record"]["Section"])["Section"])["Section"])

        def with_chosen(ch: Column) -> Column:
            source = F.coalesce(ch["SourceName"], F.lit(UNKNOWN))
            ref_no = F.coalesce(ch["ReferenceNumber"], F.lit(0))

            def with_s3(sec: Column) -> Column:
                info = F.coalesce(sec["Information"], F.array().cast(
                    "array<struct<Name:string,ReferenceNumber:int,"
                    "Value:struct<StringWithMarkup:array<struct<String:string>>>>>"))
                item = (F.when(source == IARC, _first(F.filter(info, lambda i: i["Name"] == IARC_ITEM_NAME)))
                        .when(source == T3DB, _first(F.filter(
                            info, lambda i: F.coalesce(i["ReferenceNumber"], F.lit(0)) == ref_no))))

                def with_item(it: Column) -> Column:
                    markup = _first(it["Value"]["StringWithMarkup"])
                    status = (F.when(j.isNull(), F.lit("failed_fetch"))
                              .when(doc.isNull() | sec.isNull(), F.lit("error"))
                              .when(it.isNull(), F.lit("not_available"))
                              .when(markup.isNull(), F.lit("error"))
                              .otherwise(F.lit("ok")))

                    def out(st: Column) -> Column:
                        value = (F.when(st == "failed_fetch", F.lit(NOT_AVAILABLE)).when(st == "error", F.lit(ERROR))
                                 .when(st == "not_available", F.lit(NOT_AVAILABLE))
                                 .otherwise(F.coalesce(markup["String"], F.lit(""))))
                        src = (F.when(st == "failed_fetch", F.lit(UNKNOWN)).when(st == "error", F.lit(ERROR))
                               .otherwise(source))
                        return F.struct(value.alias("value"), src.alias("source"), st.alias("status"))

                    return _let(status, out)

                return _let(item, with_item)

            return _let(s3, with_s3)

        return _let(chosen, with_chosen)

    # Each intermediate (parsed document, chosen reference, section, item) is bound once.
    return _let(F.from_json(j, DOC_SCHEMA), with_doc)


def is_skipped(value: Column, source: Column) -> Column:
    """A first-pass result that goes to the retry list."""
    return (value == NOT_AVAILABLE) | (source == UNKNOWN) | (value == ERROR)


def retry_merge(first: DataFrame, retry: DataFrame, key: str = "cid", order: str = "row_id",
                value: str = "value", source: str = "source", retry_order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply successful retry results; return (merged rows, failed ledger).

    ``first``: one row per input row (key, order, value, source). ``retry``: one row per retried
    attempt (key, value, source). A retry succeeds when its value is not 'Not Available' and its
    source is not 'Unknown'; of several successes of a key the last one counts (greatest
    ``retry_order``, or without it the greatest (source, value)). It replaces the first-pass
    result on the first input row of that key (smallest ``order``). The ledger keeps the skipped
    rows whose key did not succeed.

    Successes are first reduced to (key, first row): a pair that one input row has at most, so
    the join that touches all rows has no hot key, whatever the keys are.
    """
    picked = F.struct(*([F.col(retry_order).alias("o")] if retry_order else []), F.col(source).alias("__rs"), F.col(value).alias("__rv"))
    ok = (retry.filter(~((F.col(value) == NOT_AVAILABLE) | (F.col(source) == UNKNOWN)))
          .groupBy(key).agg(F.max(picked).alias("r")).select(key, "r.__rv", "r.__rs"))
    firsts = first.groupBy(key).agg(F.min(order).alias(order))
    hits = ok.join(firsts, key).withColumn("__hit", F.lit(True))
    m = first.join(hits, [key, order], "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    merged = m.select(*[c for c in first.columns if c not in (value, source)],
                      F.when(F.col("__hit"), F.col("__rv")).otherwise(F.col(value)).alias(value),
                      F.when(F.col("__hit"), F.col("__rs")).otherwise(F.col(source)).alias(source))
    ledger = (first.filter(is_skipped(F.col(value), F.col(source))).select(order, key)
              .join(ok.select(key), key, "left_anti"))
    return merged, ledger
