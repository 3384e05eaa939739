"""Feature operators (H10, U1-U4, G3) and the dataset build.

U3 ships chemistry-free structure-text features as built-in Columns (no Python worker). U1/U2
let a user plug in any per-row feature function; it runs batch-wise through ``mapInPandas``
with a success flag, and a failure gives NULL features instead of an exception.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardframe.functions.rules import NO_DATA, classify_first_match, no_data_if_empty, normalize_routes
from hazardframe.functions.text import _c
from hazardframe.session import scratch_path

#: Rows of one key from which the toxin side of the dataset join is salted.
HOT_ROWS = 50_000
#: So many hot keys, each a number or short text, are broadcast.
BROADCAST_KEYS = 100_000

# Tokens counted by the structure-text features (two-letter halogens first).
ELEMENT_TOKENS = ["Cl", "Br", "C", "N", "O", "S", "P", "F", "I", "c", "n", "o", "s"]
BOND_TOKENS = {"double_bonds": "=", "triple_bonds": "#", "branches": "(", "bracket_atoms": "[",
               "fragments_sep": ".", "plus": "+", "minus": "-"}


def count_token(col, tok: str) -> Column:
    """Occurrences of a literal token (non-overlapping), via length difference - no regex."""
    c = _c(col)
    return ((F.length(c) - F.length(F.replace(c, F.lit(tok), F.lit("")))) / len(tok)).cast("int")


def _balanced(col, open_ch: str, close_ch: str) -> Column:
    """True when every ``close_ch`` closes an earlier ``open_ch`` and all are closed."""
    chars = F.split(_c(col), "")
    depth = F.aggregate(chars, F.lit(0), lambda acc, ch: F.when(acc < 0, acc).when(ch == open_ch, acc + 1)
                        .when(ch == close_ch, F.when(acc == 0, F.lit(-1_000_000)).otherwise(acc - 1)).otherwise(acc))
    return depth == 0


def structure_features(col) -> dict[str, Column]:
    """Named Columns of text features of a line notation; ``desc_ok`` is the success flag."""
    c = _c(col)
    out: dict[str, Column] = {}
    cl = count_token(c, "Cl")
    for tok in ELEMENT_TOKENS:
        n = count_token(c, tok)
        if tok == "C":
            n = n - cl          # 'C' inside 'Cl' is chlorine
        out[f"n_{tok}" if tok.isupper() or len(tok) > 1 else f"n_arom_{tok}"] = n.cast("int")
    for name, tok in BOND_TOKENS.items():
        out[name] = count_token(c, tok)
    out["ring_digits"] = F.length(F.regexp_replace(c, "[^0-9%]", ""))
    out["length"] = F.length(c)
    out["heavy_atoms"] = sum((out[k] for k in out if k.startswith("n_")), F.lit(0)).cast("int")
    out["fragments"] = (out["fragments_sep"] + 1).cast("int")
    ok = (c.isNotNull() & (F.length(c) > 0) & _balanced(c, "(", ")") & _balanced(c, "[", "]"))
    out["desc_ok"] = F.coalesce(ok, F.lit(False))
    return out


def with_structure_features(df: DataFrame, col: str = "SMILES") -> DataFrame:
    """Attach the feature columns; features are NULL where the flag is false."""
    feats = structure_features(F.col(col))
    ok = feats.pop("desc_ok")
    # The flag is projected first and referenced by name: Catalyst keeps a non-trivial
    # expression that is used more than once in its own projection instead of inlining it.
    staged = df.withColumn("desc_ok", ok)
    return staged.select(*df.columns, "desc_ok",
                         *[F.when(F.col("desc_ok"), v).otherwise(F.lit(None).cast("int")).alias(k)
                           for k, v in feats.items()])


def featurize(df: DataFrame, fn: Callable[[str], dict], input_col: str, schema: T.StructType,
              per_feature: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Run ``fn(value) -> {name: number}`` on each row, batch-wise in a Python worker.

    Output: ``keep`` columns, ``desc_ok`` (bool) and one column per field of ``schema``. A
    raising or non-dict result gives desc_ok = False and NULL features (U1). With
    ``per_feature=True`` a callable value in the dict is evaluated separately and only a
    failing feature becomes NULL (U2).
    """
    keep = keep or [c for c in df.columns]
    names = [f.name for f in schema.fields]
    out_schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("desc_ok", T.BooleanType())]
                              + list(schema.fields))

    def run(batches):
        for pdf in batches:
            rows = []
            for v in pdf[input_col]:
                try:
                    res = fn(v)
                    ok = isinstance(res, dict)
                except Exception:  # noqa: BLE001 - a failing row is data, not a job failure
                    res, ok = None, False
                vals = []
                for n in names:
                    x = None
                    if ok:
                        x = res.get(n)
                        if per_feature and callable(x):
                            try:
                                x = x()
                            except Exception:  # noqa: BLE001
                                x = None
                    vals.append(x)
                rows.append([ok] + vals)
            feat = pd.DataFrame(rows, columns=["desc_ok"] + names, index=pdf.index)
            yield pd.concat([pdf[keep], feat], axis=1)

    return df.select(*keep, *([input_col] if input_col not in keep else [])).mapInPandas(run, out_schema)


def _outer_join_salted(left: DataFrame, right: DataFrame, right_keys: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """``left`` outer join ``right`` on ``key``, with hot keys of the right side split if there are any.

    AQE splits a hot key of the preserved side by itself, but never one of the other side. Keys with more than ``hot_rows``
    rows there are listed first, in a job over the key column alone. Mostly there are none, and the join is a plain one.
    Else each gets ceil(rows / hot_rows) salts: its rows are dealt over them and the few left rows with that key are
    repeated once per salt. A repeated left row that meets no row under its salt is dropped, as the key has a match under
    another one. The list (at most rows / hot_rows keys) is broadcast up to BROADCAST_KEYS keys and joined otherwise."""
    counts = right_keys.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > hot_rows) & F.col(key).isNotNull())
    counts = counts.select(key, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts"))
    path = scratch_path(left.sparkSession, "hot-keys")
    counts.write.parquet(path)
    salts = left.sparkSession.read.schema(counts.schema).parquet(path)
    hot = salts.count()
    if not hot:
        return left.join(right, key, "left")
    salts = F.broadcast(salts) if hot <= BROADCAST_KEYS else salts
    one = F.coalesce("__salts", F.lit(1))
    spread = F.pmod(F.xxhash64("__id"), one)  # numbered before any shuffle, so a repeated task deals alike
    r = right.withColumn("__id", F.monotonically_increasing_id()).join(salts, key, "left").withColumn("__salt", spread.cast("int")).drop("__salts", "__id").withColumn("__met", F.lit(True))
    a = left.join(salts, key, "left").withColumn("__once", one == 1).withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__salts")
    return a.join(r, [key, "__salt"], "left").filter(F.col("__once") | F.col("__met").isNotNull()).drop("__salt", "__once", "__met")


def label_dataset(compounds: DataFrame, toxins: DataFrame, featurized: DataFrame | None = None,
                  key: str = "CID", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The dataset build (L2) before its filter; keeps the ``desc_ok`` flag.

    ``compounds``: CID, SMILES, Carcinogenicity (raw text). ``toxins``: CID, Categories (array),
    Route of Exposure (array). Descriptors: U3 Columns unless ``featurized`` (CID, desc_ok,
    features...) is given. Left join on CID: one-to-many multiplies rows, NULL keys follow the
    SQL rule. The join strategy is left to AQE (broadcast when the toxin table is small at run
    time, a shuffle join otherwise); toxin keys of more than ``hot_rows`` rows are salted.
    """
    if featurized is None:
        base = with_structure_features(compounds, "SMILES")
    else:
        base = compounds.join(featurized, key, "left").withColumn("desc_ok", F.coalesce("desc_ok", F.lit(False)))
    feature_cols = [c for c in base.columns if c not in (key, "SMILES", "Carcinogenicity", "desc_ok")]
    # Labels are normalised on each side before the one-to-many join, so every statement and
    # every route list is classified once, not once per joined row.
    carc = classify_first_match(F.coalesce(F.col("Carcinogenicity").cast("string"), F.lit("nan")))
    left = base.select(key, carc.alias("Carcinogenicity"), "desc_ok", *feature_cols)
    tox = toxins.select(key, "Categories", normalize_routes(F.col("`Route of Exposure`")).alias("Route"))
    j = _outer_join_salted(left, tox, toxins.select(key), key, hot_rows)
    return j.select(key, "Carcinogenicity", no_data_if_empty(F.col("Categories")).alias("Categories"),
                    F.coalesce(F.col("Route"), F.array(F.lit(NO_DATA))).alias("Route"), "desc_ok", *feature_cols)


def _no_tox() -> Column:
    return ((F.col("Carcinogenicity") == NO_DATA) & (F.col("Categories") == F.array(F.lit(NO_DATA)))
            & (F.col("Route") == F.array(F.lit(NO_DATA))))


def build_dataset(compounds: DataFrame, toxins: DataFrame, featurized: DataFrame | None = None,
                  key: str = "CID", observation: Observation | None = None) -> DataFrame:
    """Keep rows whose descriptors succeeded and that are not 'No data' in all three
    label fields; the drop counters go to ``observation`` from the same pass (D9)."""
    j = label_dataset(compounds, toxins, featurized, key)
    feature_cols = [c for c in j.columns if c not in (key, "Carcinogenicity", "Categories", "Route", "desc_ok")]
    if observation is not None:
        j = j.observe(observation, F.count(F.lit(1)).alias("rows"),
                      F.sum((~F.col("desc_ok")).cast("long")).alias("desc_failures"),
                      F.sum((F.col("desc_ok") & _no_tox()).cast("long")).alias("no_tox_data"))
    return (j.filter(F.col("desc_ok") & ~_no_tox()).drop("desc_ok")
            .select(key, "Carcinogenicity", "Categories", "Route", *feature_cols))


def drop_counts(df: DataFrame) -> DataFrame:
    """D9/U4 in one aggregate for a frame that still has ``desc_ok`` and the three labels."""
    no_tox = _no_tox()
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum((~F.col("desc_ok")).cast("long")).alias("desc_failures"),
                  F.sum((F.col("desc_ok") & no_tox).cast("long")).alias("no_tox_data"),
                  F.sum((F.col("desc_ok") & ~no_tox).cast("long")).alias("kept"))
