"""Table cleaning (B1-B6, B8, B9, D1, D7, H1-H3, H10) as DataFrame transformations.

``clean_table`` follows the reference's step order: column names -> keep/drop -> de-duplicate
-> trim -> fill -> lists -> newlines. Each step is a projection or one aggregation; the only
driver round trip is the one-row fill-value aggregate of ``fill_missing``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardframe.functions.text import _c, collapse_newlines, split_list, strip_ws

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class CleanReport:
    missing_keep: list[str] = field(default_factory=list)
    missing_drop: list[str] = field(default_factory=list)
    missing_list: list[str] = field(default_factory=list)
    missing_newline: list[str] = field(default_factory=list)
    removed: Observation | None = None

    def removed_duplicates(self) -> int:
        """Rows that de-duplication took out; known after an action on the cleaned frame."""
        got = self.removed.get
        return got["rows"] - got["distinct"]


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names stripped and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def select_columns(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None,
                   report: CleanReport | None = None) -> DataFrame:
    """B1/B2: keep listed columns in list order (wins over ``drop``), else drop listed ones;
    unknown names are reported, never fatal."""
    report = report if report is not None else CleanReport()
    if keep:
        report.missing_keep = [c for c in keep if c not in df.columns]
        return df.select(*[F.col(f"`{c}`") for c in keep if c in df.columns])
    if drop:
        report.missing_drop = [c for c in drop if c not in df.columns]
        return df.drop(*[c for c in drop if c in df.columns])
    return df


def dedupe(df: DataFrame, report: CleanReport | None = None) -> DataFrame:
    """Whole-row de-duplication (partial de-duplication before the shuffle). With a report the
    number of removed rows is observed in the same pass: equal rows are counted while they merge."""
    if report is None:
        return df.dropDuplicates()
    report.removed = Observation()
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.observe(report.removed, F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct"))
    return counted.drop("__n")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def trim_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """H1: strip Unicode whitespace from string columns; missing stays missing (documented
    difference: the reference turns missing into the text 'nan' here)."""
    cols = string_columns(df) if cols is None else cols
    return df.select(*[strip_ws(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def _known(field: T.StructField) -> Column:
    """A column with NaN as missing too."""
    c = F.col(f"`{field.name}`")
    return F.when(~F.isnan(c), c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c


def fill_values(df: DataFrame, cols: list[str] | None = None) -> dict:
    """D7 statistics: mean for numbers, smallest most-frequent value for text, only for columns
    that have a missing value (NULL, or NaN in a floating column). One aggregate for counts and
    means, one for the modes of all text columns together."""
    cols = df.columns if cols is None else cols
    fields = {f.name: f for f in df.schema.fields}
    aggs = []
    for c in cols:
        aggs.append(F.count(_known(fields[c])).alias(f"n__{c}"))
        if isinstance(fields[c].dataType, _NUMERIC):
            aggs.append(F.avg(_known(fields[c])).alias(f"v__{c}"))
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs).first().asDict()  # one row
    gaps = [c for c in cols if row[f"n__{c}"] < row["__rows"]]
    out = {c: row[f"v__{c}"] for c in gaps if row.get(f"v__{c}") is not None}
    texts = [c for c in gaps if isinstance(fields[c].dataType, T.StringType)]
    if texts:
        # (column, value) counts of all text columns in one pass, then the best value per column:
        # most frequent first, smallest among ties.
        pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in texts])))
        counts = pairs.filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("v"))
        out.update({r["c"]: r["v"] for r in best.collect()})  # one row per text column
    return out


def fill_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns with gaps become DOUBLE filled with their mean; text columns with
    gaps get their (smallest) mode."""
    vals = fill_values(df, cols)
    fields = {f.name: f for f in df.schema.fields}
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in vals:
            if isinstance(fields[c].dataType, _NUMERIC):
                col = F.coalesce(_known(fields[c]).cast("double"), F.lit(float(vals[c])))
            else:
                col = F.coalesce(col, F.lit(vals[c]))
        out.append(col.alias(c))
    return df.select(*out)


def to_lists(df: DataFrame, cols: list[str], separators: dict | None = None,
             report: CleanReport | None = None) -> DataFrame:
    """H2: listed columns -> ARRAY<STRING> by their separator (default ',')."""
    separators = separators or {}
    if report is not None:
        report.missing_list = [c for c in cols if c not in df.columns]
    return df.select(*[split_list(F.col(f"`{c}`"), separators.get(c, ",")).alias(c) if c in cols
                       else F.col(f"`{c}`") for c in df.columns])


def newlines_to_space(df: DataFrame, cols: list[str], report: CleanReport | None = None) -> DataFrame:
    """H3: CR/LF runs -> one space in the listed columns."""
    if report is not None:
        report.missing_newline = [c for c in cols if c not in df.columns]
    return df.select(*[collapse_newlines(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def clean_table(df: DataFrame, drop_columns=None, keep_columns=None, drop_duplicates: bool = True,
                fill: bool = True, lowercase_columns: bool = True, trim: bool = True, list_columns=None,
                list_separators=None, newline_to_space_columns=None) -> tuple[DataFrame, CleanReport]:
    """Frame in, frame out; returns the cleaned frame and the report of unknown column names."""
    report = CleanReport()

    def names(xs):
        return [x.lower() for x in xs] if (xs and lowercase_columns) else xs

    if lowercase_columns:
        df = normalize_names(df)
    df = select_columns(df, names(keep_columns), names(drop_columns), report)
    if drop_duplicates:
        df = dedupe(df, report)
    if trim:
        df = trim_strings(df)
    if fill:
        df = fill_missing(df)
    if list_columns:
        seps = {(k.lower() if lowercase_columns else k): v for k, v in (list_separators or {}).items()}
        df = to_lists(df, [c for c in names(list_columns)], seps, report)
    if newline_to_space_columns:
        df = newlines_to_space(df, names(newline_to_space_columns), report)
    return df, report


# Decimal numbers with an optional exponent; Java literals such as 12d or 0x1p4 are no numbers.
DECIMAL_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def coerce_key(col) -> Column:
    """Text -> decimal number -> nullable BIGINT; unparsable, fractional or infinite -> NULL. Texts of digits alone
    are read as whole numbers, so ids beyond 2^53 keep their last digits."""
    text = F.trim(_c(col).cast("string"))
    d = F.when(text.rlike(DECIMAL_NUMBER), text.try_cast("double"))
    ok = d.isNotNull() & ~F.isnan(d) & (d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18))
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long")).when(ok, d.cast("long"))


def clip(col, lo: float = -1e15, hi: float = 1e15) -> Column:
    """Clip to [lo, hi]; NaN and NULL pass through (bare least/greatest would not)."""
    c = _c(col)
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def not_sentinel(col, sentinel: str = "No data") -> Column:
    """``!= sentinel`` that keeps missing rows (plain <> would drop NULLs)."""
    return ~_c(col).eqNullSafe(F.lit(sentinel))


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Analysis-time check; raises before any job runs."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Required column(s) not found: {missing}")
    return df


def column_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """B7 over the rows: each required column, whether the frame has it, and how many of its values are not missing (one aggregate)."""
    here = [c for c in cols if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(here)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(c in here).alias("present"),
                     (F.col(f"n{here.index(c)}") if c in here else F.lit(0).cast("long")).alias("values"), F.col("rows").alias("rows")) for c in cols]
    return one.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, n_cols: int = 10, n_rows: int = 5, order: list[str] | None = None) -> DataFrame:
    """the first ``n_cols`` columns of ``n_rows`` rows (an interactive peek), the first ones in ``order`` if given."""
    rows = df.orderBy(*order) if order else df
    return rows.limit(n_rows).select(*df.columns[:n_cols])
