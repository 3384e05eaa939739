"""DuckDB twins of the text Columns (oracle side only).

DuckDB's ``levenshtein`` counts bytes, so both character and word sequences are first mapped
to one ASCII byte per distinct symbol of the pair (at most 127 symbols; more gives NULL and
shows up as a mismatch instead of a wrong number).
"""

from __future__ import annotations

# Python's str.isspace() characters as an RE2 class.
WS_RE2 = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
          r"\x{205f}\x{3000}]")


def normalize_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '{WS_RE2}+', ' ', 'g')))"


def round_ratio_sql(n: str, m: str, digits: int = 4) -> str:
    scale, five = 10 ** digits, 5 ** digits
    q = f"(({n}) * {scale} // ({m}))"
    r = f"(({n}) * {scale} % ({m}))"
    big_n = f"(2 * {q} + 1)"
    s = f"CAST(52 - floor(log2({big_n} / {float(five)})) AS INTEGER)"
    pow2 = (f"((((1::BIGINT << ({s} // 2)) % {five}) * ((1::BIGINT << ({s} - {s} // 2)) % {five})) % {five})")
    rho = f"((({big_n} % {five}) * {pow2}) % {five})"
    tie_up = f"(CASE WHEN {big_n} % {five} = 0 THEN {q} % 2 = 1 ELSE {rho} * 2 > {five} END)"
    up = f"(CASE WHEN 2 * {r} > ({m}) THEN true WHEN 2 * {r} < ({m}) THEN false ELSE {tie_up} END)"
    return f"(CAST(CASE WHEN {up} THEN {q} + 1 ELSE {q} END AS DOUBLE) / {float(scale)}::DOUBLE)"


def _symbols(x: str, unit: str) -> str:
    if unit == "char":
        return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END)"
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END)"


def _distance(np_: str, nt: str, unit: str) -> str:
    sp, st = _symbols(np_, unit), _symbols(nt, unit)
    vocab = f"list_distinct(list_concat({sp}, {st}))"

    def code(lst):
        return f"array_to_string(list_transform({lst}, lambda c: chr(list_position({vocab}, c))), '')"

    return f"(CASE WHEN len({vocab}) > 127 THEN NULL ELSE levenshtein({code(sp)}, {code(st)}) END)"


def error_rate_sql(p: str, t: str, unit: str, digits: int = 4) -> str:
    np_, nt = normalize_sql(p), normalize_sql(t)
    n_ref = f"len({_symbols(nt, unit)})"
    dist = _distance(np_, nt, unit)
    return f"""(CASE WHEN {t} IS NULL OR {t} = '' THEN 1.0::DOUBLE
      WHEN {np_} = '' THEN (CASE WHEN {n_ref} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
      WHEN {n_ref} = 0 THEN 1.0::DOUBLE
      ELSE {round_ratio_sql(dist, n_ref, digits)} END)"""
