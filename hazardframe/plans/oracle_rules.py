"""SQL (DuckDB dialect) twins of the rule Columns, generated from the same fixed rule lists.

Only used to build the oracle queries. DuckDB's RE2 has no look-ahead and no Unicode classes,
so look-ahead patterns become two regexes joined by AND, and digits / capitals are ASCII
(the oracle inputs are ASCII).
"""

from __future__ import annotations

from hazardframe.functions import rules as R

_LOOKAHEAD = r"^(?=.*\d.*\d)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def identifier_reason_sql(c: str) -> str:
    plain_cs, plain_ci, extra = [], [], []
    for _, p, ci in R.IDENTIFIER_PATTERNS:
        if p.startswith(_LOOKAHEAD):
            body = "^" + p[len(_LOOKAHEAD):]
            extra.append(f"(regexp_matches({c}, {_q(body)}) AND regexp_matches({c}, {_q(r'^.*[0-9].*[0-9]')}))")
        else:
            (plain_ci if ci else plain_cs).append(p)
    cs_re = "^(?:" + "|".join(f"(?:{p})" for p in plain_cs) + ")"
    ci_re = "(?i)^(?:" + "|".join(f"(?:{p})" for p in plain_ci) + ")"
    digits = f"(length({c}) - length(regexp_replace({c}, '[0-9]', '', 'g')))"
    uppers = f"(length({c}) - length(regexp_replace({c}, '[A-Z]', '', 'g')))"
    markers = " OR ".join(
        [f"contains({c}, {_q(m)})" for m in R.MARKER_SUBSTRINGS]
        + [f"(contains({c}, '/') AND contains({c}, '\\'))", f"contains({c}, '@')"]
        + [f"contains(lower({c}), {_q(m)})" for m in R.MARKER_SUBSTRINGS_LOWER])
    formula = f"(regexp_matches({c}, {_q('^(?:' + R.FORMULA_PATTERN + ')')}) AND {digits} = 0)"
    pattern = " OR ".join([f"regexp_matches({c}, {_q(cs_re)})", f"regexp_matches({c}, {_q(ci_re)})"]
                          + extra + [markers, formula])
    return f"""CASE
  WHEN {c} IS NULL THEN 'null'
  WHEN length({c}) > 0 AND {digits} / length({c}) > {R.MAX_DIGIT_RATIO} THEN 'digit_ratio'
  WHEN length({c}) <= {R.SHORT_WITH_DIGIT_LEN} AND {digits} > 0 THEN 'short_with_digit'
  WHEN {pattern} THEN 'pattern'
  WHEN length({c}) > {R.MAX_NAME_LEN} OR {uppers} > {R.MAX_UPPER} THEN 'long_or_capitals'
END"""


def is_identifier_sql(c: str) -> str:
    return f"(({identifier_reason_sql(c)}) IS NOT NULL)"


def _pos_sql(t: str, p: str) -> str:
    """1-based start of the first match of p in t, 0 when none (RE2 has no regexp_instr)."""
    return (f"CASE WHEN regexp_matches({t}, {_q(p)}) THEN "
            f"length(regexp_extract({t}, {_q('(?s)^(.*?)(?:' + p + ')')}, 1)) + 1 ELSE 0 END")


def classify_first_match_sql(c: str, overriding=None, rules=None, default: str = R.CARCINOGENICITY_DEFAULT) -> str:
    overriding = R.CARCINOGENICITY_OVERRIDING if overriding is None else overriding
    rules = R.CARCINOGENICITY_RULES if rules is None else rules
    t = f"lower({strip_sql(c)})"
    hits = ", ".join(f"{{'pos': {_pos_sql(t, '(?i)' + p)}, 'idx': {i}, 'code': {_q(code)}}}"
                     for i, (p, code) in enumerate(rules))
    first = f"list_min(list_filter([{hits}], lambda h: h.pos > 0))"
    out = f"coalesce(({first}).code, {_q(default)})"
    for p, code in reversed(overriding):
        out = f"CASE WHEN regexp_matches({t}, {_q('(?i)' + p)}) THEN {_q(code)} ELSE {out} END"
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN {_q(default)} ELSE {out} END"


# Python's str.isspace() characters as an RE2 class (same set as the Column side).
_WS = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
       r"\x{205f}\x{3000}]")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def normalize_route_sql(x: str) -> str:
    t = strip_sql(x)
    low = f"lower(regexp_replace({t}, '{_WS}*\\([^)]*\\)', '', 'g'))"
    words = f"string_split_regex({strip_sql(low)}, '{_WS}+')"
    n_words = f"(CASE WHEN {strip_sql(low)} = '' THEN 0 ELSE len({words}) END)"
    reject = " OR ".join(
        [f"regexp_matches({low}, '[0-9]+%')", f"regexp_matches({low}, {_q(R.ROUTE_REJECT_PATTERN)})"]
        + [f"contains({low}, {_q(s)})" for s in R.ROUTE_REJECT_SUBSTRINGS]
        + [f"{n_words} > {R.ROUTE_MAX_WORDS}"])
    single = f"regexp_replace(({words})[1], '^[.,;:]+|[.,;:]+$', '', 'g')"
    whens = "".join(
        f" WHEN {' OR '.join(f'contains({low}, {_q(term)})' for term in terms)} THEN {_q(label)}"
        for label, terms in R.ROUTE_KEYWORDS)
    labels = ", ".join(_q(x) for x in R.ROUTE_LABELS)
    empties = ", ".join(_q(x) for x in R.ROUTE_EMPTY_TOKENS)
    return (f"(CASE WHEN {x} IS NULL OR lower({t}) IN ({empties}) THEN NULL WHEN {reject} THEN NULL{whens}"
            f" WHEN {n_words} = 1 AND {single} IN ({labels}) THEN {single} ELSE NULL END)")


def normalize_routes_sql(arr: str) -> str:
    kept = f"list_filter(list_transform({arr}, lambda r: {normalize_route_sql('r')}), lambda r: r IS NOT NULL)"
    return f"(CASE WHEN {arr} IS NULL OR len({kept}) = 0 THEN ['No data'] ELSE {kept} END)"


_LIST_ITEM_RE2 = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def parse_list_text_sql(x: str) -> str:
    def unq(v):
        b = f"substr({v}, 2, length({v}) - 2)"
        b = f"replace({b}, '\\\\', chr(0))"
        for a, c in (("\\n", "chr(10)"), ("\\t", "chr(9)"), ("\\r", "chr(13)"), ("\\'", "''''"), ('\\"', "'\"'")):
            b = f"replace({b}, {_q(a)}, {c})"
        return f"replace({b}, chr(0), '\\')"
    items = f"regexp_extract_all({x}, {_q(_LIST_ITEM_RE2)}, 0)"
    return f"(CASE WHEN {x} IS NULL THEN []::VARCHAR[] ELSE list_transform({items}, lambda v: {unq('v')}) END)"


def split_list_sql(x: str, sep: str) -> str:
    return (f"list_transform(string_split({x}, {_q(sep)}), "
            f"lambda s: regexp_replace({strip_sql('s')}, '^\"+|\"+$', '', 'g'))")
