"""Domain rules as Column builders (R1-R8): identifier names, hazard class, exposure route.

Rules are data: each builder takes its pattern / keyword lists as parameters, with the fixed
defaults below. All patterns run on the JVM (java.util.regex); the inline flags make them
behave like Python's ``re`` on ``str``:
  (?U)  Unicode \\d \\s \\w \\b (and Unicode case folding with (?i))
  (?d)  only '\\n' ends a line, so '.' and '$' act as in Python
``re.match`` is anchored at the start only, so every pattern is wrapped as ``^(?:...)``.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardframe.functions.text import _c, _let, strip_ws

# ---------------------------------------------------------------------------------------------
# Identifier patterns (R5), in the order the name filter defines them.
# (name, pattern, case-blind). A match anywhere in this list marks a name as an identifier.
# ---------------------------------------------------------------------------------------------
IDENTIFIER_PATTERNS: list[tuple[str, str, bool]] = [
    ("cas", r"^\d{2,7}-\d{2}-\d$", False),
    ("embedded_cas", r"^CAS-\d{2,7}-\d{2}-\d$|Caswell No.", True),
    ("unii", r"^UNII-[A-Z0-9]+$", False),
    ("inchikey", r"^Q\d{23}$", False),
    ("chebi", r"^CHEBI:\d+$", False),
    ("drugbank", r"^DB\d+$", False),
    ("kegg", r"^[CDGR]\d{5}$", False),
    ("hmdb", r"^HMDB\d+$", False),
    ("lipidmaps", r"^LM[A-Z0-9]+$", False),
    ("pdb", r"^[A-Z0-9]{4}$", False),
    ("chemspider", r"^CS-\d+$", False),
    ("beilstein", r"^BRN\s?\d+$", False),
    ("embedded_beilstein_ref", r"^\d{1,2}-\d{2}-\d{2}-\d{5}", False),
    ("reaxys", r"^RX\d+$", False),
    ("zinc", r"^ZINC\d+$", False),
    ("pubchem_sid", r"^(SID|SCID)\d+$", False),
    ("dtxsid", r"^DTXSID\d+$", False),
    ("schembl", r"^SCHEMBL\d+$", False),
    ("nsc", r"^NSC-?\d+$", False),
    ("akos", r"^AKOS\d+$", False),
    ("mfcd", r"^MFCD\d+$", False),
    ("einecs", r"^EINECS\s?\d+-\d+-\d+$", False),
    ("dtxcid", r"^DTXCID\d+$", False),
    ("chembl", r"^CHEMBL\d+$", False),
    ("generic_db_prefix",
     r"^(?:bmse\d{6}|orb|MSK|DAA|EIA|NS\d{7,}|A\d{4,}|BCP\d+|Tox21_\d+|BBL\d+|SB\d+|NCGC\d+|DB-\d+|[A-Z]{2,3}\d{3,})$",
     True),
    ("ec", r"^(EC\s?)?\d{3}-\d{3}-\d$", True),
    ("fema", r"^FEMA NO\. \d+$", False),
    ("beilstein_ref", r"^\d{1,2}-\d{2}-\d{2}-\d{5}$", False),
    ("wln", r"^WLN: [A-Z0-9]+$", False),
    ("generic_unii_like", r"^(?=.*\d.*\d)[A-Z0-9]{8,10}$", False),
    ("iupac_systematic",
     r"(?:\(\+/-\)|\(\+\)-|\(-\)-|\([RS]\)-|\([2S]\)-|\([2RS]\)-|rac-|racemic|DL-|\.alpha\.|\.beta\.|\.gamma\."
     r"|alpha-|beta-|gamma-)|.*[Ss]odium.*|.*[Pp]otassium.*|.*[Cc]alcium.*|.*[Aa]cid,.*|.*[Ii]um$|.*[Ii]nium$",
     True),
    ("db_prefix", r"^(RefChem:|NSC|AKOS|MFCD|ALBB|ST|BMSE|HY|AS|CCRIS|HSDB|AI3-|UE40BY1BZW)", True),
    ("generic_code_like", r"^(?=.*\d.*\d)[A-Z0-9]{6,10}$", False),
]
# Molecular-formula pattern, applied only to names without digits.
FORMULA_PATTERN = r"^[A-Z][a-z]?\d*[A-Z][a-z]?\d*.*$"
# Marker substrings (structure notations and line formulas).
MARKER_SUBSTRINGS = ["[", "InChI="]
MARKER_SUBSTRINGS_LOWER = ["mol", "smiles"]  # tested on the lower-cased name
# Numeric thresholds of the name filter.
MAX_DIGIT_RATIO = 0.4
SHORT_WITH_DIGIT_LEN = 7
MAX_NAME_LEN = 40
MAX_UPPER = 3

# Python's str.isdigit() is true for decimal digits (\p{Nd}) and for the other characters with
# a digit value (superscripts, circled digits, ...). Built from the Unicode tables by rule.
_EXTRA_DIGITS = [i for i in range(sys.maxunicode + 1) if chr(i).isdigit() and not chr(i).isdecimal()]


def _ranges(codes: list[int]) -> str:
    out, start, prev = [], None, None
    for c in codes + [None]:
        if start is None:
            start = prev = c
        elif c is not None and c == prev + 1:
            prev = c
        else:
            out.append(f"\\x{{{start:x}}}" if start == prev else f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
            start = prev = c
    return "".join(out)


DIGIT_CLASS = f"[\\p{{Nd}}{_ranges(_EXTRA_DIGITS)}]"
UPPER_CLASS = r"\p{IsUppercase}"  # Lu plus Other_Uppercase, as str.isupper()


def _alternation(patterns: list[str], case_blind: bool) -> str:
    flags = "(?iUd)" if case_blind else "(?Ud)"
    return flags + "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def identifier_regexes(patterns=None) -> tuple[str, str]:
    """Two anchored alternations (case-sensitive, case-blind) equivalent to trying every
    pattern with ``re.match``."""
    patterns = IDENTIFIER_PATTERNS if patterns is None else patterns
    cs = [p for _, p, ci in patterns if not ci]
    ci = [p for _, p, ci in patterns if ci]
    return _alternation(cs, False), _alternation(ci, True)


def identifier_reason(col, patterns=None) -> Column:
    """Why a name counts as an identifier or systematic name; NULL when it is a plain name.

    Tests run in the reference's order (cheap length/ratio tests first); the first that fires
    is the reason. ``is_identifier`` is ``reason IS NOT NULL``.
    """
    c = _c(col)
    n = F.length(c)
    digits = F.regexp_count(c, F.lit(DIGIT_CLASS))
    uppers = F.regexp_count(c, F.lit(UPPER_CLASS))
    cs_re, ci_re = identifier_regexes(patterns)
    low = F.lower(c)
    marker = reduce(lambda a, b: a | b, [c.contains(m) for m in MARKER_SUBSTRINGS]
                    + [c.contains("/") & c.contains("\\"), c.contains("@")]
                    + [low.contains(m) for m in MARKER_SUBSTRINGS_LOWER])
    formula = c.rlike(f"(?Ud)^(?:{FORMULA_PATTERN})") & (digits == 0)
    return (
        F.when(c.isNull(), F.lit("null"))
        .when((n > 0) & (digits / n > MAX_DIGIT_RATIO), F.lit("digit_ratio"))
        .when((n <= SHORT_WITH_DIGIT_LEN) & (digits > 0), F.lit("short_with_digit"))
        .when(c.rlike(cs_re) | c.rlike(ci_re) | marker | formula, F.lit("pattern"))
        .when((n > MAX_NAME_LEN) | (uppers > MAX_UPPER), F.lit("long_or_capitals"))
    )


def is_identifier(col, patterns=None) -> Column:
    """True when the name is NULL, an identifier, a notation or a systematic name."""
    return identifier_reason(col, patterns).isNotNull()


# ---------------------------------------------------------------------------------------------
# First-match classification with overriding rules.
# ---------------------------------------------------------------------------------------------
# Hazard-class rules. Tier 1 (overriding) is tried in order, the first hit wins.
CARCINOGENICITY_OVERRIDING = [
    (r"not listed by iarc", "No data"),
    (r"not directly listed by iarc", "No data"),
]
# Tier 2: the rule whose match starts earliest wins; equal starts go to the earlier rule.
CARCINOGENICITY_RULES = [
    (r"are not classifiable", "Group 3"),
    (r"is not classifiable", "Group 3"),
    (r"no indication", "Group 3"),
    (r"not listed by iarc", "Group 3"),
    (r"\bgroup\s*3\b", "Group 3"),
    (r"^3[\s,:] ", "Group 3"),
    (r"\bgroup\s*2b\b", "Group 2B"),
    (r"2b[\s,:]", "Group 2B"),
    (r"\bgroup\s*2a\b", "Group 2A"),
    (r"^2a[\s,:]", "Group 2A"),
    (r"\bgroup\s*1\b", "Group 1"),
    (r"^1[\s,:]", "Group 1"),
]
CARCINOGENICITY_DEFAULT = "No data"
CARCINOGENICITY_CLASSES = ["Group 1", "Group 2A", "Group 2B", "Group 3", "No data"]


def classify_first_match(col, overriding=None, rules=None, default: str = CARCINOGENICITY_DEFAULT) -> Column:
    """Strip + lower, then tier 1 (first overriding hit) else tier 2 (earliest match).

    Tier 2 is one expression: ``array_min`` over (match start, rule index, code) structs of
    the rules that match, so each text is scanned once per rule, with no UDF and no shuffle.
    """
    overriding = CARCINOGENICITY_OVERRIDING if overriding is None else overriding
    rules = CARCINOGENICITY_RULES if rules is None else rules
    t = F.lower(strip_ws(_c(col)))
    hits = F.array(*[
        F.struct(F.regexp_instr(t, F.lit(f"(?iUd){p}")).alias("pos"), F.lit(i).alias("idx"), F.lit(code).alias("code"))
        for i, (p, code) in enumerate(rules)
    ])
    first = F.array_min(F.filter(hits, lambda h: h["pos"] > 0))
    out = F.coalesce(first["code"], F.lit(default))
    for p, code in reversed(overriding):
        out = F.when(t.rlike(f"(?iUd){p}"), F.lit(code)).otherwise(out)
    return F.when(_c(col).isNull() | (_c(col) == ""), F.lit(default)).otherwise(out)


# ---------------------------------------------------------------------------------------------
# Exposure route.
# ---------------------------------------------------------------------------------------------
# Route normaliser word lists.
ROUTE_EMPTY_TOKENS = ["nan", "none", "null", "-", ""]
ROUTE_REJECT_PATTERN = (r"absorbed|absorption|bioavailability|metabolism|excreted|tmax|cmax|g/ml|virtually complete"
                        r"|poor absorbed|well absorbed|rapidly absorbed|first[- ]?pass|enteral|gastrointestinal")
ROUTE_REJECT_SUBSTRINGS = ["hours", "thus,", "however,", "because of", "administered"]
ROUTE_MAX_WORDS = 6
ROUTE_KEYWORDS = [  # checked in this order; the first group that hits gives the label
    ("ocular", ["eye contact", "eyes", "eye"]),
    ("injection", ["injection", "intravenous", "subcutaneous", "intravesical", "parenteral"]),
    ("radiation", ["radiation"]),
    ("oral", ["oral", "ingestion"]),
    ("inhalation", ["inhalation"]),
    ("dermal", ["dermal", "skin"]),
]
ROUTE_LABELS = ["oral", "inhalation", "dermal", "injection", "ocular", "radiation"]
NO_DATA = "No data"


def normalize_route(col) -> Column:
    """R2: one raw route text -> label or NULL.

    Intermediate texts are bound once (``_let``): inside ``transform`` Spark would otherwise
    re-evaluate the shared sub-expressions at every reference.
    """
    def with_low(t: Column, low: Column) -> Column:
        def with_stripped(stripped: Column) -> Column:
            # Cheap, exact pre-checks guard the regexes: the percent rule needs a '%', and
            # more than six words need at least 13 characters.
            n_words = F.regexp_count(stripped, F.lit(r"(?U)[\s\x{1c}-\x{1f}]+")) + 1
            reject = (
                reduce(lambda a, b: a | b, [low.contains(s) for s in ROUTE_REJECT_SUBSTRINGS])
                | (low.contains("%") & low.rlike(r"(?U)\d+%"))
                | low.rlike(f"(?U){ROUTE_REJECT_PATTERN}")
                | ((F.length(stripped) >= 2 * ROUTE_MAX_WORDS + 1) & (n_words > ROUTE_MAX_WORDS))
            )
            # One-word fallback: a label has no whitespace, so a match implies a single word.
            single = F.regexp_replace(stripped, r"^[.,;:]+|[.,;:]+$", "")
            out = F.when(reject, F.lit(None).cast("string"))
            for label, terms in ROUTE_KEYWORDS:
                out = out.when(reduce(lambda a, b: a | b, [low.contains(x) for x in terms]), F.lit(label))
            out = out.when(single.isin(*ROUTE_LABELS), single)
            return F.when(t.isNull() | F.lower(t).isin(*ROUTE_EMPTY_TOKENS), F.lit(None).cast("string")).otherwise(out)

        return _let(strip_ws(low), with_stripped)

    def with_t(t: Column) -> Column:
        # Removing '(...)' before or after lower-casing is the same (the pattern has no letters).
        low0 = F.lower(t)
        low = F.when(low0.contains("("), F.regexp_replace(low0, r"(?U)\s*\([^)]*\)", "")).otherwise(low0)
        return _let(low, lambda lw: with_low(t, lw))

    return _let(strip_ws(_c(col)), with_t)


def normalize_routes(col) -> Column:
    """Map a list with R2, drop NULLs, keep order and repeats; empty or NULL -> ['No data']."""
    arr = _c(col)
    kept = F.filter(F.transform(arr, normalize_route), lambda x: x.isNotNull())
    return F.when(arr.isNull() | (F.size(kept) == 0), F.array(F.lit(NO_DATA))).otherwise(kept)


def no_data_if_empty(col) -> Column:
    """Missing or empty list -> ['No data']."""
    c = _c(col)
    return F.when(c.isNull() | (F.size(c) == 0), F.array(F.lit(NO_DATA))).otherwise(c)
