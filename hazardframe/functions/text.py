"""Text Column builders: whitespace handling, list text, edit-distance metrics, Jaro-Winkler.

Everything here returns a ``pyspark.sql.Column``; nothing starts a Python worker. Regexes
carry ``(?U)`` so ``\\s``/``\\d``/``\\b`` follow Unicode like Python's ``re`` on ``str``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() also counts the four information separators U+001C..U+001F,
# which Java's White_Space property leaves out.
WS_CLASS = r"[\s\x{1c}-\x{1f}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The characters of str.isspace(), built by rule (29 code points).
WS_CHARS = [chr(i) for i in range(0x110000) if chr(i).isspace()]


def strip_ws(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (SQL ``trim`` only strips spaces).

    The regex runs only when the first or last character is whitespace (a hash-set test),
    which is rare; the result is the same either way.
    """
    c = _c(col)
    ends = F.substring(c, 1, 1).isin(*WS_CHARS) | F.substring(c, -1, 1).isin(*WS_CHARS)
    return F.when(ends, F.regexp_replace(c, rf"(?U)^{WS_CLASS}+|{WS_CLASS}+$", "")).otherwise(c)


def collapse_newlines(col) -> Column:
    """Runs of CR/LF become one space (H3)."""
    return F.regexp_replace(_c(col), r"[\r\n]+", " ")


def normalize_text(col) -> Column:
    """H4: missing -> '', whitespace runs -> one space, trimmed, lower case."""
    c = F.coalesce(_c(col), F.lit(""))
    # After every whitespace run became one space, trimming spaces is the whole strip.
    return F.lower(F.trim(F.regexp_replace(c, rf"(?U){WS_CLASS}+", " ")))


def split_words(col) -> Column:
    """``str.split()`` on an already normalised text: '' gives an empty array."""
    c = _c(col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def safe_name(col) -> Column:
    """H8: space and '/' become '_'."""
    return F.translate(_c(col), " /", "__")


def truncate_text(col, n: int = 200, suffix: str = "...") -> Column:
    """H7: keep the first ``n`` characters and mark the cut."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def split_list(col, sep: str = ",") -> Column:
    """H2: split on a literal separator (not a regex), strip each item and its outer quotes.

    Empty items stay (a trailing separator gives a trailing ''), like ``str.split``.
    """
    import re

    parts = F.split(_c(col), re.escape(sep), -1)
    return F.transform(parts, lambda x: F.regexp_replace(strip_ws(x), r'^"+|"+$', ""))


# A Python list literal: single- or double-quoted items with backslash escapes.
_LIST_ITEM = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def parse_list_text(col) -> Column:
    """H6: text such as ``['oral', "d'x"]`` -> ARRAY<STRING>; NULL -> empty array."""
    items = F.regexp_extract_all(_c(col), F.lit(_LIST_ITEM), 0)

    def unquote(x: Column) -> Column:
        body = F.substring(x, F.lit(2), F.length(x) - 2)
        # Protect escaped backslashes, resolve the other escapes, then put backslashes back.
        body = F.replace(body, F.lit("\\\\"), F.lit("\u0000"))
        body = F.replace(body, F.lit("\\n"), F.lit("\n"))
        body = F.replace(body, F.lit("\\t"), F.lit("\t"))
        body = F.replace(body, F.lit("\\r"), F.lit("\r"))
        body = F.replace(body, F.lit("\\'"), F.lit("'"))
        body = F.replace(body, F.lit('\\"'), F.lit('"'))
        return F.replace(body, F.lit("\u0000"), F.lit("\\"))

    return F.when(_c(col).isNull(), F.array().cast("array<string>")).otherwise(F.transform(items, unquote))


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(v)`` (Spark has no common-subexpression
    elimination inside higher-order functions, so a reused sub-expression would be
    recomputed at every reference)."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------------------------------------
# Rounding like Python's round(x, d) on the double nearest to num/den.
# ---------------------------------------------------------------------------------------------

def round_ratio(num, den, digits: int = 4) -> Column:
    """Round the double nearest to ``num/den`` (both integer Columns, den > 0) to ``digits``
    decimals exactly as Python's ``round(num/den, digits)`` does.

    Python rounds the exact binary value of the double. Away from decimal ties integer
    arithmetic gives the same answer; at a tie x = N / (2*10^d) (N odd) the double lies above
    or below x depending on the bits of N / 5^d beyond the 53rd, which is decided below with
    modular arithmetic on 64-bit integers. ``bround`` on the double rounds the shortest
    decimal string instead and differs for e.g. 1/160.
    """
    n = _c(num).cast("long")
    m = _c(den).cast("long")
    scale = 10 ** digits
    five = 5 ** digits
    scaled = n * F.lit(scale)
    r = F.pmod(scaled, m)
    q = ((scaled - r) / m).cast("long")  # floor(10^d * n / m); exact below 2^53
    big_n = (F.lit(2) * q + 1).cast("long")  # tie point numerator (over 2*10^d)
    # x = N / 5^d / 2^(d+1); the double's significand has 53 bits: s = 52 - floor(log2(N/5^d)).
    s = (F.lit(52) - F.floor(F.log2(big_n.cast("double") / F.lit(float(five))))).cast("int")
    one = F.lit(1).cast("long")
    half_s = (s / 2).cast("int")
    pow2 = F.pmod(F.pmod(F.call_function("shiftleft", one, half_s), F.lit(five)) * F.pmod(F.call_function("shiftleft", one, s - half_s), F.lit(five)),
                  F.lit(five))  # 2^s mod 5^d without overflowing 64 bits
    rho = F.pmod(F.pmod(big_n, F.lit(five)) * pow2, F.lit(five))
    tie_up = F.when(F.pmod(big_n, F.lit(five)) == 0, F.pmod(q, F.lit(2)) == 1).otherwise(rho * 2 > five)
    up = F.when(r * 2 > m, True).when(r * 2 < m, False).otherwise(tie_up)
    return (F.when(up, q + 1).otherwise(q) / F.lit(float(scale))).cast("double")


# ---------------------------------------------------------------------------------------------
# Character and word error rate.
# ---------------------------------------------------------------------------------------------

def _word_code_string(words: Column, vocab: Column) -> Column:
    """Each word -> one code point (U+10000 + its index in ``vocab``), concatenated.

    ``levenshtein`` on these strings counts word edits. Planes 1-16 hold 1,048,576 code points
    with no surrogates, which bounds the distinct words of one pair.
    """
    return F.array_join(
        F.transform(
            words,
            lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocab, w) + 65535), 8, "0")), "UTF-32"),
        ),
        "",
    )


def _edit_counts_norm(p: Column, t: Column, unit: str) -> tuple[Column, Column]:
    if unit == "char":
        return F.levenshtein(p, t), F.length(t)
    pw, tw = split_words(p), split_words(t)
    vocab = F.array_distinct(F.concat(pw, tw))
    return F.levenshtein(_word_code_string(pw, vocab), _word_code_string(tw, vocab)), F.size(tw)


def edit_counts(pred, truth, unit: str = "char") -> tuple[Column, Column]:
    """(edit distance, reference length) of normalised texts; unit 'char' or 'word'."""
    return _edit_counts_norm(normalize_text(pred), normalize_text(truth), unit)


def error_rate(pred, truth, unit: str = "char", digits: int | None = 4) -> Column:
    """R9 (unit='char') / R10 (unit='word') with the reference's edge rules.

    raw truth missing or '' -> 1.0; normalised prediction empty -> 1.0 (0.0 if the truth is
    empty too); normalised truth empty -> 1.0; else distance / length, rounded like Python.
    The normalised texts and the (distance, length) pair are each evaluated once per row.
    """
    t_raw = _c(truth)

    def with_texts(p: Column, t: Column) -> Column:
        dist, n_ref = _edit_counts_norm(p, t, unit)

        def with_counts(dn: Column) -> Column:
            d, n = dn["d"], dn["n"]
            ratio = round_ratio(d, n, digits) if digits is not None else d / n
            return (F.when(p == "", F.when(n > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
                    .when(n == 0, F.lit(1.0)).otherwise(ratio))

        return _let(F.struct(dist.alias("d"), n_ref.alias("n")), with_counts)

    scored = _let(normalize_text(pred), lambda p: _let(normalize_text(truth), lambda t: with_texts(p, t)))
    return F.when(t_raw.isNull() | (t_raw == ""), F.lit(1.0)).otherwise(scored)


def cer(pred, truth, digits: int | None = 4) -> Column:
    return error_rate(pred, truth, "char", digits)


def wer(pred, truth, digits: int | None = 4) -> Column:
    return error_rate(pred, truth, "word", digits)


# ---------------------------------------------------------------------------------------------
# Jaro-Winkler similarity as one Column expression.
# ---------------------------------------------------------------------------------------------

# Fixed values of the similarity (must equal the reference's library for equal scores):
# common-prefix cap 4, prefix weight 0.1, prefix boost only when Jaro > 0.7.
JW_PREFIX_CAP = 4
JW_PREFIX_WEIGHT = 0.1
JW_BOOST_THRESHOLD = 0.7


def two_product(a: Column, b: Column) -> tuple[Column, Column]:
    """Dekker's error-free product: a*b = hi + lo exactly (doubles, no overflow range here)."""
    split = 134217729.0  # 2^27 + 1
    ca, cb = a * split, b * split
    ah, bh = ca - (ca - a), cb - (cb - b)
    al, bl = a - ah, b - bh
    hi = a * b
    lo = ((ah * bh - hi) + ah * bl + al * bh) + al * bl
    return hi, lo


def fma(a, b, c) -> Column:
    """a*b + c with a single rounding (emulated with an error-free product and sum; Spark SQL
    has no fused multiply-add). Used for the Winkler boost so scores equal the reference
    library's bit for bit."""
    a, b, c = _c(a) if not isinstance(a, (int, float)) else F.lit(float(a)), _c(b), _c(c)
    hi, lo = two_product(a, b)
    s = c + hi
    bb = s - c
    err = (c - (s - bb)) + (hi - bb)
    return s + (err + lo)


def jaro_winkler(a, b) -> Column:
    """Jaro-Winkler similarity of two strings; 0.0 when either is empty.

    Matching: for each position i of ``a`` (left to right) take the first unused position j of
    ``b`` with the same character inside the window ``max(floor(max(la, lb)/2) - 1, 0)``.
    Transpositions = half (integer) the number of positions where the matched characters of
    ``a`` and of ``b`` (in ``b`` order) differ.
    """
    a, b = _c(a), _c(b)
    la, lb = F.length(a), F.length(b)
    win = F.greatest(F.floor(F.greatest(la, lb) / 2) - 1, F.lit(0)).cast("int")
    init = F.struct(F.array().cast("array<int>").alias("js"), F.lit("").alias("ma"))

    def step(acc, i):
        ch = F.substring(a, i, 1)
        lo = F.greatest(F.lit(1), i - win)
        hi = F.least(lb, i + win)
        j = F.try_element_at(F.filter(
            F.sequence(lo, F.greatest(lo, hi)),
            lambda j: (j <= hi) & (F.substring(b, j, 1) == ch) & ~F.array_contains(acc["js"], j)), F.lit(1))
        return _let(j, lambda jv: F.when(jv.isNull(), acc).otherwise(
            F.struct(F.concat(acc["js"], F.array(jv)).alias("js"), F.concat(acc["ma"], ch).alias("ma"))))

    def finish(acc):
        m = F.size(acc["js"])
        mb = F.array_join(F.transform(F.array_sort(acc["js"]), lambda j: F.substring(b, j, 1)), "")
        half_t = F.floor(F.size(F.filter(
            F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
            lambda k: (k <= m) & (F.substring(acc["ma"], k, 1) != F.substring(mb, k, 1)))) / 2)
        jaro = (m / la + m / lb + (m - half_t) / m) / 3.0
        cap = F.least(F.lit(JW_PREFIX_CAP), la, lb)
        prefix = F.size(F.filter(F.sequence(F.lit(1), F.greatest(cap, F.lit(1))),
                                 lambda k: (k <= cap) & (F.substring(a, 1, k) == F.substring(b, 1, k))))
        boosted = _let(jaro, lambda jv: F.when(jv > JW_BOOST_THRESHOLD,
                                               fma(prefix * JW_PREFIX_WEIGHT, 1.0 - jv, jv)).otherwise(jv))
        return F.when(m == 0, F.lit(0.0)).otherwise(boosted)

    score = F.aggregate(F.sequence(F.lit(1), F.greatest(la, F.lit(1))), init,
                        lambda acc, i: F.when(i <= la, step(acc, i)).otherwise(acc), finish)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        (la == 0) | (lb == 0), F.lit(0.0)).otherwise(score)


def file_stem(col) -> Column:
    """H9: file name without directory and extension ('/a/b/001.jpg' -> '001')."""
    return F.regexp_extract(_c(col), r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def zero_pad(col, width: int = 3) -> Column:
    """H9: zero-padded id text ('7' -> '007'); longer ids are kept whole, never cut."""
    s = _c(col).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))
