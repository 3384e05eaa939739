"""Operator 6, personal data: base patterns and a character-level BiLSTM-CRF.

Base spans are the leftmost non-overlapping matches of four patterns, kept if they pass their check. The tagger
(``bilstm_crf``) adds spans that are written otherwise: numbers without a plus sign, cards with dots, addresses with blanks around the @ sign
or with "(at)" and "dot".
It is trained on the driver, in numpy, from the base spans of at most SAMPLE rows (of all rows that hold one, those with the smallest hashed
ids), from variants of these spans that the base patterns miss, and from numbers that are no personal data; at most WINDOWS windows are taken.

Texts are cut into overlapping windows of WIDTH characters every STRIDE. A span must hold a digit, an @ sign or a bracketed "at" (see ``_valid``), so
only windows that hold one are decoded; the others can't give a span. Each character takes its tag from the window in whose middle it lies
most, which reconciles the windows over the whole text; equal neighbouring tags make a span, also across windows. Added spans are trimmed, widened to whole
numbers and names, checked, and dropped where they touch a base span or go on into a longer number: base spans stay as they are.

Counts are those of the base spans. Defined results: null text is empty and has none; a corpus without any base span gets
no tagger, as nothing says what personal data look like there; repeated rows are treated alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm import bilstm_crf
from hazardframe.llm.common import bounded_batches, documents, spool

SAMPLE = 4_000
WINDOWS = 4_000
WIDTH, STRIDE = 128, 64
BATCH = 256
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NEAR = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]")
_AT, _DOT = r" {0,2}(?:@|[(\[{] ?at ?[)\]}]) {0,2}", r"(?: ?\. ?| dot | ?[(\[{] ?dot ?[)\]}] ?)"
_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")


# --- base spans ---------------------------------------------------------------------------------------------

def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Matches of [local]+@domain from left to right, each @ looked at once: a match starts where the run of local
    characters before its @ starts, or where the last match ended."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        elif start < at or end < at:
            end = max(end, start)
        at = text.find("@", max(at + 1, end))


def _passes(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in text.split("."))
    n = len(digits(text))
    return 12 <= n <= 19 and luhn(digits(text)) if kind == "card" else 9 <= n <= 15 if kind == "phone" else True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) ordered by start, then kind."""
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _TRIGGER.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _passes(kind, m.group())]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# --- windows and symbols ------------------------------------------------------------------------------------

_KNOWN = "@.-_+() %:/,;\n'\"#*$&|<>[]=!?"
SYMBOLS = len(_KNOWN) + 6
_TABLE = np.full(128, SYMBOLS - 1, np.int8)
for _k, _c in enumerate(_KNOWN):
    _TABLE[ord(_c)] = _k + 1
for _c in range(128):
    if chr(_c).isdigit():
        _TABLE[_c] = len(_KNOWN) + 1
    elif chr(_c).islower():
        _TABLE[_c] = len(_KNOWN) + 2
    elif chr(_c).isupper():
        _TABLE[_c] = len(_KNOWN) + 3


def symbols(text: str) -> np.ndarray:
    """One number per code point: digits, small and capital letters, known marks, other characters; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], len(_KNOWN) + 4).astype(np.int64)


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit, an @ sign or a bracketed "at"."""
    near = {m.start() // STRIDE for m in _NEAR.finditer(text)}
    return sorted({s for k in near for s in range((k - WIDTH // STRIDE + 1) * STRIDE, (k + 1) * STRIDE, STRIDE)})


def _window(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int64)
    a, b = max(0, start), min(len(codes), start + WIDTH)
    out[a - start:b - start] = codes[a:b]
    return out


def _valid(kind: str, text: str) -> bool:
    """What an added span must show."""
    n = len(digits(text))
    if kind == "email":
        return bool(_EMAIL.fullmatch(text))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}", text)) and all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    if kind == "card":
        return 12 <= n <= 19 and luhn(digits(text)) and len(text) <= 2 * n
    return 9 <= n <= 15 and len(text) <= 2 * n and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().\-/]*[0-9]", text)) and len(re.findall("[0-9]+", text)) > 2


def _whole(kind: str, text: str, s: int, e: int) -> tuple[int, int]:
    """The span without marks at its ends and with all of the numbers or names that it begins and ends in."""
    while s < e and not (text[s].isalnum() or kind == "phone" and text[s] in "+("):
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    if s == e:
        return s, e
    if kind == "email":
        while s and text[s - 1] in _LOCAL:
            s -= 1
        while e < len(text) and (text[e] in _LOCAL and text[e] not in "._%+"):
            e += 1
        return s, e
    while s and "0" <= text[s - 1] <= "9":
        s -= 1
    while e < len(text) and "0" <= text[e] <= "9":
        e += 1
    if kind == "phone" and text[s:e].count(")") == 1 and "(" not in text[s:e] and s and text[s - 1] == "(":
        s -= 1
    return s, e


_BEFORE, _AFTER = re.compile(r"(?:[0-9][./-]|[A-Za-z])$"), re.compile(r"[./-]?[0-9]|[A-Za-z]")


def _goes_on(text: str, s: int, e: int) -> bool:
    """Whether what stands before or behind belongs to the same number or word."""
    return bool(_BEFORE.search(text[max(0, s - 2):s]) or _AFTER.match(text[e:e + 2]))


def added_spans(text: str, base: list, starts: list[int], tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of the tagger after the windows are reconciled over the whole text."""
    if not starts:
        return []
    low, high = max(0, starts[0]), min(len(text), starts[-1] + WIDTH)
    best, centre = np.zeros(high - low, np.int8), np.full(high - low, -1)
    middle = np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1])
    for s, t in zip(starts, tags):
        a, b = max(low, s), min(high, s + WIDTH)
        better = middle[a - s:b - s] > centre[a - low:b - low]
        best[a - low:b - low][better] = t[a - s:b - s][better]
        centre[a - low:b - low] = np.maximum(centre[a - low:b - low], middle[a - s:b - s])
    edges = np.flatnonzero(np.diff(np.r_[0, best, 0]))
    taken = [(s, e) for s, e, _ in base]
    found = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if not best[a]:
            continue
        kind = KINDS[best[a] - 1]
        s, e = _whole(kind, text, low + a, low + b)
        if s < e and _valid(kind, text[s:e]) and not _goes_on(text, s, e) and not any(x < e and s < y for x, y in taken):
            found.append((s, e, kind))
            taken.append((s, e))
    return found


# --- training -----------------------------------------------------------------------------------------------

def _variants(kind: str, text: str) -> list[str]:
    """The same datum as the base patterns miss it."""
    d = digits(text)
    if kind == "email":
        name, domain = text.split("@", 1)
        return [f"{name} @ {domain}", f"{name} @{domain}", f"{name}@ {domain}", f"{name} (at) {domain}", f"{name} [at] {domain.replace('.', ' dot ')}", f"{name} (at) {domain.replace('.', ' dot ')}"]
    if kind == "ip":
        return [text.replace(".", " . "), text.replace(".", ". "), text.replace(".", " .")]
    if kind == "card":
        groups = [d[k:k + 4] for k in range(0, len(d), 4)]
        return [".".join(groups), "/".join(groups), "  ".join(groups), " / ".join(groups)]
    own = d[-10:] if len(d) >= 10 else d
    a, b, c = own[:3], own[3:6], own[6:]
    return [f"({a}) {b}-{c}", f"{a} {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"0{a} {b} {c}"]


def _decoy(rng) -> str:
    """A number that is no personal data: long numbers, order numbers, dates, times, amounts, versions."""
    def number(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    forms = (lambda: number(int(rng.integers(5, 24))), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}/{number(2)}/{number(4)}",
             lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"#{number(6)}", lambda: f"{number(3)},{number(3)}.{number(2)}",
             lambda: f"{number(1)}.{number(2)}.{number(1)}", lambda: f"{number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}", lambda: f"{number(4)} {number(2)}")
    return forms[int(rng.integers(0, len(forms)))]()


def training_windows(texts: list[str], limit: int = WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags around base spans, their variants in the same places, and numbers or nothing in others. Some
    surroundings are cut short, as texts may begin and end anywhere."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def put(text, spans, at):
        codes, tags = symbols(text), np.zeros(len(text), np.int64)
        for s, e, kind in spans:
            tags[s:e] = KINDS.index(kind) + 1
        xs.append(_window(codes, at))
        ys.append(_window(tags, at))

    def around(before, what, after, kind):
        short = rng.random()
        if short < 0.15:
            before, after = "", ""
        elif short < 0.4:
            before, after = before[len(before) - int(rng.integers(0, len(before) + 1)):], after[:int(rng.integers(0, len(after) + 1))]
        put(before + what + after, [(len(before), len(before) + len(what), kind)] if kind else [], len(before) - int(rng.integers(4, WIDTH - 24)))

    for text in texts:
        spans = base_spans(text)
        spans = [x for k, x in enumerate(spans) if not k or x[0] >= spans[k - 1][1]][:4]
        for s, e, kind in spans:
            at = max(0, s - int(rng.integers(8, WIDTH - 8)))
            near = text[at:at + 3 * WIDTH]
            put(near, base_spans(near), 0)
            before, after = text[max(0, s - WIDTH):s], text[e:e + WIDTH]
            if base_spans(before) or base_spans(after):
                before, after = before[-12:], after[:12]
            variants = _variants(kind, text[s:e])
            for k in rng.permutation(len(variants))[:3]:
                around(before, variants[k], after, kind)
            around(before, _decoy(rng), after, None)
        if not spans:
            put(text, [], int(rng.integers(0, max(1, len(text) - WIDTH))))
        if len(xs) >= limit:
            break
    return (np.array(xs), np.array(ys)) if xs else (np.zeros((0, WIDTH), np.int64),) * 2


def _windows_of(batches):
    """Of texts with a base span, the neighbourhood of the first one and a stretch of text next to it."""
    for b in batches:
        hashes, rows, plain = [], [], []
        for h, text in zip(b.column("hash").to_pylist(), b.column("text").to_pylist()):
            spans = base_spans(text) if text and _TRIGGER.search(text) else []
            if spans:
                s, e = spans[0][:2]
                hashes.append(h)
                rows.append(text[max(0, s - 2 * WIDTH):e + 2 * WIDTH])
                plain.append(text[max(0, s - 4 * WIDTH):max(0, s - 2 * WIDTH)] or text[e + 2 * WIDTH:e + 4 * WIDTH])
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(rows, pa.string()), pa.array(plain, pa.string())], ["hash", "text", "plain"])


def train(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> dict | None:
    """The tagger's weights; None if no row holds a base span. All rows are looked through; of those with a span, the ``sample`` with
    the smallest hashed ids are learnt from."""
    bound = 1 << 30
    rows = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(bound)).alias("hash"), F.col(f"`{text_col}`").cast("string").alias("text"))
    holding = spool(rows.mapInArrow(_windows_of, "hash long, text string, plain string"), "pii-windows")
    n = holding.count()
    if not n:
        return None
    some = holding.filter(F.col("hash") < min(1.0, 1.2 * sample / n) * bound)  # a little more than fits, then the exact number
    got = [(r["text"], r["plain"]) for r in some.orderBy("hash", "text").limit(sample).collect()]
    x, y = training_windows([t for pair in got for t in pair if t])
    return bilstm_crf.fit(x, y, SYMBOLS, len(KINDS) + 1, hidden=24, steps=500, batch=64)


# --- the operator -------------------------------------------------------------------------------------------

def _digest(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def _find(model):
    def run(batches):
        weights = model.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            starts = [window_starts(t) if weights else [] for t in texts]
            tags: list[np.ndarray] = []
            waiting, total = [], sum(map(len, starts))
            for t, ss in zip(texts, starts):
                codes = symbols(t) if ss else None
                for s in ss:
                    waiting.append(_window(codes, s))
                    if len(waiting) == BATCH:
                        tags.append(bilstm_crf.viterbi(weights, np.array(waiting)))
                        waiting = []
            if waiting:
                tags.append(bilstm_crf.viterbi(weights, np.array(waiting)))
            every = np.concatenate(tags) if total else np.zeros((0, WIDTH), np.int8)
            out, at = [], 0
            for t, ss in zip(texts, starts):
                base = base_spans(t)
                more = added_spans(t, base, ss, every[at:at + len(ss)])
                at += len(ss)
                kinds = [k for _, _, k in base]
                out.append((*map(kinds.count, KINDS), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(base + more)))
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, t) for c, t in zip(columns, types)]], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    spark = docs.sparkSession
    bounded_batches(spark, 256)
    model = spark.sparkContext.broadcast(train(docs, id_col, text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_find(model), f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def op6_pii_crf(spark, sf_dir):
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of documents."""
    return find_personal_data(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
