"""Operator 4, quality rules with an n-gram perplexity band.

Base rules count words, symbols, repeated lines and repeated 3-word windows of the whole text. The method's
own rule is a character trigram model per language over the words of all documents:

1. tasks sum (lang, word) frequencies, Spark merges them: every word of the corpus once, with its count;
2. from that table come the ALPHABET most frequent code points of each language (others share one
   symbol) and the trigram counts, word boundaries included, weighted by the words' counts. What stands behind the shared
   symbol costs its own share among the code points that do, all of them by their counts, so that in writings with
   thousands of characters random ones are dear and usual ones cheap;
3. one task per language turns its counts (at most (ALPHABET + 2)^3, whatever the corpus) into an
   interpolated modified Kneser-Ney model: sorted arrays of gram hashes (the hash numbers grams
   within the closed alphabet, so it is injective) with log-probabilities and back-off weights beside them,
   searched by bisection. A model '*' of all languages together is made likewise. Every language has a model of its
   own, however many there are: the models lie in the shared folder, and the workers are sent MODELS_HELD bytes of them at a time;
4. texts are read once more (once per such portion of models, each time those of its languages; up to that many bytes of models: once): words are scored in arrays, each distinct word once per worker and batch;
   a word's probability is OWN times that under its document's language plus the rest times that under
   '*' (so that a quotation in another language costs little, broken characters much);
   a text's log-perplexity is -sum(log p) / (characters + words);
5. per language, quartiles (of values rounded to GRAIN, so that a histogram of bounded size holds them exactly and any order of
   merging gives the same) over all documents that pass the base rules give the band
   [q1 - LOW_FENCE * w, q3 + HIGH_FENCE * w] with w the larger of q3 - q1 and LEAST_WIDTH. Documents outside are
   rejected. The upper fence is the closer one, as junk (broken words, symbols, menus) lies just above prose.

Defined results: null or empty text has no word, fails the base rules, and has no perplexity; null lang is a
language of its own; a language without passing documents rejects nothing further; repeated rows are scored
alike; empty tables give empty results; other columns are ignored by ``score`` and carried by ``good_documents``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hazardframe.llm.common import bounded_batches, documents, packed, spool

ALPHABET = 96
V = ALPHABET + 2  # symbol 0 is a word's boundary, 1 any other character
MODELS_HELD = 64 << 20  # bytes of models that the driver and the workers hold at a time, besides '*'
BANDS_SENT = 4 << 20  # bytes up to which the bands are broadcast
OWN = 0.7
LOW_FENCE = 3.0
HIGH_FENCE = 1.75
LEAST_WIDTH = 0.03
GRAIN = 4  # decimals
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent
FLUSH = 400_000
WORDS_HELD = 700_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
PARTS = "lang string, part string, kind string, data binary"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


# --- counting -----------------------------------------------------------------------------------------------

def _word_counts(batches):
    seen: defaultdict[str, Counter] = defaultdict(Counter)

    def out():
        rows = [(lang, w.decode(), n) for lang, words in seen.items() for w, n in words.items()]
        seen.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            seen[lang].update((text or "").encode().split())
        if sum(map(len, seen.values())) > FLUSH:
            yield from out()
    yield from out()


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64)


def _letter_counts(batches):
    for b in batches:
        langs = b.column("lang").dictionary_encode()
        points, lengths = _points(b.column("word").to_pylist())
        own = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
        found, where = np.unique(own << 21 | points, return_inverse=True)  # code points have 21 bits
        sums = np.bincount(where, weights=np.repeat(b.column("n").to_numpy(), lengths)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(found >> 21)), pa.array(found & ((1 << 21) - 1)), pa.array(sums)], ["lang", "letter", "n"])


def grams_of(words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram hashes of all words, boundaries included, and the number of them per word (characters + 1).
    letters: the alphabet's code points in ascending order."""
    points, lengths = _points(words)
    at = np.searchsorted(letters, points)
    known = (at < len(letters)) & (letters[np.minimum(at, len(letters) - 1)] == points) if len(letters) else np.zeros(len(points), bool)
    codes = np.zeros(len(points) + 3 * len(words), np.int64)  # each word: 0 0 w1 ... wn 0
    ends = np.cumsum(lengths + 3)
    place = np.arange(len(points)) + np.repeat(3 * np.arange(len(words)) + 2, lengths)
    codes[place] = np.where(known, at + 2, 1)
    hashes = (codes[:-2] * V + codes[1:-1]) * V + codes[2:] if len(codes) > 2 else np.zeros(0, np.int64)
    keep = np.ones(len(hashes), bool)  # windows that run on into the next word go
    for k in (1, 2):
        keep[ends[:-1] - k] = False
    return hashes[keep], lengths + 1


def _gram_counts(alphabets):
    def run(batches):
        for b in batches:
            for lang, g in b.to_pandas().groupby("lang"):
                hashes, each = grams_of(g["word"].tolist(), alphabets.value[lang])
                found, where = np.unique(hashes, return_inverse=True)
                n = np.bincount(where, weights=np.repeat(g["n"].to_numpy(float), each)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n)], ["lang", "gram", "n"])
    return run


# --- the model ----------------------------------------------------------------------------------------------

def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (index 0 unused)."""
    n = [float((counts == k).sum()) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.1), k) for k, x in enumerate(d, 1))])


def _level(keys: np.ndarray, counts: np.ndarray):
    """Discounted probabilities of sorted grams, the contexts, and the mass each context gives to back-off."""
    cut = _discounts(counts)[np.minimum(counts, 3)]
    contexts, where = np.unique(keys // V, return_inverse=True)
    total = np.bincount(where, weights=counts)
    return (counts - cut) / total[where], contexts, np.bincount(where, weights=cut) / total, where


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hash arrays of an interpolated modified Kneser-Ney trigram model (log-probabilities)."""
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    pairs, kinds = np.unique(grams % (V * V), return_counts=True)  # continuation counts
    raw = np.bincount(np.searchsorted(pairs, grams % (V * V)), weights=counts).astype(np.int64)
    kinds = np.where(pairs // V == 0, raw, kinds)  # nothing stands before a word's start: plain counts
    single = np.bincount(pairs % V, minlength=V)
    cut = _discounts(single[single > 0])[np.minimum(single, 3)]
    p1 = (single - cut) / single.sum() + cut.sum() / single.sum() / V
    p2, c2, g2, w2 = _level(pairs, kinds)
    p2 = p2 + g2[w2] * p1[pairs % V]
    p3, c3, g3, w3 = _level(grams, counts)
    p3 = p3 + g3[w3] * p2[np.searchsorted(pairs, grams % (V * V))]
    back1 = np.ones(V)
    back1[c2] = g2
    return {"k3": grams, "p3": np.log(p3), "k2": pairs, "p2": np.log(p2), "c3": c3, "b3": np.log(g3), "p1": np.log(p1), "b2": np.log(back1)}


def _find(keys: np.ndarray, wanted: np.ndarray):
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_logs(m: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Log-probability of each trigram's last symbol after its first two, with back-off."""
    at, known = _find(m["k3"], hashes)
    logs = m["p3"][at]
    rare = np.flatnonzero(~known)
    if len(rare):
        h = hashes[rare]
        at, known = _find(m["k2"], h % (V * V))
        low = np.where(known, m["p2"][at], m["b2"][h // V % V] + m["p1"][h % V])
        at, known = _find(m["c3"], h // V)
        logs[rare] = low + np.where(known, m["b3"][at], 0.0)
    return logs


def other_logs(model: dict[str, np.ndarray], letters: np.ndarray, words: list[str]) -> np.ndarray | None:
    """Per word, the log-shares of its code points outside the alphabet among all of those; None if no word has one."""
    points, lengths = _points(words)
    outside = np.flatnonzero(~np.isin(points, letters))
    if not len(outside):
        return None
    known, shares = model["o"], model["po"]
    logs = np.full(len(outside), shares[-1])
    if len(known):
        at, hit = _find(known, points[outside])
        logs[hit] = shares[at[hit]]
    return np.bincount(np.repeat(np.arange(len(words)), lengths)[outside], weights=logs, minlength=len(words))


def word_logs(model: tuple[np.ndarray, dict], words: list[str]) -> np.ndarray:
    hashes, each = grams_of(words, model[0])
    logs = np.add.reduceat(gram_logs(model[1], hashes), np.cumsum(each) - each)
    if "po" in model[1] and (more := other_logs(model[1], model[0], words)) is not None:
        logs = logs + more
    return logs


def others(points: np.ndarray, counts: np.ndarray, rest: int = 0) -> dict[str, np.ndarray]:
    """Code points outside an alphabet in ascending order, and their log-shares; the last share is that of any other one.
    ``rest``: occurrences of those that are not listed."""
    order = np.argsort(points)
    shares = np.r_[counts[order], rest + 1.0]
    return {"o": points[order], "po": np.log(shares / shares.sum())}


def _parts(lang: str, arrays: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"lang": [lang] * len(arrays), "part": list(arrays), "kind": [x.dtype.str for x in arrays.values()], "data": [x.tobytes() for x in arrays.values()]})


def _alphabet(g: pd.DataFrame) -> pd.DataFrame:
    """A language's alphabet, and the shares of all its other code points."""
    g = g.sort_values(["n", "letter"], ascending=[False, True])
    points, counts = g["letter"].to_numpy(), g["n"].to_numpy()
    more = others(points[ALPHABET:], counts[ALPHABET:]) if len(points) > ALPHABET else {}
    return _parts(g["lang"].iloc[0], {"letters": np.sort(points[:ALPHABET])} | more)


def _fit(g: pd.DataFrame) -> pd.DataFrame:
    return _parts(g["lang"].iloc[0], kneser_ney(g["gram"].to_numpy(), g["n"].to_numpy()))


def fitted(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The models of every language and of all together ('*') as a table in the shared folder, one row per array.
    Without ``lang_col`` there is '*' alone."""
    spark = docs.sparkSession
    rows = docs.select((_lang(f"`{lang_col}`") if lang_col else F.lit("*")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = rows.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = spool(counts.sortWithinPartitions("lang"), "lm-words")  # sorted: a batch has few languages
    words = words.withColumn("lang", F.explode(F.array_distinct(F.array("lang", F.lit("*")))))
    letters = words.mapInArrow(_letter_counts, "lang string, letter long, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n"))
    points = spool(letters.groupBy("lang").applyInPandas(_alphabet, PARTS), "lm-letters")  # at most all code points there are in a group
    alphabets = {r["lang"]: np.frombuffer(r["data"], r["kind"]) for r in points.filter("part = 'letters'").collect()}
    grams = words.mapInArrow(_gram_counts(spark.sparkContext.broadcast(alphabets)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return spool(points.unionByName(grams.groupBy("lang").applyInPandas(_fit, PARTS)), "lm-models")


def loaded(table: DataFrame) -> dict:
    """The models of a table of ``fitted`` by language. A model is its alphabet and its arrays."""
    models: defaultdict[str, dict] = defaultdict(dict)
    for r in table.collect():
        models[r["lang"]][r["part"]] = np.frombuffer(r["data"], r["kind"])
    return {lang: (arrays.pop("letters"), arrays) for lang, arrays in models.items()}


def train(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> tuple[list[str], dict]:
    """Keys of all languages, and all models by key ('*': all languages) at once; ``score`` loads them in portions instead."""
    models = loaded(fitted(docs, text_col, lang_col))
    return sorted(set(models) - {"*"}), models


def portions(sizes: dict[str, int], most: int) -> list[tuple[str | None, str | None]]:
    """Ranges of languages in ascending order, from the first key to before the second one (None: no bound), whose models
    have ``most`` bytes together, or one language each. Together they hold any key once, one without a model too."""
    starts, held = [], 0
    for lang, size in sorted(sizes.items()):
        if held and held + size > most:
            starts.append(lang)
            held = 0
        held += size
    return list(zip([None, *starts], [*starts, None]))


def _between(col: str, first: str | None, end: str | None):
    return (F.col(col) >= first if first is not None else F.lit(True)) & (F.col(col) < end if end is not None else F.lit(True))


def _lang(lang_col: str):
    """A language's key: 'x' and its name, '' for null."""
    return F.when(F.col(lang_col).isNull(), "").otherwise(F.concat(F.lit("x"), F.col(lang_col).cast("string")))


# --- scoring ------------------------------------------------------------------------------------------------

class _Scorer(dict):
    """bytes of a word -> its number; numbers index the words' log-probabilities."""

    def __init__(self, models, lang):
        super().__init__()
        self.models, self.lang, self.logs, self.new = models, lang, np.zeros(0), []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word.decode())
        return n

    def settle(self):
        if self.new:
            logs = word_logs(self.models["*"], self.new)
            if self.lang in self.models and self.lang != "*":
                logs = np.logaddexp(np.log(OWN) + word_logs(self.models[self.lang], self.new), np.log(1 - OWN) + logs)
            self.logs, self.new = np.concatenate([self.logs, logs]), []


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more. Numbers stay below 2^21."""
    if len(ids) < 4:
        return 0
    windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    ranked = np.sort(windows)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= hit
    return int(covered.sum())


def _measure(text: str, ids: np.ndarray, logs: np.ndarray) -> tuple:
    chars = len(text) - sum(map(text.count, SPACES))
    lines = text.split("\n")
    if len(lines) > 1:
        lines = [x for x in lines if x.strip(SPACES)]
    return (len(ids), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids),
            -float(logs[ids].sum()) / (chars + len(ids)) if len(ids) else None)


def measures(models):
    """An Arrow function of (text, language key) for the columns in SCHEMA."""
    @arrow_udf(SCHEMA)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorers: dict = {}
        for texts, langs in batches:
            if sum(len(s) + 100 for s in scorers.values()) > WORDS_HELD:  # a language takes the room of some words
                scorers = {}
            held = []
            for text, lang in zip(texts.to_pylist(), langs.to_pylist()):
                if lang not in scorers:
                    scorers[lang] = _Scorer(models.value, lang)
                words = (text or "").encode().split()
                s = scorers[lang]
                if len(s) + len(words) >= 1 << 21:
                    s = _Scorer(s.models, s.lang)  # a text with that many words has a table of its own
                held.append((text or "", s, np.fromiter(map(s.__getitem__, words), np.int64, len(words))))
            out = []
            for text, s, ids in held:
                s.settle()
                out.append(_measure(text, ids, s.logs))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _verdict(scored: DataFrame, size: int) -> DataFrame:
    """Adds base_failed and kept to rows that hold m (the measures) and key (the language). ``size``: bytes of a row per language."""
    m = F.col("m")
    scored = scored.withColumn("base_failed", (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"]))
    q = F.percentile(F.round(m["log_ppl"], GRAIN), F.array(F.lit(0.25), F.lit(0.75)))
    bands = scored.filter("not base_failed").groupBy("key").agg(q.alias("q"))
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_WIDTH))
    bands = bands.select("key", (F.col("q")[0] - LOW_FENCE * width).alias("low"), (F.col("q")[1] + HIGH_FENCE * width).alias("high"))
    inside = F.coalesce(m["log_ppl"].between(F.col("low"), F.col("high")), F.lit(True))
    return scored.join(F.broadcast(bands) if size <= BANDS_SENT else bands, "key", "left").withColumn("kept", ~F.col("base_failed") & inside)


def score(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """Every row as ``row`` (a struct of all its columns; without ``carry`` only those named in the query)
    with m, base_failed, kept, low and high."""
    spark = docs.sparkSession
    bounded_batches(spark)
    table = fitted(docs, text_col, lang_col)
    own = table.filter("lang != '*'").groupBy("lang").agg(F.sum(F.length("data") + F.lit(256)).alias("size"))
    sizes = {r["lang"]: r["size"] for r in own.collect()}  # a row per language
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if carry or c != text_col]).alias("row"),
                       F.col(f"`{text_col}`").cast("string").alias("text"), _lang(f"`{lang_col}`").alias("key"))
    scored = []
    for first, end in portions(sizes, MODELS_HELD):
        models = spark.sparkContext.broadcast(loaded(table.filter(_between("lang", first, end) | (F.col("lang") == "*"))))
        udf = measures(models)
        scored.append(spool(rows.filter(_between("key", first, end)).select("row", "key", udf("text", "key").alias("m")), "lm-scored"))
        models.destroy()  # what it was for is written
    return _verdict(reduce(DataFrame.unionByName, scored), sum(len(lang.encode()) + 64 for lang in sizes))


def good_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that pass, with all their columns."""
    return score(docs, text_col, lang_col, carry=True).filter("kept").select("row.*")


def op4_quality_ppl(spark, sf_dir):
    """doc_id, the base counts, base_failed, kept, log_ppl and the language's band for every row of documents."""
    s = score(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return s.select("row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept", "m.log_ppl", "low", "high")
