"""Operator 1, toxicity by noisy-channel deobfuscation.

Words that hold look-alike characters (also those of another script), inner separators or repeated letters
become character lattices: each character may stand for itself, for a letter it looks like, or (separators and
repeats) for nothing. Viterbi decoding finds the path with the best sum of channel costs and log-probabilities
under a character trigram model of the words of all documents (the modified Kneser-Ney model of ``quality_ppl``,
one for all languages, lower-case). Look-alikes at a word's ends are read both as letters and as punctuation, and the
plain reading stays where it scores better. Numbers are left alone. A plain word's lattice has one path, itself, and
needs no decoding; where letters are doubled, the paths part and meet again around each pair, so a table decides it.

The restored text is scored by a logistic model over restored words, and beginnings of them, that mark toxic documents. It is fitted on at
most TRAIN_ROWS labelled rows, those with the smallest hashed ids among the rows given for training; words more
frequent in toxic documents are chosen by the likelihood-ratio statistic, at most FEATURES of them. Labels, language, source and id are no inputs
of a score.

Defined results: null or empty text has no words and gets the model's base rate; without training rows every score
is 0; repeated rows are scored alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hazardframe.llm import quality_ppl
from hazardframe.llm.common import bounded_batches, documents, spool
from hazardframe.llm.quality_ppl import V

TRAIN_ROWS = 20_000
FEATURES = 512
LEAST_G = 25.0
RIDGE = 0.002
BEAM = 48
HELD = 400_000

#: Characters and the letters they are written for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x"}
SEPARATORS = " .-_*'~,/\\"
HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))

#: Log-costs of the channel: a look-alike, a separator or a repeat (of a run of three or more; of a pair of letters) that stands
#: for nothing, a separator that parts words, any other character as itself (or one of a pair of them for nothing), and
#: a bracket without its other half.
SUBSTITUTE, SEPARATE, REPEAT, DOUBLE, PART, ODD, UNPAIRED = -0.7, -0.4, -0.3, -4.0, -5.0, -6.0, -4.0
PREFIXES = (4, 5)

_OPEN, _CLOSE = "\"'([{<«¡¿", ".,;:!?\"')]}>»*#&%$"
_LOOK = "".join(map(re.escape, LOOKS_LIKE))
_LETTER = r"[^\W\d_]"
_PAIRS = {"(": ")", "<": ">"}
_ENDS = 8  # stripped characters at a word's end that are tried as letters
_PLAIN = re.compile(rf"{_LETTER}+")
_DOUBLE = re.compile(rf"({_LETTER})\1")
_TRIPLE = re.compile(rf"({_LETTER})\1\1")
_LIKE = re.compile(rf"[{_LOOK}]")
_ASKED = re.compile(rf"[{_LOOK}{re.escape(SEPARATORS)}]|({_LETTER})\1\1")
#: Latin letters with or without a mark behind them that is no look-alike: the word is read as it stands, but for doubled letters.
_SIMPLE = re.compile("([a-zß-öø-ÿ]+)[.,;:?]?")
_SINGLES = re.compile(r"(?:(?<=\s)|^)\S(?:\s{1,2}\S){2,}(?=\s|$)")


class Decoder:
    """Restores words under a character model: (code points of the alphabet, V x V x V log-probabilities)."""

    def __init__(self, letters: np.ndarray, logs: np.ndarray):
        self.logs = logs
        self.code = {chr(p): k + 2 for k, p in enumerate(letters)}
        self.held: dict[str, tuple[str, ...]] = {}
        k = np.arange(V)  # [w, x, y]: of w x x y one x goes
        self.single = DOUBLE + logs > logs[:, k, k][:, :, None] + logs[k, k, :][None]

    def _choices(self, c: str, repeat: float | None) -> list[tuple[str, float]]:
        """What a character may stand for, and at what cost. repeat: the cost of dropping it after its like."""
        if c in SEPARATORS:
            return [("", SEPARATE), (" ", PART)]
        again = 0.0 if repeat is not None and not c.isalpha() else SUBSTITUTE  # a symbol is chosen once for a run of it
        out = [(c, 0.0 if c.isalpha() else ODD), *[(x, again) for x in LOOKS_LIKE.get(c, "")]]
        if repeat is not None:
            out.append(("", repeat))
        return out

    def decode(self, run: str) -> str:
        """Best path through the lattice of a run of characters."""
        return self.best(run)[1]

    def best(self, run: str) -> tuple[float, str]:
        """Score and text of that path."""
        beam = {(0, 0): (0.0, "")}
        for at, c in enumerate(run):
            ahead: dict = {}
            repeat = None
            if at and run[at - 1] == c:
                repeat = REPEAT if at > 1 and run[at - 2] == c or run[at + 1:at + 2] == c else DOUBLE if c.isalpha() else ODD
            choices = self._choices(c, repeat)
            for (a, b), (score, text) in beam.items():
                for x, cost in choices:
                    if not x:
                        state, now, grown = (a, b), score + cost, text
                    elif x == " ":
                        if b == 0:  # no empty words
                            continue
                        state, now, grown = (0, 0), score + cost + self.logs[a, b, 0], text + " "
                    else:
                        k = self.code.get(x, 1)
                        state, now, grown = (b, k), score + cost + self.logs[a, b, k], text + x
                    if state not in ahead or ahead[state][0] < now:
                        ahead[state] = (now, grown)
            if len(ahead) > BEAM:
                ahead = dict(sorted(ahead.items(), key=lambda s: -s[1][0])[:BEAM])
            beam = ahead or beam
        return max((score + self.logs[a, b, 0], text) for (a, b), (score, text) in beam.items())

    def plain(self, run: str) -> tuple[float, str]:
        """Score and text of a run whose letters stand for themselves and whose separators part words."""
        words = _PLAIN.findall(run)
        score = ODD * sum(not c.isalpha() and c not in SEPARATORS for c in run)
        for w in words:
            a = b = 0
            for k in [*[self.code.get(c, 1) for c in w], 0]:
                score += self.logs[a, b, k]
                a, b = b, k
        return score, " ".join(words)

    def undoubled(self, word: str) -> str:
        """The best path of a word of letters without runs of three."""
        gone = []
        for m in _DOUBLE.finditer(word):
            at = m.start()
            w, x, y = (self.code.get(c, 1) if c else 0 for c in (word[at - 1:at] if at else "", word[at], word[at + 2:at + 3]))
            if self.single[w, x, y]:
                gone.append(at)
        for at in reversed(gone):
            word = word[:at] + word[at + 1:]
        return word

    def restored(self, core: str, start: int, end: int) -> tuple[str, ...]:
        """Words of the best reading of core, whose characters before start and from end on may be punctuation."""
        head, tail = core[:start], core[end:]
        starts = [(start, sum(UNPAIRED for c in head if c in _PAIRS and _PAIRS[c] not in tail))]
        starts += [(k, sum(UNPAIRED for c in core[:k] if c in _PAIRS and _PAIRS[c] not in tail)) for k in range(max(0, start - _ENDS), start) if core[k] in LOOKS_LIKE]
        ends = [k for k in range(end, min(len(core), end + _ENDS) + 1) if k == end or core[k - 1] in LOOKS_LIKE]
        found = []
        for s, cost in starts:
            for e in ends:
                run, left = core[s:e], cost + ODD * core.count("$", e)
                if run.isalpha() and not _ASKED.search(run):
                    readings = [self.plain(run) if self.undoubled(run) == run else self.best(run)]
                else:  # the plain reading of a longer run drops what it has more, and pays for it
                    readings = [self.best(run)] + ([self.plain(run)] if s == start and e == end else [])
                found += [(score + left, order, text) for order, (score, text) in enumerate(readings)]
        return tuple(max(found)[2].split())

    def word(self, word: str) -> tuple[str, ...]:
        """Restored words of one white-space delimited word (lower-case)."""
        simple = _SIMPLE.fullmatch(word)
        if simple and not _TRIPLE.search(word):
            letters = simple[1]
            return (self.undoubled(letters) if _DOUBLE.search(letters) else letters,)
        found = self.held.get(word)
        if found is None:
            core = word.translate(HIDDEN)
            bare = core.lstrip(_OPEN)
            start = len(core) - len(bare)
            bare = bare.rstrip(_CLOSE)
            end = start + len(bare)
            if _ASKED.search(bare) or len(bare) < len(core) and _LIKE.search(core[:start] + core[end:]):
                numbers = sum(map(str.isdigit, core))
                other = len(core) - numbers
                is_number = not any(map(str.isalpha, core)) and (numbers >= other or len(core) < 3)
                found = () if is_number else self.restored(core, start, end)
            else:
                found = tuple(map(self.undoubled, _PLAIN.findall(bare)))
            if len(self.held) > HELD:
                self.held.clear()
            self.held[word] = found
        return found

    def words(self, text: str) -> set[str]:
        """All distinct words of the restored text."""
        parts = text.lower().split()
        found: set[str] = set()
        for w in set(parts):
            found.update(self.word(w))
        if list(map(len, parts)).count(1) > 2:
            found.update(self.spelled(text))
        return found

    def spelled(self, text: str) -> set[str]:
        """Words spelled out as single characters; a gap wider than the run's commonest one parts two of them."""
        found: set[str] = set()
        for run in _SINGLES.findall(text.lower()):
            gaps = list(map(len, re.findall(r"\s+", run)))
            usual = max(sorted(set(gaps)), key=gaps.count)
            for part in re.split(rf"\s{{{usual + 1},}}", run):
                found.update(self.decode(" ".join(part.split())).split())
        return found


def marks(words) -> set[str]:
    """What the classifier may see of restored words: themselves and their beginnings."""
    return {m for w in words for m in (w, *["^" + w[:k] for k in PREFIXES if len(w) >= k])}


class _Numbers(dict):
    """word of a text -> the numbers of the chosen marks that it gives."""

    def __init__(self, decoder: Decoder, chosen: dict):
        super().__init__()
        self.decoder, self.chosen = decoder, chosen

    def of(self, words) -> tuple[int, ...]:
        return tuple(self.chosen[m] for m in marks(words) if m in self.chosen)

    def __missing__(self, word):
        if len(self) > HELD:
            self.clear()
        restored, chosen = self.decoder.word(word), self.chosen
        if len(restored) == 1:
            w = restored[0]
            found = tuple(chosen[m] for m in (w, *["^" + w[:k] for k in PREFIXES if len(w) >= k]) if m in chosen)
        else:
            found = self.of(restored)
        self[word] = found
        return found

    def text(self, text: str) -> list[int]:
        parts = text.lower().split()
        found: set[int] = set()
        found.update(*filter(None, map(self.__getitem__, set(parts))))
        if list(map(len, parts)).count(1) > 2:
            found.update(self.of(self.decoder.spelled(text)))
        return sorted(found)


def character_model(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The alphabet and a dense table of trigram log-probabilities (V^3 floats, whatever the corpus)."""
    _, models = quality_ppl.train(docs.select(F.lower(F.col(f"`{text_col}`").cast("string")).alias("text")), "text", None)
    if not models or not models["*"][1]:
        return np.zeros(0, np.int64), np.full((V, V, V), -np.log(V), np.float32)
    letters, arrays = models["*"]
    return letters, quality_ppl.gram_logs(arrays, np.arange(V ** 3)).astype(np.float32).reshape(V, V, V)


_DECODERS: dict = {}


def _decoder(model) -> Decoder:
    """One decoder per worker and model, so that what it has decoded is kept between tasks."""
    if model.id not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[model.id] = Decoder(*model.value)
    return _DECODERS[model.id]


class _Shared:
    """A broadcast and a name for it."""

    def __init__(self, spark, value):
        import uuid
        self.id, self.data = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.data.value


def _word_labels(model):
    def run(batches):
        for b in batches:
            decoder, counts = _decoder(model), (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                counts[y].update(marks(decoder.words(text or "")))
            words = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in counts]], ["word", "clean", "toxic"])
    return run


def _features(model, chosen):
    """Feature numbers of each text (chosen: a broadcast of word -> number)."""
    @arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = _Numbers(_decoder(model), chosen.value)
        for texts in batches:
            yield pa.array([numbers.text(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))
    return run


def _evidence(a, b, n_a: int, n_b: int):
    """Likelihood-ratio statistic of a word found in a of n_a and in b of n_b documents."""
    def part(x):
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    n_a, n_b = F.lit(float(n_a)), F.lit(float(n_b))
    cells = part(a) + part(b) + part(n_a - a) + part(n_b - b)
    return 2 * (cells - part(a + b) - part(n_a + n_b - a - b) - part(n_a) - part(n_b) + part(n_a + n_b))


def _fit(features: list[list[int]], y: np.ndarray, n: int) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the base."""
    x = np.zeros((len(y), n + 1), np.float64)
    x[:, n] = 1
    for r, f in enumerate(features):
        x[r, f] = 1
    w = np.zeros(n + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) / len(y) + RIDGE / n * np.r_[w[:n], 0]
        h = (x.T * (p * (1 - p))) @ x / len(y) + np.diag(np.r_[np.full(n, RIDGE / n), 1e-9])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id and score of every row. labels (id, label): the rows to learn from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = _Shared(spark, character_model(docs, text_col))
    given = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    share = TRAIN_ROWS * 1.1 / max(1, given.count())  # a little more than fits, then the exact number
    picked = (given.withColumn("hash", F.xxhash64("id")).filter(F.pmod("hash", F.lit(1 << 30)) < min(1.0, share) * (1 << 30))
              .orderBy(F.pmod("hash", F.lit(1 << 30)), "id").limit(TRAIN_ROWS).drop("hash"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    train = spool(texts.join(F.broadcast(picked), "id").select("text", "y"), "toxic-train")
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return texts.select("id", F.lit(0.0).alias("score"))
    words = (train.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_word_labels(model), "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .filter(F.col("toxic") / n[1] > F.col("clean") / n[0]).withColumn("g", _evidence(F.col("toxic"), F.col("clean"), n[1], n[0])).filter(F.col("g") > LEAST_G))
    chosen = {r["word"]: k for k, r in enumerate(words.orderBy(F.desc("g"), "word").limit(FEATURES).collect())}
    features = _features(model, spark.sparkContext.broadcast(chosen))
    rows = train.select(features("text").alias("f"), "y").collect() if chosen else []
    weights = _fit([r["f"] for r in rows], np.array([r["y"] for r in rows], float), len(chosen)) if rows else np.array([np.log(n[1] / n[0])])
    table = F.array(*[F.lit(float(w)) for w in weights[:-1]]) if chosen else F.array().cast("array<double>")
    total = F.aggregate("f", F.lit(float(weights[-1])), lambda s, k: s + F.element_at(table, k + 1))
    return texts.select("id", features("text").alias("f")).select("id", (1 / (1 + F.exp(-total))).alias("score"))


def op1_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted for every row of documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = toxicity(documents(spark, sf_dir), labels.filter(~held_out)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
