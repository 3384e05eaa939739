"""Operator 13, Brown class-based n-grams.

Words fall into classes; a token's probability is that of its class after the class before it, times that of the word
within its class. Classes come from exchange clustering: a word moves to the class that raises the likelihood of the
class bigrams most.

1. tasks count the training words, Spark merges them: every word of the corpus with its count (words longer than
   MAX_KEY bytes stand under their digest). The LOOKUP most frequent ones, a table of bounded size, go to all tasks;
2. the WORD_UNITS most frequent words are units of their own, every other word belongs to one of FORMS units by the end of its
   form, and the end of a text is a unit. So each word, also one never seen, has a unit and, by it, a class;
3. one pass over the training texts counts bigrams of units in a dense matrix per task; Spark adds them up and gives each
   unit one row with all its neighbours (at most as many as there are units);
4. exchange: in each of ROUNDS rounds a quarter of the units may move. The class bigram matrix is added up over the units'
   rows; for each unit the change of the likelihood by every class is computed from its own row and that matrix,
   the unit itself taken out, and it goes to the best class (the smaller number on ties) if that is a gain. The assignment of
   the highest likelihood seen is kept. The end of a text stays alone in class 0;
5. P(class | class before) = (n + CLASSES * p) / (n(class before) + CLASSES) with p the add-one share of the class;
   P(word | class) = (c + 1) / (N_class + V_class + 1), where all words unseen in training are one more word of
   each class. Both sum to one;
6. texts are read once more. Tasks settle the class part of every token and the counts of words in the lookup; the other words
   of a document join the word table, whose frequent keys are settled before, so that no key is hot. As
   log P(word | class) is log(c + 1) less a term of the class, one sum of log10(c + 1) serves both scores.

Defined results: null or empty text is one token, the end; words are lower-cased in A-Z only; a null id is never held out;
repeated ids and rows are scored each by themselves; without training rows all counts are 0 and the base score is 0; an empty table gives
an empty result; very long words are counted like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import bounded_batches, documents, spool

CLASSES = 64
WORD_UNITS = 2048
FORMS = 511
ROUNDS = 12
QUARTERS = 4
LOOKUP = 1 << 17
MAX_KEY = 48
FLUSH = 400_000
HELD = 500_000
CODES_HELD = 1 << 21
ROWS_OUT = 100_000


def word_key(word: bytes) -> bytes:
    """What a word is counted under: itself, or a digest behind a space (which no word holds) if it is long."""
    return word if len(word) <= MAX_KEY else b" " + hashlib.sha256(word).digest()


def form_of(word: bytes, forms: int) -> int:
    """The form unit of a word: its last three bytes."""
    return zlib.crc32(word[-3:]) % forms


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


# --- words --------------------------------------------------------------------------------------------------

def _word_counts(batches):
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for text in b.column("text").to_pylist():
            words = tokens_of(text)
            if text and len(text) > MAX_KEY and max(map(len, words), default=0) > MAX_KEY:
                words = [word_key(w) for w in words]
            seen.update(words)
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    yield out()


@dataclass(frozen=True)
class Units:
    """The frequent words and how the others find their unit: words 0 to n - 1 of ``keys`` have ``counts``; the first
    ``own`` are units 0 to own - 1, form f is unit own + f, the end of a text the last one."""

    keys: list
    counts: np.ndarray
    own: int
    forms: int

    @property
    def size(self) -> int:
        return self.own + self.forms + 1

    @property
    def end(self) -> int:
        return self.own + self.forms

    def lookup(self) -> "Lookup":
        return Lookup(self)


class Lookup(dict):
    """word -> its number; the units of the numbers are in ``units()``. Numbers from ``known`` on are words outside
    the table, which ``others`` lists under their keys."""

    def __init__(self, table: Units):
        super().__init__(zip(table.keys, range(len(table.keys))))
        self.table, self.known, self.others = table, len(table.keys), []
        n = np.arange(self.known)
        forms = np.array([form_of(k, table.forms) for k in table.keys[table.own:]], np.int64)
        self.first = np.where(n < table.own, n, 0)
        self.first[table.own:] = table.own + forms
        self.more: list[int] = []

    def __missing__(self, word: bytes) -> int:
        key = word_key(word)
        number = self.get(key) if key is not word else None
        if number is None:
            number = self.known + len(self.others)
            self.others.append(key)
            self.more.append(self.table.own + form_of(key, self.table.forms))
        self[word] = number
        return number

    def units(self) -> np.ndarray:
        return np.concatenate([self.first, np.array(self.more, np.int64)])

    def numbers(self, text: bytes | None) -> np.ndarray:
        words = tokens_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_table(docs: DataFrame) -> DataFrame:
    """word, n over the training rows of ``docs`` (text: binary)."""
    return spool(docs.filter("training").select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "brown-words")


def _frequent(words: DataFrame, lookup: int, own: int, forms: int) -> Units:
    """At most ``lookup`` words (of at most MAX_KEY bytes): those of the highest frequency classes (eighths of powers of two) that
    fit, so that tasks send the driver these and no more."""
    ranked = words.withColumn("class", F.floor(F.log2("n") * 8))
    least, room = None, lookup
    for r in sorted(ranked.groupBy("class").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["class"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["class"]
    rows = ranked.filter(F.col("class") >= least).collect() if least is not None else []
    rows = sorted((-r["n"], bytes(r["word"])) for r in rows)
    return Units([w for _, w in rows], np.array([-n for n, _ in rows], np.int64), min(own, len(rows)), forms)


# --- classes ------------------------------------------------------------------------------------------------

def _bigrams(shared):
    def run(batches):
        table = shared.value
        look, size = table.lookup(), table.size
        dense, held, waiting = np.zeros(size * size, np.int64), [], 0

        def settle():
            for codes in held:
                found, n = np.unique(codes, return_counts=True)
                dense[found] += n
            held.clear()

        for b in batches:
            numbers = [look.numbers(t) for t in b.column("text").to_pylist()]
            units = look.units()
            for x in numbers:
                u = np.concatenate([[table.end], units[x], [table.end]])
                held.append(u[:-1] * size + u[1:])
                waiting += len(u)
            if waiting > CODES_HELD:
                held[:] = [np.concatenate(held)]
                settle()
                waiting = 0
            if len(look.others) > HELD:
                look = table.lookup()
        settle()
        found = np.flatnonzero(dense)
        for i in range(0, len(found), ROWS_OUT):
            at = found[i:i + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size), pa.array(dense[at])], ["a", "b", "n"])
    return run


def unit_rows(docs: DataFrame, table: Units) -> DataFrame:
    """Per unit: after (units that follow it, counts) and before, from the training rows."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    pairs = (docs.filter("training").select("text").mapInArrow(_bigrams(shared), "a long, b long, n long")
             .groupBy("a", "b").agg(F.sum("n").alias("n")))
    both = F.array(F.struct(F.col("a").alias("unit"), F.lit(True).alias("after"), F.col("b").alias("other"), "n"),
                   F.struct(F.col("b").alias("unit"), F.lit(False).alias("after"), F.col("a").alias("other"), "n"))
    rows = pairs.select(F.inline(both))
    lists = [F.collect_list(F.when(F.col("after") == side, F.col(c))).alias(f"{c}_{name}") for side, name in ((True, "after"), (False, "before")) for c in ("other", "n")]
    return spool(rows.groupBy("unit").agg(*lists), "brown-units")  # one row per unit, lists of at most as many as there are units


def _lists(column) -> list[np.ndarray]:
    """The lists of a column as slices of one array."""
    offsets = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), offsets[1:-1] - offsets[0])


def _records(batch):
    """unit, units after it and their counts, units before it and their counts."""
    return zip(batch.column("unit").to_pylist(), *[_lists(batch.column(c)) for c in ("other_after", "n_after", "other_before", "n_before")]) if len(batch) else ()


def class_matrix(rows: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Bigram counts of classes."""
    def run(batches):
        m = np.zeros((k, k))
        for b in batches:
            for unit, others, n, _, _ in _records(b):
                m[classes[unit]] += np.bincount(classes[others], weights=n, minlength=k)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m.ravel()[at].astype(np.int64))], ["at", "n"])

    out = np.zeros(k * k)
    for r in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most k * k
        out[r["at"]] = r["n"]
    return out.reshape(k, k)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """The part of the class bigrams' log-likelihood that depends on the classes."""
    return float(_h(matrix).sum() - _h(matrix.sum(axis=1)).sum() - _h(matrix.sum(axis=0)).sum())


def gains(matrix: np.ndarray, after: np.ndarray, before: np.ndarray, itself: float, own: int) -> np.ndarray:
    """What the likelihood gains if a unit of class ``own`` goes to each class instead (0 at ``own``)."""
    rest = matrix.copy()
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] += itself
    after, before = after.copy(), before.copy()
    after[own] -= itself
    before[own] -= itself
    k = np.arange(len(matrix))
    change = (_h(rest + after) - _h(rest)).sum(axis=1) + (_h(rest + before[:, None]) - _h(rest)).sum(axis=0)
    corner = rest[k, k]
    change += _h(corner + after + before + itself) - _h(corner + after) - _h(corner + before) + _h(corner)
    # Wherever the unit goes, its neighbours keep their tokens: only the goal's own total grows.
    for total, add in ((rest.sum(axis=1) + before, after.sum() + itself), (rest.sum(axis=0) + after, before.sum() + itself)):
        change -= _h(total + add) - _h(total)
    return change - change[own]


def exchange(rows: DataFrame, table: Units, k: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of every unit. Units start by rank in turn; the end of a text is class 0 alone."""
    classes = 1 + np.arange(table.size) % (k - 1)
    classes[table.end] = 0
    best, most = classes, -np.inf
    for step in range(rounds + 1):
        matrix = class_matrix(rows, classes, k)
        if (value := likelihood(matrix)) > most:
            best, most = classes, value
        if step == rounds:
            break

        def run(batches, classes=classes, matrix=matrix, step=step):
            for b in batches:
                units, to = [], []
                for u, following, n, preceding, m in _records(b):
                    if u == table.end or u % QUARTERS != step % QUARTERS:
                        continue
                    own = int(classes[u])
                    after = np.bincount(classes[following], weights=n, minlength=k)
                    before = np.bincount(classes[preceding], weights=m, minlength=k)
                    gain = gains(matrix, after, before, float(n[following == u].sum()), own)
                    gain[0] = -np.inf
                    goal = int(gain.argmax())
                    if gain[goal] > 1e-6:
                        units.append(u)
                        to.append(goal)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(to, pa.int64())], ["unit", "to"])

        classes = classes.copy()
        for r in rows.mapInArrow(run, "unit long, to long").collect():  # at most a quarter of the units
            classes[r["unit"]] = r["to"]
    return best


# --- the model ----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class BrownModel:
    """``transitions[a, b]`` is log10 P(b | a), ``spread[c]`` is log10(N_c + V_c + 1)."""

    table: Units
    classes: np.ndarray
    transitions: np.ndarray
    spread: np.ndarray
    tokens: int
    distinct: int
    ends: int


def _unit_sizes(words: DataFrame, table: Units) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each unit, the end of a text left out."""
    shared = words.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        look, size = shared.value.lookup(), shared.value.size
        n, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
        first = look.first
        for b in batches:
            known = [look.get(w) for w in b.column("word").to_pylist()]
            units = np.array([first[i] if i is not None else shared.value.own + form_of(w, shared.value.forms)
                              for i, w in zip(known, b.column("word").to_pylist())], np.int64)
            n += np.bincount(units, weights=b.column("n").to_numpy(), minlength=size).astype(np.int64)
            kinds += np.bincount(units, minlength=size)
        at = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(kinds[at])], ["unit", "n", "kinds"])

    n, kinds = np.zeros(table.size, np.int64), np.zeros(table.size, np.int64)
    for r in words.mapInArrow(run, "unit long, n long, kinds long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[r["unit"]], kinds[r["unit"]] = r["n"], r["kinds"]
    return n, kinds


def prepared(docs: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """id, text (binary), held_out, training."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("training", ~F.col("held_out"))


def train(rows: DataFrame, classes: int = CLASSES, own: int = WORD_UNITS, forms: int = FORMS, rounds: int = ROUNDS,
          lookup: int = LOOKUP) -> tuple[BrownModel, DataFrame]:
    """The model of the training rows (see ``prepared``), and their word table."""
    words = word_table(rows)
    table = _frequent(words, lookup, own, forms)
    neighbours = unit_rows(rows, table)
    of = exchange(neighbours, table, classes, rounds)
    matrix = class_matrix(neighbours, of, classes)
    n, kinds = _unit_sizes(words, table)
    ends = int(matrix[:, 0].sum())
    n[table.end], kinds[table.end] = ends, int(ends > 0)
    share = (matrix.sum(axis=0) + 1) / (matrix.sum() + classes)
    transitions = np.log10((matrix + classes * share) / (matrix.sum(axis=1, keepdims=True) + classes))
    per = np.bincount(of, weights=n, minlength=classes) + np.bincount(of, weights=kinds, minlength=classes) + 1
    return BrownModel(table, of, transitions, np.log10(per), int(n.sum()), int(kinds.sum()), ends), words


# --- scoring ------------------------------------------------------------------------------------------------

def _scores(shared):
    def run(batches):
        m = shared.value
        look = m.table.lookup()
        logs = np.log10(m.table.counts + 1.0)
        step = m.transitions - m.spread[None, :]
        for b in batches:
            numbers = [look.numbers(t) for t in b.column("text").to_pylist()]
            classes, known = m.classes[look.units()], look.known
            tokens, settled, own, local, words, times = [], [], [], [], [], []
            for x in numbers:
                c = np.zeros(len(x) + 2, np.int64)
                c[1:-1] = classes[x]
                inside = x[x < known]
                rare, n = np.unique(x[x >= known], return_counts=True)
                tokens.append(len(x) + 1)
                own.append(len(inside) + (m.ends > 0))
                settled.append(float(logs[inside].sum()) + np.log10(m.ends + 1.0))
                local.append(float(step[c[:-1], c[1:]].sum()))
                words.append([look.others[i - known] for i in rare])
                times.append(n.tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("held_out"), pa.array(tokens, pa.int64()), pa.array(own, pa.int64()), pa.array(settled, pa.float64()),
                 pa.array(local, pa.float64()), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["id", "held_out", "n_tokens", "known", "settled", "local", "words", "times"])
            if len(look.others) > HELD:
                look = m.table.lookup()
    return run


def score(rows: DataFrame, model: BrownModel, words: DataFrame) -> DataFrame:
    """Per row (see ``prepared``): id, held_out, n_tokens, n_known, base_score and score (log10), perplexity."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, held_out boolean, n_tokens long, known long, settled double, local double, words array<binary>, times array<long>"
    read = rows.select("id", "text", "held_out").mapInArrow(_scores(shared), schema).withColumn("row", F.monotonically_increasing_id())
    read = spool(read, "brown-read")
    rare = read.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))))
    found = rare.join(words, "word")
    sums = found.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    joined = read.drop("words", "times").join(sums, "row", "left")
    counts = F.col("settled") + F.coalesce("logs", F.lit(0.0))
    total = float(np.log10(model.tokens + model.distinct + 1))
    out = joined.select("id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                        (counts - F.col("n_tokens") * F.lit(total)).alias("base_score"), (counts + F.col("local")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op13_brown_lm(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    bounded_batches(spark)
    rows = prepared(docs, "doc_id", "text", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
    model, words = train(rows)
    return score(rows, model, words).select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                                            "base_score", "score", "perplexity")
