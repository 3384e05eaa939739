"""Operators 1, 4 and 6: models against their definitions and held-out texts."""

import collections
import random
import re

import numpy as np
import pytest

from odd import SF_SMALL, no_documents, odd_documents, stored_odd_documents  # noqa: F401
from hazardframe.llm import bilstm_crf as B
from hazardframe.llm import pii_crf as I
from hazardframe.llm import quality_ppl as Q
from hazardframe.llm import toxicity as T
from hazardframe.llm.common import documents


def _model(texts):
    words = collections.Counter(w for t in texts for w in t.lower().split())
    letters = collections.Counter()
    for w, n in words.items():
        for c in w:
            letters[ord(c)] += n
    alphabet = np.array(sorted(c for c, _ in letters.most_common(Q.ALPHABET)))
    hashes, each = Q.grams_of(list(words), alphabet)
    found, where = np.unique(hashes, return_inverse=True)
    return alphabet, Q.kneser_ney(found, np.bincount(where, weights=np.repeat(list(words.values()), each)).astype(np.int64))


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in documents(spark, SF_SMALL).collect()]


def test_kneser_ney_sums_to_one_in_seen_and_unseen_contexts(texts):
    alphabet, m = _model(texts)
    logs = Q.gram_logs(m, np.arange(Q.V ** 3)).reshape(Q.V, Q.V, Q.V)
    for a, b in ((0, 0), (0, 9), (5, 7), (1, 1), (Q.V - 1, 3)):
        assert np.exp(logs[a, b]).sum() == pytest.approx(1.0, abs=1e-6)
    known, odd = Q.word_logs((alphabet, m), ["the", "xqzjv"])
    assert known > odd


def test_base_counts_are_those_of_the_definition(texts):
    for t in texts[:120] + ["", " a a a a a a ", "x\nx\n\n \nx", "# * %"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        counts = collections.Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if counts[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        got = Q._measure(t, ids, np.zeros(len(number)))
        assert got[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_perplexity_band_keeps_prose_and_rejects_noise(spark):
    docs = documents(spark, SF_SMALL).select("doc_id", "text", "lang")
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("bcdfgjkpqvwxzBCDFGJKPQVWXZ0123456789#%&@") for _ in range(8)) for _ in range(90))
    noise = spark.createDataFrame([(-1, text, "en")], docs.schema)
    rows = {r["row"]["doc_id"]: r for r in Q.score(docs.unionByName(noise)).collect()}
    assert not rows[-1]["kept"] and not rows[-1]["base_failed"]
    passing = [r for i, r in rows.items() if not r["base_failed"] and i >= 0]
    assert sum(r["kept"] for r in passing) > 0.95 * len(passing)


def test_perplexity_band_rejects_symbols_and_menus(spark):
    docs = documents(spark, SF_SMALL).select("doc_id", "text", "lang")
    good = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 1").collect()}
    rnd = random.Random(6)
    words = [w for r in docs.filter("lang = 'en'").collect() if r.doc_id in good for w in r.text.split()]
    laden = " ".join(rnd.choice(words) + (rnd.choice(["###", "$$$", "%%%", "&&&"]) if k % 6 == 0 else "") for k in range(240))
    menu = " ".join(rnd.choice(words).strip(".,") + (" |" if k % 2 == 0 else "") for k in range(240))
    junk = spark.createDataFrame([(-1, laden, "en"), (-2, menu, "en")], docs.schema)
    rows = {r["row"]["doc_id"]: r for r in Q.score(docs.unionByName(junk)).collect()}
    assert all(not rows[i]["kept"] and not rows[i]["base_failed"] for i in (-1, -2))
    clean = [r for i, r in rows.items() if i in good and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) > 0.95 * len(clean)


def test_quality_of_odd_documents(spark, odd_documents, no_documents):
    rows = Q.score(odd_documents.select("doc_id", "text", "lang")).collect()
    assert len(rows) == odd_documents.count()
    assert all(r["m"]["n_words"] == 0 and r["base_failed"] and not r["kept"] and r["m"]["log_ppl"] is None for r in rows if r["row"]["doc_id"] in (4, 5, 6))
    kept = Q.good_documents(odd_documents)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 3, None}
    assert Q.score(no_documents).count() == 0 and Q.good_documents(no_documents).count() == 0


@pytest.fixture(scope="module")
def decoder(texts):
    insults = ["idiot stupid moron loser trash pathetic worthless scum clown disgusting"] * 40
    alphabet, m = _model(texts + insults)
    return T.Decoder(alphabet, Q.gram_logs(m, np.arange(Q.V ** 3)).reshape(Q.V, Q.V, Q.V))


@pytest.mark.parametrize("written,meant", [("1d10t", "idiot"), ("!d1ot", "idiot"), ("s t u p i d", "stupid"), ("s.t.u.p.i.d", "stupid"), ("stuuupid", "stupid"),
                                           ("$tup1d", "stupid"), ("tr@sh", "trash"), ("m0r0n!!", "moron"), ("l0$er", "loser"), ("path3tic", "pathetic"),
                                           ("w o r t h l e s s", "worthless"), ("sc*um", "scum"), ("(clown)", "clown"), ("the", "the"), ("été,", "été")])
def test_deobfuscation(decoder, written, meant):
    assert meant in decoder.words("of the " + written + " and")


@pytest.mark.parametrize("written,meant", [("worthle$$", "worthless"), ("worthle$$!!", "worthless"), ("(lown", "clown"), ("stuupid", "stupid"), ("id.iot", "idiot"),
                                           ("stu-pid", "stupid"), ("idi\u043et", "idiot"), ("m\u043er\u043en", "moron"), ("\u0440athetic", "pathetic")])
def test_deobfuscation_at_ends_of_pairs_and_of_other_scripts(decoder, written, meant):
    assert meant in decoder.words("of the " + written + " and")


def test_plain_readings_stay(decoder, texts):
    words = sorted({w for t in texts for w in t.lower().split() if w.isalpha() and w.isascii()})
    assert sum(decoder.word(w) == (w,) for w in words) > 0.97 * len(words)
    assert decoder.word("(the)") == decoder.word("the!") == ("the",) and decoder.word("2020") == ()
    for w in [w for w in words if T._DOUBLE.search(w) and not T._TRIPLE.search(w)][:300]:
        assert decoder.undoubled(w) == decoder.decode(w)


def test_toxicity_on_held_out_documents(spark):
    rows = [(i, ("the of and in thea " * 8 + ("1d10t m0ron" if i % 4 == 1 else "idiot moron") if i % 2 else "the of and in thea that " * 8)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    scores = {r.id: r.score for r in T.toxicity(docs, labels).collect()}
    assert all((scores[i] >= 0.5) == bool(i % 2) for i in range(300, 400)) and all(0 <= s <= 1 for s in scores.values())


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 0), (9, None)], "doc_id long, toxic int")
    got = T.toxicity(odd_documents, labels)
    assert got.count() == odd_documents.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert T.toxicity(no_documents, labels).count() == 0
    assert {r.score for r in T.toxicity(odd_documents, labels.limit(0)).collect()} == {0.0}


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    p, x, y = B.initial(5, 3, 4), rng.integers(0, 5, (3, 6)), rng.integers(0, 3, (3, 6))
    _, g = B.loss_and_gradient(p, x, y)
    for k in p:
        i = tuple(rng.integers(0, s) for s in p[k].shape)
        up, down = ({a: v.copy() for a, v in p.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert (B.loss_and_gradient(up, x, y)[0] - B.loss_and_gradient(down, x, y)[0]) / 2e-5 == pytest.approx(g[k][i], abs=1e-7)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
    return sum(sum(divmod(x, 10)) for x in doubled) % 10 == 0


def _plain_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and _luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_base_spans_are_those_of_the_patterns(texts):
    rnd = random.Random(5)
    parts = ["a", "b.", "@", "@", "c", "1", ".", "25", "300", "+", "-", " ", "(", "x@y.z", "4587121519400672", "\n", "é", "%", "_", "1.2.3.4"]
    for t in texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16))) for _ in range(8000)]:
        assert I.base_spans(t) == _plain_spans(t)


@pytest.fixture(scope="module")
def found(spark):
    import __spark_entry__ as E
    docs = documents(spark, "/root/testdata/sf0.01")
    model = I.train(docs, "doc_id", "text")
    rows = {r.doc_id: r for r in E.queries()["op6_pii_crf"](spark, SF_SMALL).collect()}
    return model, rows


def test_tagger_on_held_out_windows(found, spark):
    model, _ = found
    held = [r.text for r in documents(spark, SF_SMALL).collect() if I.base_spans(r.text)]
    x, y = I.training_windows(held, seed=3)
    tags = B.viterbi(model, x)
    assert ((tags > 0) & (tags == y)).sum() > 0.75 * max((tags > 0).sum(), (y > 0).sum())


def test_added_spans_and_base_spans(found, texts, spark):
    model, rows = found
    for r in documents(spark, SF_SMALL).collect():
        base = I._digest(I.base_spans(r.text)).split(",")
        assert set(filter(None, base)) <= set(rows[r.doc_id].spans.split(","))
    t = "the of th ndou (705) 555-7016 Atan. In 4587.1215.1940.0672 the"
    starts = I.window_starts(t)
    tags = B.viterbi(model, np.array([I._window(I.symbols(t), s) for s in starts]))
    assert {t[s:e] for s, e, _ in I.added_spans(t, [], starts, tags)} & {"(705) 555-7016", "4587.1215.1940.0672"}


def test_personal_data_of_odd_documents(spark, odd_documents, no_documents):
    rows = I.find_personal_data(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert [(r.n_email, r.n_phone) for r in rows if r.id == 9] == [(1, 1)]
    assert I.find_personal_data(no_documents).count() == 0
