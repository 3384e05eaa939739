"""Operators 2 and 8 against brute force."""

import hashlib
import random
from math import comb

import numpy as np
import pytest

from odd import SF_SMALL, no_documents, odd_documents, stored_odd_documents  # noqa: F401
from hazardframe.llm import jaccard_join as J
from hazardframe.llm import suffix_dedup as S
from hazardframe.llm.common import documents, spool


def _brute_repeats(rows, length=100):
    seen, out = set(), []
    for _, _, doc_id, text in sorted((i is not None, i or 0, i, t or "") for i, t in rows):
        d = text.encode()
        covered = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if d[s:s + length] in seen:
                covered[s:s + length] = True
            seen.add(d[s:s + length])
        edges = np.diff(np.r_[0, covered.view(np.int8), 0])
        out.append((doc_id, len(d), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~covered].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_refinement_finds_every_repeat():
    rnd = random.Random(3)
    for trial in range(150):
        n, length = rnd.randint(0, 300), rnd.choice([8, 9, 12, 16, 20, 30])
        data = np.array([rnd.choice(b"ab") for _ in range(n)], np.uint8)
        if trial % 3 == 0 and n:
            data = np.tile(data[:rnd.randint(1, 30)], 20)[:n]
        starts = np.array([s for s in range(max(0, len(data) - length + 1)) if rnd.random() < 0.8], np.int64)
        seen, want = set(), []
        for s in starts:
            key = data[s:s + length].tobytes()
            want.append(key in seen)
            seen.add(key)
        assert S.refine(data, starts, length).tolist() == want


def test_refinement_ranks_only_what_a_start_points_to(monkeypatch):
    """Rows of 112 bytes with 13 windows each: deep buckets are needed near the windows only, and lone ones lead nowhere."""
    rnd = random.Random(8)
    rows = [bytes(rnd.choice(b"abcdefgh ") for _ in range(112)) for _ in range(300)]
    rows += rows[:150] + [r[:111] + b"!" for r in rows[:100]]
    data = np.frombuffer(b"".join(rows), np.uint8)
    starts = np.concatenate([np.arange(112 * k, 112 * k + 13) for k in range(len(rows))])
    ranked, rank = [], S._rank
    monkeypatch.setattr(S, "_rank", lambda keys, bits: ranked.append(len(keys)) or rank(keys, bits))
    again = S.refine(data, starts).reshape(-1, 13)
    assert not again[:300].any() and again[300:450].all() and again[450:, :12].all() and not again[450:, 12].any()
    assert sum(ranked) < 4 * len(data)


def test_ranks_beyond_one_number():
    rnd = random.Random(9)
    for bits in (8, 64):  # with the place in one 64-bit number, and without
        keys = np.array([rnd.choice([3, 7, 7 << (bits - 4), (1 << bits) - 1, rnd.getrandbits(bits)]) for _ in range(500)], np.uint64)
        places, new = S._rank(keys, bits)
        groups = {}
        for k, key in enumerate(keys.tolist()):
            groups.setdefault(key, []).append(k)
        want = [g for _, g in sorted(groups.items()) if len(g) > 1]
        assert places.tolist() == [k for g in want for k in g]
        assert new.tolist() == [k == 0 for g in want for k in range(len(g))]


def test_every_window_has_one_anchor_and_equal_windows_share_it():
    rnd = random.Random(5)
    passage = bytes(rnd.choice(b"abcd ") for _ in range(260))
    data = np.frombuffer(bytes(rnd.choice(b"abcd ") for _ in range(300)) + passage + b"xyz" + passage + b"aaaa" * 60, np.uint8)
    first, count, hashes = S.anchor_runs(data)
    assert count.sum() == len(data) - 99 and first[0] == 0
    owner = {}
    for f, n, h in zip(first.tolist(), count.tolist(), hashes.tolist()):
        for s in range(f, f + n):
            assert owner.setdefault(data[s:s + 100].tobytes(), h) == h


def test_halves_hold_their_keys_in_every_window():
    """Equal windows have equal keys, the halves make up all windows, and unequal surroundings of one anchor tell windows apart."""
    rnd = random.Random(6)
    passage = bytes(rnd.choice(b"abcd ") for _ in range(260))
    data = np.frombuffer(bytes(rnd.choice(b"abcd ") for _ in range(300)) + passage + b"xyz" + passage + b"aaaa" * 60 + b"q" * 150, np.uint8)
    first, count, hashes, start, n, keys, run = S.anchor_halves(data)
    assert [x.tolist() for x in (first, count, hashes)] == [x.tolist() for x in S.anchor_runs(data)]
    assert n.min() > 0 and np.array_equal(S._expand(start, n), np.arange(len(data) - 99))
    owner = {}
    for f, c, k in zip(start.tolist(), n.tolist(), keys.tolist()):
        for s in range(f, f + c):
            assert owner.setdefault(data[s:s + 100].tobytes(), k) == k
    assert len(set(keys.tolist())) > len(set(hashes.tolist()))


def test_copies_alone_send_nothing_on():
    """A key in two blocks goes on only if two different stretches hold it."""
    import pyarrow as pa
    keys = [np.array([1, 2, 3, 3], np.uint64), np.array([1, 2, 3], np.uint64), np.array([4], np.uint64)]
    tags = [np.array([7, 7, 7, 8], np.uint64), np.array([7, 9, 7], np.uint64), np.array([7], np.uint64)]
    table = pa.table({"block": [0, 1, 2], "keys": [k.tobytes() for k in keys], "tags": [t.tobytes() for t in tags]})
    out = S._met(1)(table)
    assert [np.frombuffer(x.as_py(), np.uint64).tolist() for x in out.column("met")] == [[2, 3], [2, 3], []]
    assert [np.frombuffer(x.as_py(), np.uint64).tolist() for x in out.column("hot")] == [[2, 3], [2, 3], []]
    assert [len(x.as_py()) for x in S._met(2)(table).column("hot")] == [0, 0, 0]


def _planted(spark):
    rnd = random.Random(9)
    def prose(n):
        return "".join(rnd.choice("abcdefgh  é") for _ in range(n))
    passages = [prose(160) for _ in range(3)]
    rows = []
    for i in range(90):
        t = prose(rnd.randint(0, 500))
        if i % 3 == 0:
            t += passages[i % 2] + prose(rnd.randint(0, 60))
        if i % 10 == 4:
            t = passages[2] + passages[2] + t[:200]
        if i % 9 == 8:
            t = rows[rnd.randrange(len(rows))][1]
        rows.append((i, t))
    return rows, spool(spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id"), "planted")


@pytest.mark.parametrize("hot_blocks", [64, 0])
def test_planted_passages_go(spark, hot_blocks):
    rows, docs = _planted(spark)
    got = sorted(map(tuple, S.remove_repeats(docs, hot_blocks=hot_blocks).collect()), key=repr)
    want = _brute_repeats(rows)
    assert got == want and sum(r[2] for r in want) > 3000


def test_repeats_in_real_and_odd_documents(spark, stored_odd_documents, no_documents):
    for docs in (documents(spark, SF_SMALL), stored_odd_documents.filter("doc_id is null or doc_id not in (7, 8)")):
        docs = spool(docs.select("doc_id", "text"), "repeat-test")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, S.remove_repeats(docs).collect()), key=repr) == _brute_repeats(rows)
    long = S.remove_repeats(stored_odd_documents.filter("doc_id in (7, 8)")).collect()
    assert {r.id: (r.n_bytes, r.n_removed) for r in long} == {7: (150_000, 149_995), 8: (60_000, 59_999)}
    assert S.remove_repeats(no_documents).count() == 0


def _sets(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def _brute_components(rows):
    sets = _sets(rows)
    parent = list(range(len(sets)))
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            common = len(x & y)
            if common and 100 * common >= 80 * (len(x) + len(y) - common):
                parent[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted(((doc_id, len(s), least.get(find(k))) for k, (doc_id, s) in enumerate(sets)), key=repr)


def _near_copies(seed, n, words):
    """Groups of edited copies: few and many words, chains of edits, one text shared by many."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, base = [], [[rnd.choice(vocabulary) for _ in range(words)] for _ in range(6)]
    for i in range(n):
        t = list(base[rnd.randrange(len(base))])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4])):
            k = rnd.randrange(len(t))
            t[k:k + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [t[k], rnd.choice(vocabulary)]])
        rows.append((i * 3 % 101 + 1000 * (i // 101), " ".join(t)))
    return rows


@pytest.mark.parametrize("words,n", [(9, 120), (14, 120), (25, 120), (90, 160)])
def test_components_of_near_copies(spark, words, n):
    rows = _near_copies(words, n, words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, J.jaccard_components(docs).collect()), key=repr) == _brute_components(rows)


def test_components_of_real_and_odd_documents(spark, odd_documents, no_documents):
    for docs in (documents(spark, SF_SMALL), odd_documents):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, J.jaccard_components(docs).collect()), key=repr) == _brute_components(rows)
    kept = J.drop_near_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert J.jaccard_components(no_documents).count() == 0 and J.drop_near_copies(no_documents).count() == 0


def test_light_pairs_near_the_boundary_link(spark, monkeypatch):
    """b links with a alone: the first list both hold is one of a shingle, where light pairs aren't taken up."""
    monkeypatch.setattr(J, "choose_boundary", lambda *args, **options: 14)
    s = " ".join(f"s{k}" for k in range(16))
    rows = [(3, s + " y1 y2"), (1, s), (2, s + " x1 x2"), (4, "s12 s13 s14 s15 y1 y2")]  # c, a, b, and what c shares with another
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, J.jaccard_components(docs).collect())) == _brute_components(rows) == [(1, 12, 1), (2, 14, 1), (3, 14, 1), (4, 2, 4)]


def test_boundary_follows_cost():
    assert J.subset_sizes(10) == [8, 9, 10] and J.subset_sizes(10, boundary=10) == [8, 9]
    cheap = J.choose_boundary({k: 10 for k in range(1, 40)}, list_length=1.0)
    dear = J.choose_boundary({k: 10 for k in range(1, 40)}, list_length=1000.0)
    assert 0 <= cheap < dear <= J.MAX_BOUNDARY and comb(dear, J.needed(dear)) > 1


def test_a_line_in_every_document_gives_a_range_one_entry_per_block(spark):
    rnd = random.Random(12)
    line = " ".join(f"licence{k}" for k in range(30))
    rows = [(i, line + " " + " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.choice([0, 3, 6, 40])))) for i in range(120)] + [(200, None), (201, ""), (202, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shipped = docs.selectExpr("doc_id AS id", "text").mapInArrow(J._ship(4, 5), "range long, block long, postings binary, ids array<long>")
    sent = [np.frombuffer(r.postings, np.uint64) >> np.uint64(16) for r in shipped.collect() if r.range >= 0]
    assert all(len(np.unique(a)) == len(a) for a in sent)
    got = sorted(((r.id, r.n, r.component) for r in J.jaccard_components(docs).collect()), key=repr)
    assert got == _brute_components(rows)
