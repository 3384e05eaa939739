"""Operators 3, 7 and 10 against the libraries themselves."""

import random
import zlib

import numpy as np
import pytest

from odd import SF_SMALL, no_documents, odd_documents, stored_odd_documents  # noqa: F401
from hazardframe.llm import arrow_ids as A
from hazardframe.llm import token_counts as C
from hazardframe.llm import vector_pack as P
from hazardframe.llm.common import documents, spool
from hazardframe.llm.pretoken_ids import token_ids
from hazardframe.session import scratch_path

PARTS = ["a", "b", "the", "Idiot", "ÉTÉ", "été.", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "'s", "'", "日本", "😀", "!", "12", "\x00", "<|endoftext|>",
         "<|", "\xa0", "ing,", "é", "́", "\x1c", "ß", "ª", "İ", "-", "▁", "</s>"]


def _texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def _pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_library_s(name):
    e = token_ids(name)
    for t in _texts(5000, 1):
        assert e.encode(t) == e.whole(t), repr(t)


def test_pretoken_counts_add_up():
    model = _pieces()
    for t in _texts(5000, 2):
        assert sum(C.count_pieces(C.pretokens(t), "piece_bpe_32k.model")) + t.count("\n") == len(model.encode(t)), repr(t)


@pytest.mark.parametrize("head", [1 << 17, 40, 0])
def test_token_counts(spark, head):
    model = _pieces()
    docs = documents(spark, SF_SMALL)
    want = {r.doc_id: (len(r.text.encode()), len(model.encode(r.text))) for r in docs.collect()}
    assert {r.id: (r.n_bytes, r.n_tokens) for r in C.token_counts(docs, head=head).collect()} == want


def test_token_counts_of_odd_documents(spark, odd_documents, no_documents):
    model = _pieces()
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in odd_documents.collect()), key=repr)
    assert sorted(map(tuple, C.token_counts(odd_documents).collect()), key=repr) == want
    assert C.token_counts(no_documents).count() == 0


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_arrow_files_round_trip(spark, odd_documents, no_documents):
    whole = token_ids("byte_bpe_50k.json").library
    for docs in (documents(spark, SF_SMALL).select("doc_id", "text"), odd_documents.select("doc_id", "text")):
        folder = scratch_path(spark, "test-ids")
        shards = A.write_ids(docs, folder, shards=3)
        got = [(r.id, r.start, r.n_tokens, r.ids_crc32) for r in A.read_documents(shards, folder).orderBy("start").collect()]
        rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
        at, want, stream = 0, [], []
        for _, i, t in rows:
            ids = whole.encode(t, add_special_tokens=False).ids + [A.END]
            want.append((i, at, len(ids), _crc(ids)))
            at += len(ids)
            stream += ids
        assert got == want
        first = shards.orderBy("shard").first()
        ids, mask = A.read_sequence(folder, first["shard"], 0)
        n = min(A.LENGTH, first["tokens"])
        assert len(ids) == len(mask) == A.LENGTH and ids.to_pylist()[:n] == stream[:n] and sum(mask.to_pylist()) == n
    folder = scratch_path(spark, "test-ids")
    assert A.read_documents(A.write_ids(no_documents, folder), folder).count() == 0


def test_many_small_shards_share_files_and_tasks(spark):
    docs = spark.createDataFrame([(k, f"text {k} of many") for k in range(400)], "doc_id long, text string")
    folder = scratch_path(spark, "test-ids")
    shards = A.write_ids(docs, folder, shards=40)
    assert shards.count() > 20 and len(shards.inputFiles()) == 1
    read = A.read_documents(shards, folder)
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    whole, at = token_ids("byte_bpe_50k.json").library, 0
    for k, r in enumerate(read.orderBy("id").collect()):
        ids = whole.encode(f"text {k} of many", add_special_tokens=False).ids + [A.END]
        assert (r.id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), _crc(ids))
        at += len(ids)


def test_best_fit_keeps_every_limit():
    rnd = random.Random(3)
    lengths = [rnd.randint(1, 60) for _ in range(400)]
    for rule in ("norm", "dot"):
        place, offset = P.best_fit(lengths, tokens=64, documents=5, attention=2000 + 60 * 60, rule=rule)
        bins = {}
        for n, b, o in sorted(zip(lengths, place.tolist(), offset.tolist()), key=lambda x: (x[1], x[2])):
            bins.setdefault(b, []).append((o, n))
        for pieces in bins.values():
            assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1])
            assert sum(n for _, n in pieces) <= 64 and len(pieces) <= 5 and sum(n * n for _, n in pieces) <= 5600
    place, _ = P.best_fit(lengths, tokens=64, documents=64, attention=64 * 64)
    assert len(set(place.tolist())) <= -(-sum(lengths) // 64) * 1.02 + 1
    with pytest.raises(ValueError):
        P.best_fit([65], tokens=64)


def test_packing(spark, odd_documents, no_documents):
    whole = token_ids("word_bpe_49k.json").library
    for docs in (documents(spark, SF_SMALL), odd_documents):
        rows = P.pack(docs, group=200).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = whole.encode(r.text or "", add_special_tokens=False).ids + [P.END]
            want += [(r.doc_id, p, s, len(ids[s:s + 2048]), _crc(ids[s:s + 2048])) for p, s in enumerate(range(0, len(ids), 2048))]
        assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in bins.values():
            pieces.sort()
            assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= 2048
    assert P.pack(no_documents).count() == 0


def test_loose_sequences_of_all_groups_are_packed_again(spark):
    rnd = random.Random(5)
    schema = "row long, id long, piece int, start long, length long, ids_crc32 long"
    limits = {"tokens": 64, "documents": 64, "attention": 64 * 64}
    for lengths in ([rnd.randint(1, 60) for _ in range(3000)], [40] * 500, [rnd.choice([20, 33, 64]) for _ in range(700)], [5] * 90, []):
        pieces = spool(spark.createDataFrame([(k, k % 50, k % 3, 0, n, k) for k, n in enumerate(lengths)], schema), "pieces-test")
        rows = P.pack_pieces(pieces, limits, group=60).collect()
        once = P._pack_round(pieces, max(1, -(-len(lengths) // 60)), 0, limits, P.WEIGHTS, "norm").collect()
        assert sorted((r.ids_crc32, r.id, r.piece, r.length) for r in rows) == [(k, k % 50, k % 3, n) for k, n in enumerate(lengths)]
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in bins.values():
            held.sort()
            assert [o for o, _ in held] == list(np.cumsum([0] + [n for _, n in held])[:-1]) and sum(n for _, n in held) <= 64
        assert len(bins) <= len({r.sequence_id for r in once})
        if len(lengths) == 3000:  # 50 groups; what they leave is packed together
            least = -(-sum(lengths) // 64)
            assert 4 * (len(bins) - least) <= len({r.sequence_id for r in once}) - least
