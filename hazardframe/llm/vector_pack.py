"""Operator 10, vector best-fit packing.

Documents become pieces of at most ``tokens`` ids (only longer documents are cut). Pieces are dealt by hash into
groups of about GROUP pieces; each group is packed by itself, so no task sees more than that. The pieces of sequences
that a group leaves loose (below LOOSE of every limit) go into a next round, in groups of that size again, until one
group holds them all. A round ends the packing if more than half of its pieces are loose (their lengths don't fit
together any better then), and is taken back if it needs no fewer sequences than its pieces had before.

Within a group pieces go in decreasing length. A sequence has three residual capacities, as shares of
their limits: tokens, documents, and attention cost (the sum of squared lengths under a block-diagonal mask).
A piece fits where all three allow it; of those sequences the rule picks one:
  norm  least weighted norm of what is left after the piece (default),
  dot   greatest weighted dot-product of the piece's demand and what is left before it.
Ties go to the older sequence. Sequences that can't take the group's smallest piece any more are closed.

With LIMITS only the tokens can bind (2048 pieces of one id fill a sequence; squares of parts never exceed the
square of the whole), as op10's contract asks for the fewest sequences; other limits are parameters.

Defined results: null text is empty and gives the end id alone; each row is a document of its own, also with a
repeated id; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import bounded_batches, documents, spool
from hazardframe.llm.pretoken_ids import token_ids

LIMITS = {"tokens": 2048, "documents": 2048, "attention": 2048 ** 2}
WEIGHTS = (1.0, 0.05, 0.2)
GROUP = 8192
LOOSE = 0.97
END = 0
_PIECE = ["row", "id", "piece", "start", "length", "ids_crc32"]
_PLACE = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def best_fit(lengths, tokens: int = LIMITS["tokens"], documents: int = LIMITS["documents"], attention: int = LIMITS["attention"],
             weights=WEIGHTS, rule: str = "norm"):
    """Sequence number and offset of each piece. Pieces must fit an empty sequence."""
    lengths = np.asarray(lengths, dtype=np.int64)
    limits = np.array([tokens, documents, attention], dtype=np.int64)
    needs = np.stack([lengths, np.ones_like(lengths), lengths ** 2], axis=1)
    if len(lengths) and (needs.max(axis=0) > limits).any():
        raise ValueError("a piece exceeds the limits of an empty sequence")
    weights = np.asarray(weights) / limits.astype(float) ** 2
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((max(16, len(lengths)), 3), np.int64)  # what is left of the open sequences
    number = np.empty(len(left), np.int64)
    n_open = n_all = 0
    order = np.argsort(-lengths, kind="stable")
    least = np.array([lengths.min(initial=0), 1, lengths.min(initial=0) ** 2])
    for i in order:
        need = needs[i]
        k = -1
        if n_open:
            now = left[:n_open]
            fits = np.flatnonzero((now[:, 0] >= need[0]) & (now[:, 1] >= need[1]) & (now[:, 2] >= need[2]))
            if len(fits):
                rest = now[fits].astype(float)
                score = -((rest - need) ** 2 @ weights) if rule == "norm" else rest @ (weights * need)
                k = fits[score.argmax()]
        if k < 0:
            k, left[n_open], number[n_open] = n_open, limits, n_all
            n_open, n_all = n_open + 1, n_all + 1
        place[i], offset[i] = number[k], tokens - left[k, 0]
        left[k] -= need
        if (left[k] < least).any():  # closed; the last open one takes its place
            n_open -= 1
            left[k], number[k] = left[n_open], number[n_open]
    return place, offset


def _pieces(vocab: str, end: int, tokens: int):
    def run(batches):
        encoder = None
        for b in batches:
            encoder = encoder or token_ids(vocab)
            last = np.array([end], encoder.dtype).tobytes()
            rows, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                ids = np.frombuffer(encoder.encode(text or "") + last, encoder.dtype)
                for p, s in enumerate(range(0, len(ids), tokens)):
                    part = ids[s:s + tokens]
                    rows.append(r)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4")))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("id").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                             ["row", "id", "piece", "start", "length", "ids_crc32"])
    return run


def _pack_group(limits: dict, weights, rule: str):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
        place, offset = best_fit(g["length"].to_numpy(), **limits, weights=weights, rule=rule)
        return g.assign(sequence_id=g["batch"] * (1 << 32) + place, offset=offset)[["row", *_PLACE]]
    return run


def _pack_round(pieces: DataFrame, groups: int, first: int, limits: dict, weights, rule: str) -> DataFrame:
    """Pieces with sequence_id and offset; the groups are numbered from ``first`` on."""
    dealt = pieces.withColumn("batch", F.lit(first) + F.pmod(F.xxhash64("row", "piece", F.lit(first)), F.lit(groups)).cast("long"))
    id_type = pieces.schema["id"].dataType.simpleString()
    return dealt.groupBy("batch").applyInPandas(_pack_group(limits, weights, rule),
                                                f"row long, id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_pieces(pieces: DataFrame, limits: dict, weights=WEIGHTS, rule: str = "norm", group: int = GROUP, loose: float = LOOSE) -> DataFrame:
    """Rounds of groups over a stored table of pieces (row, id, piece, start, length, ids_crc32)."""
    rest, n, first = pieces, pieces.count(), 0
    done, earlier, had = [], None, None  # sequences that stay; how the rest lay before this round, in how many sequences
    while True:
        groups = max(1, -(-n // group))
        now = _pack_round(rest, groups, first, limits, weights, rule)
        if groups == 1 and earlier is None:
            return now.select(_PLACE)
        now = spool(now, "packed")
        share = F.greatest(F.sum("length") / limits["tokens"], F.count("length") / limits["documents"], F.sum(F.col("length") ** 2) / limits["attention"])
        fill = now.groupBy("sequence_id").agg(share.alias("used"))
        if earlier is not None and fill.count() >= had:
            done.append(earlier)
            break
        part = spool(fill.filter(F.col("used") < loose).select("sequence_id"), "loose")
        had = part.count()
        left = spool(now.join(part, "sequence_id", "left_semi"), "left")
        m = left.count()
        if groups == 1 or m == 0 or 2 * m > n:
            done.append(now)
            break
        done.append(now.join(part, "sequence_id", "left_anti"))
        rest, n, first, earlier = left.select(_PIECE), m, first + groups, left
    return reduce(DataFrame.unionByName, [d.select(_PLACE) for d in done])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "word_bpe_49k.json", end: int = END,
         limits: dict | None = None, weights=WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    limits = LIMITS | (limits or {})
    longest = min(limits["tokens"], int(limits["attention"] ** 0.5))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    id_type = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(_pieces(vocab, end, longest), f"row long, id {id_type}, piece int, start long, length long, ids_crc32 long")
    pieces = spool(cut, "pieces")
    return pack_pieces(pieces, limits, weights, rule, group)


def op10_vector_pack(spark, sf_dir):
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of documents."""
    return pack(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
