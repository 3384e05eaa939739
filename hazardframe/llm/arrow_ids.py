"""Operator 7, token ids as Arrow files of fixed-size lists.

Documents are range-partitioned by id and sorted, one shard per partition. A task encodes its documents
and streams them into ``ids-<shard>.arrow``, an Arrow IPC file whose record batches hold BATCH sequences of
LENGTH ids each (fixed-size lists) and their masks (fixed-size lists of bits, false for the padding behind
a shard's last id); documents run on from one sequence into the next. ``docs-<shard>.arrow`` holds the id,
start and length of the shard's documents. Sequence k of a shard lies in batch k // BATCH at a fixed
place, so readers that map the file reach it without a copy; ``read_sequence`` does that.

Files appear under their last name by one rename, and a repeated task writes the same bytes, so a lost
executor leaves no half file in use. Starts over the whole corpus are the shard's start (a running sum
over one row per shard) plus the start in the shard.

Defined results: null text is empty and gives the end id alone; null ids come first, ties in id go by
text; empty table: no file, empty result; other columns are ignored; texts of any length are streamed into the
file in parts.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.llm.common import bounded_batches, documents, spool
from hazardframe.llm.pretoken_ids import token_ids
from hazardframe.session import scratch_path

LENGTH = 2048
BATCH = 128
END = 2
SHARD_BYTES = 48 << 20
READ_TOKENS = 6 << 20


def _store(folder: str):
    """The file system of a folder and its path there; works for local, HDFS and object-store URIs."""
    from pyarrow import fs
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


class SequenceWriter:
    """Streams ids into an Arrow file of fixed-size lists."""

    def __init__(self, sink, dtype, length: int = LENGTH, batch: int = BATCH):
        self.dtype, self.length, self.size, self.held, self.count = np.dtype(dtype), length, length * batch, [], 0
        self.written, self.waiting = 0, 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.waiting += len(ids) // self.dtype.itemsize
        self.written += len(ids) // self.dtype.itemsize
        if self.waiting >= self.size:
            rest = np.frombuffer(b"".join(self.held), self.dtype)
            while len(rest) >= self.size:
                self._batch(rest[:self.size], self.size)
                rest = rest[self.size:]
            self.held, self.waiting = [rest.tobytes()], len(rest)

    def _batch(self, ids, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < real)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), self.dtype)
        if len(rest):
            self._batch(np.concatenate([rest, np.zeros(-len(rest) % self.length, self.dtype)]), len(rest))
        self.out.close()


def _write_shards(folder: str, vocab: str, end: int, length: int):
    def run(batches):
        shard, store, tag = TaskContext.get().partitionId(), None, uuid.uuid4().hex
        ids, starts, counts, n = [], [], [], 0
        for b in batches:
            if store is None:
                store, path = _store(folder)
                encoder = token_ids(vocab)
                last = np.array([end], encoder.dtype).tobytes()
                sink = store.open_output_stream(f"{path}/.{tag}-ids")
                writer = SequenceWriter(sink, encoder.dtype, length)
            ids.append(b.column("id"))
            for text in b.column("text").to_pylist():
                starts.append(writer.written)
                writer.add(encoder.encode(text or "") + last)
                counts.append(writer.written - starts[-1])
        if store is None:
            return
        writer.close()
        sink.close()
        table = pa.table({"id": pa.concat_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in ids]), "start": pa.array(starts, pa.int64()), "length": pa.array(counts, pa.int64())})
        with store.open_output_stream(f"{path}/.{tag}-docs") as docs_sink, pa.ipc.new_file(docs_sink, table.schema) as out:
            out.write_table(table, max_chunksize=65536)
        for kind in ("ids", "docs"):
            store.move(f"{path}/.{tag}-{kind}", f"{path}/{kind}-{shard:06d}.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([writer.written], pa.int64()), pa.array([len(starts)], pa.int64())], ["shard", "tokens", "docs"])
    return run


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json",
              end: int = END, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """Write the files; returns (and keeps beside them) one row per shard: shard, tokens, docs, start."""
    spark = docs.sparkSession
    bounded_batches(spark)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, size >> 20))
    dealt = rows.repartitionByRange(int(shards), "id").sortWithinPartitions("id", "text")
    # the rows of all shards go into one file: a file each would be one of a single row per task, with the processes that Hadoop starts for it
    made = spool(dealt.mapInArrow(_write_shards(folder, vocab, end, length), "shard int, tokens long, docs long").repartition(1), "arrow-shards")
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("start", F.coalesce(before, F.lit(0)))


def _open(store, path: str):
    from pyarrow import fs
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


def read_sequence(folder: str, shard: int, k: int):
    """Ids and mask of sequence k of a shard: views into the mapped file (an array of ids and Arrow bits)."""
    store, path = _store(folder)
    batch = _open(store, f"{path}/ids-{shard:06d}.arrow").get_batch(k // BATCH)
    return tuple(batch.column(c)[k % BATCH].values for c in ("ids", "mask"))


def _read_shards(folder: str):
    def run(batches):
        for b in batches:
            for shard, offset in zip(b.column("shard").to_pylist(), b.column("start").to_pylist()):
                store, path = _store(folder)
                index = _open(store, f"{path}/docs-{shard:06d}.arrow")
                file = _open(store, f"{path}/ids-{shard:06d}.arrow")
                at, nth, ids = 0, -1, np.empty(0, np.uint32)  # place in ids, batch, ids of that batch
                for j in range(index.num_record_batches):
                    docs = index.get_batch(j)
                    sums = []
                    for length in docs.column("length").to_pylist():
                        crc = 0
                        while length:
                            if at == len(ids):
                                nth, at = nth + 1, 0
                                ids = file.get_batch(nth).column("ids").flatten().to_numpy()
                            part = ids[at:at + length]
                            crc = zlib.crc32(part.astype("<u4"), crc)
                            at, length = at + len(part), length - len(part)
                        sums.append(crc)
                    start = pa.array(np.asarray(docs.column("start")) + offset)
                    yield pa.RecordBatch.from_arrays([docs.column("id"), start, docs.column("length"), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])
    return run


def read_documents(shards: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32. Each shard is read by one
    task, batch after batch; small shards share tasks."""
    found, tokens = shards.agg(F.count("shard"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    n = min(found, max(shards.sparkSession.sparkContext.defaultParallelism, -(-tokens // READ_TOKENS)))
    dealt = shards.select("shard", "start").repartition(max(1, n))
    return dealt.mapInArrow(_read_shards(folder), f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def op7_arrow_ids(spark, sf_dir):
    """doc_id, start, n_tokens, ids_crc32 for every row of documents, from the files."""
    docs = documents(spark, sf_dir)
    folder = scratch_path(spark, "arrow-ids")
    shards = write_ids(docs, folder)
    return read_documents(shards, folder, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("id", "doc_id")
