"""Operator 3, token counts by pre-token.

The pieces of a SentencePiece BPE model never cross a space that follows another character (no
piece has its space mark but at the start), nor a line break (no piece holds one): a text's count is
the sum over its pre-tokens. So each distinct pre-token is encoded once, and documents are counted by
joining their pre-token frequencies to those counts; no id list of a document is ever made.

Plan: (1) every task sums its pre-token frequencies, Spark merges them; (2) distinct pre-tokens are
encoded in Arrow batches, the table is written down; (3) the HEAD most frequent short ones are a
broadcast of bounded size (HEAD * MAX_HEAD_KEY characters) that settles most occurrences inside the
task that reads the text; the rest join the whole table by key. As the frequent keys are settled before
the join, no key is hot in it.

Pre-token keys: without the first of the spaces before them (the model puts one in front of a text
and reads it as part of the word); a word at a line's start, without a space, has "\\n" in front.

Defined results: null text is empty: 0 bytes, 0 tokens; repeated rows and ids give one row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import bounded_batches, documents, spool

HEAD = 1 << 17
MAX_HEAD_KEY = 48
LIMIT = 4096
FLUSH = 400_000
_SPACED = re.compile(" ( *[^ ]*)")
_ODD = re.compile("  | $")


def pretokens(text: str) -> list[str]:
    """Keys of all pre-tokens of a text in order, line breaks left out."""
    if not text:
        return []
    keys = []
    for k, line in enumerate(text.replace("▁", " ").split("\n")):
        if k == 0:
            line = " " + line
        elif not line:
            continue
        if _ODD.search(line):
            start = 0 if line[0] == " " else line.find(" ")
            if start:
                keys.append("\n" + (line[:start] if start > 0 else line))
            if start >= 0:
                keys += _SPACED.findall(line, start)
        else:
            words = line.split(" ")
            if words[0]:
                words[0] = "\n" + words[0]
                keys += words
            else:
                keys += words[1:]
    return keys


_MODELS: dict = {}


def _model(name: str):
    if name not in _MODELS:
        import sentencepiece
        if name.startswith("/"):
            path = name
        else:
            import public_tokenizers
            path = public_tokenizers.path(name)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if "\n" in piece or "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} crosses pre-tokens; this model needs another split")
        _MODELS[name] = model
    return _MODELS[name]


def count_pieces(keys: list[str], name: str) -> list[int]:
    """Pieces of each key. A key of a line's start is encoded behind a line break, whose own two pieces
    (the model's space and the break) are taken off."""
    return [len(ids) - 2 * (k[0] == "\n") if k else len(ids) for k, ids in zip(keys, _model(name).encode([k or " " for k in keys], num_threads=1))] if keys else []


def _frequencies(text_col: str):
    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

        for b in batches:
            for text in b.column(text_col).to_pylist():
                seen.update(pretokens(text or ""))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()
    return run


def pretoken_table(docs: DataFrame, text_col: str, model: str) -> DataFrame:
    """Every distinct pre-token of the corpus: key, n (its occurrences), pieces."""
    found = (docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_frequencies("text"), "key string, n long")
             .groupBy("key").agg(F.sum("n").alias("n")))

    def encode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(count_pieces(b.column("key").to_pylist(), model), pa.int32())], ["key", "n", "pieces"])

    return spool(found.mapInArrow(encode, "key string, n long, pieces int"), "token-counts")


def _most_frequent(table: DataFrame, head: int) -> DataFrame:
    """At most ``head`` short keys: those of the highest frequency classes (eighths of powers of two) that fit,
    so that the driver gets them and no more."""
    short = table.filter(F.length("key") <= MAX_HEAD_KEY).withColumn("class", F.floor(F.log2("n") * 8))
    least, room = None, head
    for r in sorted(short.groupBy("class").agg(F.count(F.lit(1)).alias("keys")).collect(), key=lambda r: -r["class"]):
        room -= r["keys"]
        if room < 0:
            break
        least = r["class"]
    return short.filter(F.col("class") >= least if least is not None else F.lit(False)).select("key", "pieces")


def _document_counts(head):
    def run(batches):
        known = head.value
        for b in batches:
            keys, rows, counts = [], [], []
            base: dict[str, list] = {"row": b.column("row").to_pylist(), "bytes": [], "settled": []}
            for row, text in zip(base["row"], b.column("text").to_pylist()):
                text = text or ""
                settled = text.count("\n")
                for key, n in Counter(pretokens(text)).items():
                    pieces = known.get(key)
                    if pieces is None:
                        keys.append(key)
                        rows.append(row)
                        counts.append(n)
                    else:
                        settled += n * pieces
                base["bytes"].append(len(text.encode()))
                base["settled"].append(settled)
            n = len(base["row"])
            none = [None] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(base["row"] + rows, pa.int64()), pa.concat_arrays([b.column("id"), pa.nulls(len(keys), b.column("id").type)]), pa.array(base["bytes"] + none, pa.int64()),
                 pa.array([f"\n\n{r}" for r in base["row"]] + keys, pa.string()), pa.array([0] * n + counts, pa.int64()), pa.array(base["settled"] + [0] * len(keys), pa.int64())],
                ["row", "id", "bytes", "key", "n", "settled"])
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", head: int = HEAD) -> DataFrame:
    """id, n_bytes, n_tokens for every row. Rows travel to the join under keys that no pre-token can
    have, next to the pre-tokens that the broadcast didn't settle, so the texts are read once here."""
    spark = docs.sparkSession
    bounded_batches(spark)
    table = pretoken_table(docs, text_col, model)
    top = _most_frequent(table, head).toPandas()
    known = spark.sparkContext.broadcast(dict(zip(top["key"], top["pieces"].tolist())))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_document_counts(known), f"row long, id {id_type}, bytes long, key string, n long, settled long")
    joined = counted.join(table.select("key", "pieces"), "key", "left")
    tokens = F.sum(F.col("settled") + F.col("n") * F.coalesce(F.col("pieces"), F.lit(0)))
    return joined.groupBy("row").agg(F.max("id").alias("id"), F.max("bytes").alias("n_bytes"), tokens.alias("n_tokens")).drop("row")


def op3_token_counts(spark, sf_dir):
    """doc_id, n_bytes, n_tokens, over_limit for every row of documents."""
    return token_counts(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
