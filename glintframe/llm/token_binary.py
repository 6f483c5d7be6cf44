"""Token ids as compressed binary with a shared dictionary.

Texts become token ids under the byte-level vocabulary, ids little-endian 16-bit integers (32-bit if the vocabulary
needs them). A zstandard dictionary is trained on the serialized arrays of all documents: each task trains on its
own arrays, and the dictionaries are trained on in turn, FAN_IN at a time, until one is left. Every document is
compressed by itself with it, so that one short document is read without its neighbours. A shard is the run of
documents that one task writes; the index gives each document's shard, offset and length there, the dictionary's
hash, the number of ids and their width.

``tokenize`` gives the serialized ids, to be written once; ``train_dictionary`` and ``encode`` read them. Result of
``encode``: doc_id, shard, offset, length, n_tokens, id_bytes, dict_hash, payload. ``write_shards`` writes the
payloads in order of offset in files with small row groups and pages, the index and the dictionary;
``read_documents`` reads chosen documents by their index rows, and only the row groups and pages that hold them.

Null text: null payload, length 0 and n_tokens 0; empty text: the compressed form of no ids. Whole texts are
encoded, however long, also long runs of blanks. Null ids stay, ties and repeated rows have payloads and index rows
of their own, other columns are ignored whatever their names. An empty table gives an empty result. The dictionary
changes only the size: decoding is exact for any. It depends on how the table is cut into tasks, not on the order
in which they run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.llm.common import named, slices, staged, tidy
from glintframe.llm.secret_scan import VOCABULARY, encoding

DICT_BYTES = 64 << 10
#: Bytes of serialized arrays that one dictionary of a task is trained on.
TRAIN_BYTES = 32 << 20
#: Dictionaries that are trained on together, as pieces of so many bytes.
FAN_IN = 64
PIECE_BYTES = 1 << 10
LEVEL = 3
SLICE_BYTES = 4 << 20
#: Bytes of a row group and of a page of the shards' files.
GROUP_BYTES, PAGE_BYTES = 1 << 20, 64 << 10
#: Runs of white space from this length on are encoded apart: the split pattern would overflow its stack.
LONG_BLANKS = 4096
_WHITE = r"\t-\r \x85\xa0  -     　"


def encode_text(enc: tiktoken.Encoding, text: str, long_blanks: int = LONG_BLANKS) -> list[int]:
    """Ids of a text: those of enc.encode_ordinary, which fails on very long runs of white space.

    The split pattern takes a run of white space but for its last character as one piece, or all of it at the end.
    """
    if len(text) < long_blanks:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for m in re.finditer(f"[{_WHITE}]{{{long_blanks},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._core_bpe.encode_single_piece(text[m.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def id_width(vocabulary: str) -> int:
    return 2 if encoding(vocabulary).max_token_value < 1 << 16 else 4


def serialize(ids: list[int], width: int) -> bytes:
    return np.array(ids, f"<u{width}").tobytes()


def _train(samples: list[bytes], dict_bytes: int) -> bytes:
    """A dictionary of these; empty if there is too little to train on."""
    try:
        return zstandard.train_dictionary(dict_bytes, samples, k=200, d=8, f=18, accel=5, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, dict_bytes: int = DICT_BYTES, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, part, trained): a row for each document, ids null for a null text, and rows with a
    part, the task's number, and a dictionary trained on its documents. No shuffle."""
    width = id_width(vocabulary)
    source = docs.select(named(doc_id).alias("doc_id"), named(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, column = encoding(vocabulary), TaskContext.get().partitionId(), None
        held: list[bytes] = []
        size = 0

        def rows(ids: pa.Array, tokens: list[int | None], packed: list[bytes | None], trained: list[bytes | None], parts: list[int | None]) -> pa.RecordBatch:
            columns = [ids, pa.array(tokens, pa.int32()), pa.array(packed, pa.binary()), pa.array(parts, pa.int32()), pa.array(trained, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "part", "trained"])

        for batch in batches:
            column = batch.column(0).type
            for b in slices(batch, "_text", SLICE_BYTES):
                lists = [None if t is None else encode_text(enc, t) for t in b.column(1).to_pylist()]
                packed = [None if i is None else serialize(i, width) for i in lists]
                none = [None] * len(lists)
                yield rows(b.column(0), [len(i or ()) for i in lists], packed, none, none)
                held += [p for p in packed if p]
                size += sum(len(p or ()) for p in packed)
                if size >= train_bytes:
                    yield rows(pa.nulls(1, column), [None], [None], [_train(held, dict_bytes)], [part])
                    held, size = [], 0
        if held:
            yield rows(pa.nulls(1, column), [None], [None], [_train(held, dict_bytes)], [part])

    return source.mapInArrow(tidy(work), f"doc_id {kind}, n_tokens int, ids binary, part int, trained binary")


def train_dictionary(tokens: DataFrame, dict_bytes: int = DICT_BYTES, fan_in: int = FAN_IN) -> bytes:
    """The dictionary of all documents of a written table of ``tokenize``; empty, which means none, if there is too
    little to train on. Only the last one is brought to the driver."""

    def join(table: pa.Table) -> pa.Table:
        dicts = sorted(table["trained"].to_pylist())
        pieces = [d[a : a + PIECE_BYTES] for d in dicts for a in range(0, len(d), PIECE_BYTES)]
        best = dicts[0] if len(dicts) == 1 else _train(pieces, dict_bytes) or max(dicts, key=len)
        return pa.table({"part": pa.array([table["part"][0].as_py() // fan_in], pa.int32()), "trained": pa.array([best], pa.binary())})

    level = tokens.where("part is not null and octet_length(trained) > 0").select("part", "trained")
    top = level.agg(F.max("part")).first()[0]
    while top is not None:
        level = staged(level.groupBy(F.floor(F.col("part") / fan_in)).applyInArrow(join, "part int, trained binary"))
        if top < fan_in:
            return bytes(level.first()["trained"])
        top //= fan_in
    return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _dict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def encode(tokens: DataFrame, dictionary: bytes, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each document of a written table of ``tokenize``, see above; no shuffle."""
    shared = tokens.sparkSession.sparkContext.broadcast(dictionary)
    name, width = dictionary_hash(dictionary), id_width(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(shared.value))
        shard, at = TaskContext.get().partitionId(), 0
        for b in batches:
            payload = [None if i is None else pack.compress(i) for i in b.column(2).to_pylist()]
            length = np.array([len(p or b"") for p in payload], np.int64)
            end = at + np.cumsum(length)
            n = len(payload)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(np.full(n, shard, np.int32)), pa.array(end - length), pa.array(length.astype(np.int32)), b.column(1),
                    pa.array(np.full(n, width, np.int8)), pa.array([name] * n, pa.string()), pa.array(payload, pa.binary()),
                ],
                ["doc_id", "shard", "offset", "length", "n_tokens", "id_bytes", "dict_hash", "payload"],
            )
            at = int(end[-1]) if n else at

    kind = tokens.schema["doc_id"].dataType.simpleString()
    source = tokens.where("part is null").select("doc_id", "n_tokens", "ids")
    return source.mapInArrow(tidy(work), f"doc_id {kind}, shard int, offset bigint, length int, n_tokens int, id_bytes tinyint, dict_hash string, payload binary")


def decode_ids(payload: bytes, dictionary: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dict(dictionary)).decompress(payload), f"<u{width}")


def decode(encoded: DataFrame, dictionary: bytes, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows of ``encode``. Fails with ValueError on rows of another dictionary."""
    shared, name = encoded.sparkSession.sparkContext.broadcast(dictionary), dictionary_hash(dictionary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unpack = encoding(vocabulary), zstandard.ZstdDecompressor(dict_data=_dict(shared.value))
        for b in batches:
            if any(h != name for h in b.column(1).to_pylist()):
                raise ValueError("a row was compressed with another dictionary")
            texts = [None if p is None else enc.decode(np.frombuffer(unpack.decompress(p), f"<u{w}").tolist()) for p, w in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    source = encoded.select("doc_id", "dict_hash", "id_bytes", "payload")
    return source.mapInArrow(tidy(work), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def write_shards(encoded: DataFrame, dictionary: bytes, path: str) -> None:
    """Write the payloads, a file for each shard in order of offset, the index and the dictionary by its hash.

    Nothing is shuffled: each task writes its own shard, and the index is read off the written files.
    """
    spark = encoded.sparkSession
    files = encoded.select("shard", "offset", "payload", *[c for c in encoded.columns if c not in ("shard", "offset", "payload")])
    files.write.options(**{"parquet.block.size": GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "false", "compression": "none"}).parquet(f"{path}/shards")
    spark.read.schema(files.schema).parquet(f"{path}/shards").drop("payload").write.parquet(f"{path}/index")
    spark.createDataFrame([(dictionary_hash(dictionary), bytearray(dictionary))], "dict_hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionaries")


def payloads(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The index rows of the chosen documents with their payloads: the places of the index are pushed to the scan, so
    row groups and pages without them aren't read."""
    index = spark.read.parquet(f"{path}/index").where(F.col("doc_id").isin(doc_ids))
    places = index.select("shard", "offset", "length").where("length > 0").distinct().collect()  # as many as were asked for
    wanted = F.lit(False)
    for r in places:
        wanted = wanted | ((F.col("shard") == r["shard"]) & (F.col("offset") == r["offset"]))
    found = spark.read.parquet(f"{path}/shards").where(wanted & (F.col("length") > 0)).select("shard", "offset", "payload")
    return index.join(found, (index["shard"] == found["shard"]) & (index["offset"] == found["offset"]) & (index["length"] > 0), "left").select(*[index[c] for c in index.columns], "payload")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of the chosen documents."""
    chosen = payloads(spark, path, doc_ids)
    hashes = {r["dict_hash"] for r in chosen.select("dict_hash").distinct().collect()}
    if len(hashes) > 1:
        raise ValueError("the documents are of several dictionaries")
    if not hashes:
        return chosen.select("doc_id", F.lit(None).cast("string").alias("text"))
    (name,) = hashes
    dictionary = bytes(spark.read.parquet(f"{path}/dictionaries").where(F.col("dict_hash") == name).first()["data"])
    return decode(chosen, dictionary, vocabulary)
