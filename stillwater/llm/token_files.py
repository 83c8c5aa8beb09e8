"""Token-id files: one zstandard frame per document, compressed with a shared dictionary.

Layout of a token folder, written with Spark's own writers so that any file system works and a
lost executor only costs its task:

* ``dictionary/`` one row: ``dict_hash`` (sha256 of the bytes), ``dictionary`` (bytes trained on
  serialized id arrays; empty if there were too few to train on), ``dtype``, ``end_id``.
* ``blocks/`` rows ``part, no, n_docs, local_start, n_tokens, first_id, last_id, dict_hash, index,
  payload``.  ``payload`` holds the frames one after another; ``index`` is the serialized table of
  doc_id, n_tokens and byte offset per document, so that one short document is read by
  decompressing its own frame alone.  Blocks ordered by (part, no) hold documents in ascending
  doc_id order.
* ``parts/`` rows ``part, start, n_tokens``: ids before each range partition.

Ids are serialized little-endian, 16 bits wide where the vocabulary allows, else 32.

Defined results: a null text is empty and keeps its end id; a null doc_id sorts first; rows that
share a doc_id are all written, ordered by a hash of their text; an empty table gives empty
files.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwater.llm._bpe import encode_column, encoder
from stillwater.session import ship

#: documents whose id arrays train the dictionary (expected number, and the most), and its bytes
DICT_DOCS, DICT_DOCS_MOST, DICT_BYTES, DICT_SAMPLE_BYTES = 1000, 4000, 32 << 10, 4096
#: serialized ids in a block
BLOCK_BYTES = 2 << 20

BLOCKS = "part int, no int, n_docs int, local_start long, n_tokens long, first_id long, last_id long, dict_hash string, index binary, payload binary"


def _train(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        dtype, samples = encoder(path).dtype, []
        for batch in batches:
            for ids, counts in encode_column(batch, "text", path):
                for doc in np.split(ids.astype(dtype), np.cumsum(counts)[:-1]):
                    samples += [doc.tobytes()[i : i + DICT_SAMPLE_BYTES] for i in range(0, min(doc.nbytes, 8 * DICT_SAMPLE_BYTES), DICT_SAMPLE_BYTES)]
        samples.sort(key=lambda s: hashlib.sha256(s).digest())
        try:
            got = zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
        except zstandard.ZstdError:
            got = b""
        yield pa.RecordBatch.from_pydict({"dict_hash": [hashlib.sha256(got).hexdigest()], "dictionary": pa.array([got], pa.binary()), "dtype": [np.dtype(dtype).name]})

    return run


def train_dictionary(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", size: int = DICT_BYTES) -> tuple[str, bytes, str]:
    """(hash, bytes, dtype) of a dictionary trained on about ``DICT_DOCS`` documents, those whose hashed id and text
    fall into one residue class (of more than ``DICT_DOCS_MOST``, those of least hash); of each, the first
    8 x ``DICT_SAMPLE_BYTES`` of serialized ids.  Without any the dictionary is empty."""
    m = max(1, docs.count() // DICT_DOCS)
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    sample = docs.where(F.pmod(h, F.lit(m)) == 0).select(h.alias("h"), F.col(text_col).alias("text"))
    sample = sample.orderBy("h", "text").limit(DICT_DOCS_MOST).select("text")
    rows = sample.repartition(1).mapInArrow(_train(tokenizer, size), "dict_hash string, dictionary binary, dtype string").collect()
    if not rows:
        return hashlib.sha256(b"").hexdigest(), b"", np.dtype(encoder(tokenizer).dtype).name
    return rows[0]["dict_hash"], bytes(rows[0]["dictionary"]), rows[0]["dtype"]


def _pack(index: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **index)
    return out.getvalue()


def _compressor(data: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data) if data else None, write_checksum=False)


def _decompressor(data: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)


def _writer(path: str, dict_hash: str, dictionary: bytes, dtype: str, end_id: int | None, level: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, local = TaskContext.get().partitionId(), 0, 0
        zip_, kind = _compressor(dictionary, level), np.dtype(dtype)
        end = np.array([] if end_id is None else [end_id], dtype=kind)
        ids_, valid, frames, counts, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(f) for f in frames], dtype=np.int64)
            index = _pack({"doc_id": np.array(ids_, dtype=np.int64), "valid": np.array(valid, dtype=bool), "n_tokens": np.array(counts, dtype=np.int64), "offset": np.concatenate([[0], np.cumsum(sizes)])})
            known = [i for i, v in zip(ids_, valid, strict=True) if v]
            row = (part, no, len(frames), local, sum(counts), min(known, default=None), max(known, default=None), dict_hash, index, b"".join(frames))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            documents = (ids for tokens, n in encode_column(batch, "text", path) for ids in np.split(tokens.astype(kind), np.cumsum(n)[:-1]))
            for doc_id, ids in zip(batch.column(0).to_pylist(), documents, strict=True):
                own = np.concatenate([ids, end])
                ids_.append(0 if doc_id is None else doc_id)
                valid.append(doc_id is not None)
                frames.append(zip_.compress(own.tobytes()))
                counts.append(len(own))
                held += own.nbytes
                if held >= block_bytes:
                    yield block()
                    local += sum(counts)
                    no, held = no + 1, 0
                    ids_, valid, frames, counts = [], [], [], []
        if frames:
            yield block()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", level: int = 3, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode every whole text and write the token folder ``path``."""
    spark = ship(docs.sparkSession)
    dict_hash, dictionary, dtype = train_dictionary(docs, tokenizer, text_col, id_col)
    spark.createDataFrame([(dict_hash, bytearray(dictionary), dtype, end_id)], "dict_hash string, dictionary binary, dtype string, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    # rows of one doc_id, and rows alike, may go to several tasks
    rows = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    rows.mapInArrow(_writer(tokenizer, dict_hash, dictionary, dtype, end_id, level, block_bytes), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    parts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    # one row per range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).write.parquet(f"{path}/parts")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary of {path} doesn't have its hash")
    return row["dict_hash"], data, row["dtype"]


def _index(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def _reader(dict_hash: str, dictionary: bytes, dtype: str, digest: bool, only: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, kind = _decompressor(dictionary), np.dtype(dtype)
        for batch in batches:
            for r in range(batch.num_rows):
                hash_, index, payload, begin = (batch.column(c)[r].as_py() for c in range(4))
                if hash_ != dict_hash:
                    raise ValueError("a block was written with another dictionary")
                x = _index(index)
                starts = begin + np.concatenate([[0], np.cumsum(x["n_tokens"])])[:-1]
                take = range(len(starts)) if only is None else np.flatnonzero(x["valid"] & (x["doc_id"] == only)).tolist()
                own = (np.frombuffer(unzip.decompress(payload[x["offset"][i] : x["offset"][i + 1]]), dtype=kind) for i in take)
                if digest:
                    last, kept = [zlib.crc32(a.astype("<u4").tobytes()) for a in own], list(take)
                    last = pa.array(last, pa.int64())
                else:
                    lists, kept = [a.astype(np.int32) for a in own], list(take)
                    last = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(a) for a in lists])]).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *lists]))
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"][kept], mask=~x["valid"][kept]), pa.array(starts[kept], pa.int64()), pa.array(x["n_tokens"][kept], pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, digest: bool = False, only: int | None = None) -> DataFrame:
    """Documents of a token folder: doc_id, start, n_tokens and ids (with ``digest`` their crc32 instead).

    With ``only`` one document: blocks are pruned by their id range, and just its frames are decompressed.
    """
    dict_hash, data, dtype = _dictionary(ship(spark), path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if only is not None:
        blocks = blocks.where((F.col("first_id") <= only) & (F.col("last_id") >= only))
    parts = spark.read.schema("part int, n_tokens long, start long").parquet(f"{path}/parts").select("part", "start")
    rows = blocks.join(parts, "part").select("dict_hash", "index", "payload", (F.col("start") + F.col("local_start")).alias("begin"))
    return rows.mapInArrow(_reader(dict_hash, data, dtype, digest, only), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")
