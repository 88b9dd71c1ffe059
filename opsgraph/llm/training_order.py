"""Training-order materialisation: a keyed permutation gives every sequence its slot.

Each document's token ids are cut into sequences of ``length`` tokens (the last one
padded with zeros).  Sequences are numbered without gaps in the order of the table's
scan, and number x goes to slot P(x), where P is a Feistel permutation of the next
power of four, walked until it falls below the number of sequences.  Shard k holds the
slots from k * ``shard_rows`` on.

``write_shards`` reads the table twice: once for the number of sequences of each scan
partition, once to cut, pack and send them.  The rows go by ranges of slots to tasks
that sort them and write each shard as one file of records of one size:

    doc_id (8 bytes, little endian; the least value stands for null), number of the
    sequence in its document (4), number of tokens (4), ``length`` ids, a line end

so record r of a shard begins at byte r * stride and can be read, mapped or resumed
from there without reading what lies before.  ``read_shards`` does so; whole shards
before the first wanted slot are not opened.  A manifest beside the shards tells a later job what
it must know (``Shards.load``).  Each shard is one file, whatever the session's settings; a reader
that meets a file of another length, or several for a shard, or misses one, fails.

An id takes one, two or four bytes, as the vocabulary needs.  The default tokenizer
gives the UTF-8 bytes as ids; ``ranks`` (from ``read_ranks``, "<base64> <rank>" lines)
gives byte-pair ids.  The vocabulary is read once, on the driver, and broadcast.

Both reads of the table must meet the same partitions in the same order.  That holds
for files, while the number of splits is pinned (done here); any other DataFrame is
written to the shared folder first.  A task that meets another number of sequences
than were counted fails the job.

Defined cases: null and empty texts have no sequence; a null doc_id is kept as null;
repeated rows are sequences of their own; very long texts are cut whole; an empty table
writes no shard and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_dir, table
from .textops import mix

LENGTH = 2048
SHARD_ROWS = 8192
KEY = 20_240_607
ROUNDS = 6
MAX_RANGES = 20_000
FLUSH_BYTES = 32 << 20
LEVEL = 6
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def feistel(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of range(n); cycle-walking keeps it inside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Shards:
    """What a reader must know of written shards."""

    path: str
    n: int
    length: int
    width: int
    shard_rows: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Shards:
        """What ``write_shards`` wrote below ``path``, from its manifest."""
        r = spark.read.schema("n long, length int, width int, shard_rows int").json(f"{path}/_manifest").first()
        return cls(path, r["n"], r["length"], r["width"], r["shard_rows"])

    def rows_of(self, shard: int) -> int:
        return min(self.shard_rows, self.n - shard * self.shard_rows)

    @property
    def stride(self) -> int:
        return 16 + self.length * self.width + 1

    @property
    def record(self) -> np.dtype:
        return np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n", "<i4"), ("ids", f"<u{self.width}", (self.length,)), ("end", "u1")])


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte-pair ranks of a file on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def id_width(ranks: dict[bytes, int] | None) -> int:
    """Bytes that the largest id needs."""
    most = max(ranks.values(), default=0) if ranks else 255
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def _encoder(ranks: dict[bytes, int] | None, pattern: str):
    """A function from UTF-8 bytes to the bytes of their ids."""
    if ranks is None:
        return lambda b: b
    import tiktoken

    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    kind = f"<u{id_width(ranks)}"
    return lambda b: np.array(enc.encode_ordinary(b.decode()), dtype=kind).tobytes()


def _counts(docs: DataFrame, length: int, ranks, pattern: str) -> dict[int, int]:
    """Sequences of each scan partition; one small row a partition reaches the driver."""
    if ranks is None:
        tokens = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    else:
        width = id_width(ranks.value)

        def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = _encoder(ranks.value, pattern)
            for part in parts:
                yield part.map(lambda t: len(encode((t or "").encode())) // width).astype("int64")

        tokens = F.pandas_udf(count, T.LongType())("text")
    per = docs.select(F.spark_partition_id().alias("p"), tokens.alias("n")).groupBy("p").agg(F.sum(F.expr(f"(n + {length - 1}) div {length}")).alias("s"))
    return {r["p"]: r["s"] for r in per.collect() if r["s"]}


def write_shards(documents: DataFrame, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY,
                 ranks: dict[bytes, int] | None = None, pattern: str = PATTERN, files: bool = False) -> Shards:
    """Write all sequences below ``path``; ``files`` says that ``documents`` is a plain scan of files."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs if files else materialize(docs, "order-docs")
    width = id_width(ranks)
    vocabulary = spark.sparkContext.broadcast(ranks) if ranks is not None else None
    setting = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, before or str(spark.sparkContext.defaultParallelism))
    try:
        counts = _counts(docs, length, vocabulary, pattern)
        n = sum(counts.values())
        shards = Shards(path, n, length, width, shard_rows)
        if shards.stride * min(n, shard_rows) >= 1 << 31:
            raise ValueError(f"a shard of {shard_rows} records of {shards.stride} bytes can't be one file under 2 GB")
        if n:
            _write(docs, shards, counts, key, vocabulary, pattern)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    manifest = spark.range(1, numPartitions=1).select(*[F.lit(v).alias(k) for k, v in (("n", n), ("length", length), ("width", width), ("shard_rows", shard_rows))])
    manifest.write.json(f"{path}/_manifest")
    return shards


def _write(docs: DataFrame, shards: Shards, counts: dict[int, int], key: int, vocabulary, pattern: str) -> None:
    spark = docs.sparkSession
    n, length, width, shard_rows = shards.n, shards.length, shards.width, shards.shard_rows
    bases, at = {}, 0
    for p in sorted(counts):
        bases[p] = at, counts[p]
        at += counts[p]
    bases = spark.sparkContext.broadcast(bases)
    n_shards = -(-n // shard_rows)
    ranges = min(n_shards, MAX_RANGES)
    size = length * width

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value if vocabulary else None, pattern)
        codec = pa.Codec("zstd", compression_level=LEVEL)
        base, expected = bases.value.get(TaskContext.get().partitionId(), (0, 0))
        done, held = 0, 0
        rows: list[tuple] = []

        def flush():
            x, doc, seq, payload = zip(*rows)
            slot = feistel(np.array(x), n, key)
            to = slot // shard_rows * ranges // n_shards
            order = np.lexsort((slot, to))
            cut = np.searchsorted(to[order], np.arange(ranges + 1))
            parts = np.flatnonzero(cut[1:] > cut[:-1])
            # neighbours in the table stay neighbours here, so copies compress well
            blobs = [pickle.dumps((slot[o], [doc[i] for i in o], [seq[i] for i in o], [payload[i] for i in o]), 5) for o in (np.sort(order[cut[p] : cut[p + 1]]) for p in parts)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([len(b) for b in blobs], pa.int64()), pa.array([codec.compress(b, asbytes=True) for b in blobs], pa.binary())], names=["range", "size", "blob"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encode(text.as_buffer().to_pybytes()) if text.is_valid else b""
                for i, start in enumerate(range(0, len(raw), size)):
                    rows.append((base + done, doc_id, i, raw[start : start + size]))
                    done += 1
                    held += min(size, len(raw) - start)
                    if held >= FLUSH_BYTES:
                        yield flush()
                        held = 0
        if done != expected:
            raise RuntimeError(f"partition has {done} sequences now, {expected} were counted: the input is not stable")
        if rows:
            yield flush()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for full, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                slot, doc, seq, payload = pickle.loads(pa.decompress(blob.as_buffer(), full, "zstd", asbytes=True))
                records = np.zeros(len(slot), shards.record)
                records["doc_id"] = [_NULL if d is None else d for d in doc]
                records["seq"], records["n"], records["end"] = seq, [len(p) // width for p in payload], 10
                raw = records.view(np.uint8).reshape(len(slot), shards.stride)
                for r, p in zip(raw, payload):
                    r[16 : 16 + len(p)] = np.frombuffer(p, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(slot // shard_rows), pa.array(slot), pa.array([r[:-1].tobytes() for r in raw], pa.binary())], names=["shard", "slot", "record"])

    sent = docs.mapInArrow(send, "range int, size long, blob binary").repartitionById(ranges, F.col("range"))
    laid = sent.mapInArrow(lay_out, "shard long, slot long, record binary").sortWithinPartitions("shard", "slot")
    # the text writer puts the bytes out as they are, with the line end of the record
    laid.select("shard", F.col("record").cast("string")).write.partitionBy("shard").option("compression", "none").option("maxRecordsPerFile", 0).text(shards.path)


_NULL = -(1 << 63)


def read_shards(spark: SparkSession, shards: Shards, slot: int = 0) -> DataFrame:
    """``slot, shard, row_in_shard, doc_id, seq_in_doc, n_tokens, payload`` from ``slot`` on, read at their byte offsets.

    ``payload`` holds ``length`` ids of ``width`` bytes, little endian.
    """
    schema = "slot long, shard long, row_in_shard int, doc_id long, seq_in_doc int, n_tokens int, payload binary"
    if not shards.n:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(shards.path).filter(F.col("shard") >= slot // shards.shard_rows)
    wanted = -(-shards.n // shards.shard_rows) - slot // shards.shard_rows
    there = files.agg(F.count("shard").alias("files"), F.count_distinct("shard").alias("shards")).first()
    if slot < shards.n and (there["files"], there["shards"]) != (wanted, wanted):
        raise RuntimeError(f"{wanted} shards from slot {slot} on, but {there['files']} files of {there['shards']} shards")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if len(content.as_buffer()) != shards.rows_of(shard) * shards.stride:
                    raise RuntimeError(f"shard {shard} has {len(content.as_buffer())} bytes, not {shards.rows_of(shard)} records of {shards.stride}")
                first = max(0, slot - shard * shards.shard_rows)
                records = np.frombuffer(content.as_buffer(), shards.record, offset=first * shards.stride)
                for i in range(0, len(records), 1024):
                    part = records[i : i + 1024]
                    row = np.arange(first + i, first + i + len(part))
                    doc = part["doc_id"]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard * shards.shard_rows + row), pa.array(np.full(len(part), shard, np.int64)), pa.array(row.astype(np.int32)), pa.array(doc, mask=doc == _NULL),
                        pa.array(part["seq"].astype(np.int32)), pa.array(part["n"].astype(np.int32)), pa.array([x.tobytes() for x in part["ids"]], pa.binary())],
                        names=["slot", "shard", "row_in_shard", "doc_id", "seq_in_doc", "n_tokens", "payload"])

    return files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(rows, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Write the shards of ``documents`` to the shared folder and read every record back."""
    shards = write_shards(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}", files=True)
    return read_shards(spark, shards).select("slot", "shard", "row_in_shard", "doc_id", "seq_in_doc", "n_tokens", F.crc32("payload").alias("payload_crc32"))
