"""Training-order materialisation of token sequences.

Documents are encoded once and laid end to end, each behind an end token; every ``length`` ids make
a sequence.  A keyed Feistel network with cycle-walking permutes the sequence numbers: each
sequence knows its global slot without any sort or table.  Pieces of documents move once, to the
range of slots they belong to, and each range writes whole shards of fixed stride, so that a
reader finds slot ``s`` at byte ``(s % per_shard) * stride`` of shard ``s // per_shard``, reads
on sequentially and can go on from any slot.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage, drop_steps, new_table_path

from .tokens import DEFAULT_VOCABULARY, Tokenizer, end_token
from .words import mix, slices

LENGTH = 2048
PER_SHARD = 4096
ROUNDS = 6
KEY = 20_240_607
SLICE = 8 << 20


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each number below ``n``: a one-to-one map of 0..n-1 that depends on ``key``.

    Numbers are split into two halves of equal width; a result outside the range goes through the
    network again until it falls inside, which keeps the map one to one.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(key))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


class _ShardWriter:
    """Writes one shard after another; a shard appears under its name only when it is whole."""

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(folder)
        self.shard = self.stream = self.path = None

    def write(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.path = shard, f"{self.folder}/_part-{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.path)
        self.stream.write(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(self.path, f"{self.folder}/{shard_name(self.shard)}")
            self.stream = None


def _stored(df: DataFrame) -> DataFrame:
    """Write ids and read them back; zstd makes them half as long as they are."""
    path = new_table_path(df.sparkSession, "tokens")
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``part``, ``before`` (ids before the document in its part), ``n``, ``id``, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, before = Tokenizer(vocabulary), 0
        part_number = TaskContext.get().partitionId()
        end = np.array([tokenizer.end], tokenizer.dtype)
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                coded = [np.concatenate([ids, end]) for ids in tokenizer.encode(part)]
                n = np.fromiter(map(len, coded), np.int64, len(coded))
                stops = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), part_number, np.int64)),
                        pa.array(stops - n),
                        pa.array(n),
                        batch.column(0).slice(part.first, part.n_texts),
                        pa.array([c.tobytes() for c in coded], pa.binary()),
                    ],
                    ["part", "before", "n", "id", "ids"],
                )
                before = int(stops[-1])

    return docs.mapInArrow(run, "part long, before long, n long, id long, ids binary")


def _pieces(encoded: DataFrame, length: int, n_sequences: int, key: int, item: int) -> DataFrame:
    """Pieces of documents, compressed, with the slot and place they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            offset, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            first, last = offset // length, (offset + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            begin = np.maximum(offset[row], sequence * length)
            stop = np.minimum((offset + n)[row], (sequence + 1) * length)
            slot = permuted(sequence, n_sequences, key)
            ids = batch.column(3)
            # One piece at a time keeps a long document from being copied as a whole.
            for a in range(0, len(row), 4096):
                b = min(a + 4096, len(row))
                cut = []
                for i in range(a, b):
                    data = ids[int(row[i])].as_buffer()
                    at = int(begin[i] - offset[row[i]]) * item
                    cut.append(press.compress(data.slice(at, int(stop[i] - begin[i]) * item).to_pybytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot[a:b]),
                        pa.array(sequence[a:b]),
                        pa.array((begin - sequence * length)[a:b]),
                        batch.column(2).take(pa.array(row[a:b])),
                        pa.array(cut, pa.binary()),
                    ],
                    ["slot", "sequence", "place", "id", "ids"],
                )

    return encoded.select("offset", "n", "id", "ids").mapInArrow(
        run, "slot long, sequence long, place long, id long, ids binary"
    )


def write_training_order(
    docs: DataFrame,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
) -> DataFrame:
    """Write all texts as shards of token sequences in a keyed order, and list the sequences.

    Returns ``slot``, ``sequence``, ``shard``, ``byte_offset``, ``n_tokens``, ``crc32`` (of the
    stride as written) and ``doc_ids`` (in the order of their pieces) for each sequence.
    ``folder`` must be one that driver and executors share; without it a new one is made in the
    shared folder of the session.  ``order.json`` beside the shards says how to read them.

    Documents follow one another as Spark reads ``docs``: the same files and split sizes give the same
    sequences.  A null or empty text is its end token alone; a null id is a null in ``doc_ids``;
    repeated rows are written as often as they are there.  The last sequence is filled up with end
    tokens, which ``n_tokens`` leaves out.  An empty table writes no shard and gives an empty
    result.  Extra columns are ignored.  A lost task writes its shards again: a shard gets its name
    when it is whole, and its bytes do not depend on the attempt.
    """
    if length < 1 or per_shard < 1:
        raise ValueError("length and per_shard must be at least 1")
    spark = docs.sparkSession
    folder = (folder or new_table_path(spark, "shards")).rstrip("/")
    end = end_token(vocabulary)
    dtype = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
    stride = length * dtype.itemsize
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    encoded = _stored(_encoded(source, vocabulary))
    parts = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(
        parts.select("part", "total", F.coalesce(F.sum("total").over(across), F.lit(0)).alias("start")), "starts"
    )
    n_tokens = starts.agg(F.sum("total")).first()[0] or 0
    n_sequences = -(-n_tokens // length)
    target, path = file_system(folder)
    target.create_dir(path, recursive=True)
    with target.open_output_stream(f"{path}/order.json") as out:
        out.write(
            json.dumps(
                {"length": length, "per_shard": per_shard, "dtype": dtype.str, "end": end, "key": key,
                 "rounds": ROUNDS, "tokens": n_tokens, "sequences": n_sequences}
            ).encode()
        )
    placed = encoded.join(F.broadcast(starts), "part").withColumn(  # one small row per task that encoded
        "offset", F.col("start") + F.col("before")
    )
    n_shards = max(1, -(-n_sequences // per_shard))
    tasks = min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, held, rows = _ShardWriter(folder), None, []
        fill, unpack = np.array([end], dtype).tobytes(), zstandard.ZstdDecompressor()

        def finish() -> None:
            slot, sequence, ids, parts = held
            data = b"".join(parts)
            n = len(data) // dtype.itemsize
            data += fill * (length - n)
            shard = slot // per_shard
            writer.write(shard, data)
            rows.append((slot, sequence, shard, (slot % per_shard) * stride, n, zlib.crc32(data), ids))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.list_(pa.int64()))],
                ["slot", "sequence", "shard", "byte_offset", "n_tokens", "crc32", "doc_ids"],
            )

        for batch in batches:
            for slot, sequence, doc, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if held is None or held[0] != slot:
                    if held is not None:
                        finish()
                    held = slot, sequence, [], []
                held[2].append(doc)
                held[3].append(unpack.decompress(ids))
            yield flush()
        if held is not None:
            finish()
        writer.close()
        yield flush()

    schema = "slot long, sequence long, shard long, byte_offset long, n_tokens long, crc32 long, doc_ids array<long>"
    listed = (
        _pieces(placed, length, n_sequences, key, dtype.itemsize)
        .withColumn("shard", F.floor(F.col("slot") / per_shard))
        .repartitionByRange(tasks, "shard")
        .sortWithinPartitions("slot", "place")
        .drop("shard")
        .mapInArrow(run, schema)
    )
    sequences = cut_lineage(listed, "sequences")
    drop_steps(encoded, starts)
    return sequences


def read_slots(folder: str, first: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """The sequences from slot ``first`` on, as arrays of ids, read shard after shard."""
    source, path = file_system(folder.rstrip("/"))
    with source.open_input_stream(f"{path}/order.json") as lines:
        order = json.loads(lines.read())
    dtype, stride = np.dtype(order["dtype"]), order["length"] * np.dtype(order["dtype"]).itemsize
    last = order["sequences"] if count is None else min(order["sequences"], first + count)
    while first < last:
        shard, at = divmod(first, order["per_shard"])
        with source.open_input_file(f"{path}/{shard_name(shard)}") as data:
            data.seek(at * stride)
            while first < last and first // order["per_shard"] == shard:
                yield np.frombuffer(data.read(stride), dtype)
                first += 1
