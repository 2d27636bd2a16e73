"""Training-order materialisation.

Documents become sequences of at most `length` token ids. A keyed Feistel permutation of the numbers
0..n-1 gives every sequence its slot in the training order: a balanced network permutes the next larger
power of four, and a number that falls outside 0..n-1 is sent through again until it falls inside
(cycle-walking), which keeps it a permutation. Slots are dealt by range, a range is one shard file,
and every record has the same stride, so the record of slot s is at a known byte of a known file:
a reader that stopped at any slot goes on from there.

Numbers come from two passes over the table. The first counts the sequences of each scan partition, so
each partition has a first number, and takes a checksum of the ids and lengths in their order; the
second numbers the sequences as it meets them and fails if its checksum differs, so that a source
whose partitions are not stable is refused instead of numbered twice. Texts are not shuffled; ids are,
once, compressed, to their shard. A shard is written under another name and renamed, so repeated
tasks do no harm, and its content is a function of the rows alone.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches, fresh
from veritally.llm.ngram import local_folder
from veritally.llm.packing import END_ID
from veritally.llm.tokens import tokenizer

U = np.uint64
ROUNDS = 6
OUT = "doc_id long, piece int, length long, number long, slot long, shard long, record long, ids_crc32 long"


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = W.mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key % (1 << 64)))

    def _pass(self, x: np.ndarray, keys) -> np.ndarray:
        low = U((1 << self.half) - 1)
        left, right = x >> U(self.half), x & low
        for k in keys:
            left, right = right, left ^ (W.mix(right + k) & low)
        return (left << U(self.half)) | right

    def _unpass(self, x: np.ndarray) -> np.ndarray:
        low = U((1 << self.half) - 1)
        left, right = x >> U(self.half), x & low
        for k in self.keys[::-1]:
            left, right = right ^ (W.mix(left + k) & low), left
        return (left << U(self.half)) | right

    def _walk(self, x, step) -> np.ndarray:
        x = np.asarray(x, np.int64).astype(U)
        out = step(x)
        while (far := out >= U(self.n)).any():
            out[far] = step(out[far])
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, lambda x: self._pass(x, self.keys))

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self._unpass)


def stride(length: int) -> int:
    """Bytes of a record: the number of ids, then `length` little-endian 16-bit ids."""
    return 4 + 2 * length


def _pieces(path: str, batches):
    """Slices of the batches with their ids, end ids included, and a running checksum."""
    encode, check = tokenizer(path), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            ids, n = encode.ids(part["text"])
            if len(ids) and int(ids.max()) >= 1 << 16:
                raise ValueError(f"id {int(ids.max())} does not fit into the 16 bits of a record")
            check = zlib.crc32(n.tobytes(), zlib.crc32(W.ids_of(part["doc_id"]).tobytes(), check))
            yield part["doc_id"].to_pylist(), ids, n, check


def _count(path: str, length: int):
    def run(batches):
        total = check = 0
        for _, _, n, check in _pieces(path, batches):
            total += int((n // length + 1).sum())
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([total]), "check": pa.array([check])})

    return run


def _number(path: str, length: int, first: dict[int, tuple[int, int]], order: Feistel, per_shard: int):
    """Sequences with number and slot, ids compressed."""
    import zstandard

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        number, wanted = first.get(TaskContext.get().partitionId(), (0, 0))
        check = 0
        for docs, ids, n, check in _pieces(path, batches):
            out = {k: [] for k in ("doc_id", "piece", "length", "ids_crc32", "ids")}
            for d, b, m in zip(docs, np.cumsum(n).tolist(), n.tolist(), strict=True):
                whole = np.empty(m + 1, "<u4")
                whole[:m] = ids[b - m:b]
                whole[m] = END_ID
                for k, at in enumerate(range(0, m + 1, length)):
                    x = whole[at:at + length]
                    for name, value in (("doc_id", d), ("piece", k), ("length", len(x)), ("ids_crc32", zlib.crc32(x.tobytes())), ("ids", press.compress(x.astype("<u2").tobytes()))):
                        out[name].append(value)
            count = len(out["doc_id"])
            numbers = number + np.arange(count)
            number += count
            slot = order.slots(numbers)
            yield pa.RecordBatch.from_arrays([
                pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["length"], pa.int64()), pa.array(numbers), pa.array(slot),
                pa.array(slot // per_shard), pa.array(out["ids_crc32"], pa.int64()), pa.array(out["ids"], pa.binary())],
                names=["doc_id", "piece", "length", "number", "slot", "shard", "ids_crc32", "ids"])
        if check != wanted:
            raise RuntimeError("the rows of a partition changed between two passes; write the table first")

    return run


def _write(folder: str, length: int, per_shard: int):
    import zstandard

    def run(shard: pa.Table) -> pa.Table:
        press = zstandard.ZstdDecompressor()
        shard = shard.combine_chunks().sort_by("slot")
        number = shard["shard"][0].as_py()
        part = f"{folder}/{number:08d}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for n, ids in zip(shard["length"], shard["ids"], strict=True):
                f.write(n.as_py().to_bytes(4, "little") + press.decompress(ids.as_py(), 2 * length).ljust(2 * length, b"\0"))
        os.replace(part, f"{folder}/{number:08d}.bin")
        record = pa.array(shard["slot"].to_numpy() - number * per_shard)
        return shard.drop_columns(["ids"]).append_column("record", record).select(["doc_id", "piece", "length", "number", "slot", "shard", "record", "ids_crc32"])

    return run


def training_order(docs: DataFrame, path: str, length: int = 512, key: int = 20_240_117, per_shard: int = 16_384, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents as fixed-stride shards in a keyed order and returns where each sequence is.

    A document's ids and the end id are cut at `length`; ids that do not fit into 16 bits are an error. Returns a row per
    sequence: doc_id, piece, length, number (its place before the permutation), slot (0..n-1, each
    once), shard, record (place in the shard) and ids_crc32 (of the ids as little-endian unsigned 32-bit). The
    shards lie in `folder`, by default a new one in the shared folder, as 00000000.bin and so on,
    with layout.json. The folder must be mounted on all workers.
    Null and empty texts are one end id. Rows with one id, or a null id, are separate documents.
    Empty table: empty result and no shard. Other columns are not read. docs must be a table scan (its
    partitions are read twice and must not change).
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    folder = local_folder(folder or fresh(spark, "order"))
    os.makedirs(folder, exist_ok=True)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first, total = {}, 0
    for r in sorted(docs.mapInArrow(_count(path, length), "part int, n long, check long").collect()):
        first[r["part"]] = total, r["check"]
        total += r["n"]
    with open(f"{folder}/layout.json", "w") as f:
        json.dump({"sequences": total, "length": length, "stride": stride(length), "per_shard": per_shard, "key": key}, f)
    numbered = docs.mapInArrow(
        _number(path, length, first, Feistel(max(total, 1), key), per_shard),
        "doc_id long, piece int, length long, number long, slot long, shard long, ids_crc32 long, ids binary")
    return numbered.groupBy("shard").applyInArrow(_write(folder, length, per_shard), OUT)


def read_from(folder: str, slot: int = 0):
    """The sequences of a written folder from a slot on, in order, as arrays of ids."""
    with open(f"{folder}/layout.json") as f:
        layout = json.load(f)
    while slot < layout["sequences"]:
        shard, record = divmod(slot, layout["per_shard"])
        data = np.memmap(f"{folder}/{shard:08d}.bin", np.uint8, "r").reshape(-1, layout["stride"])
        for row in data[record:]:
            n = int(row[:4].view("<u4")[0])
            yield row[4:4 + 2 * n].view("<u2").astype(np.int64)
            slot += 1
