"""Best-fit packing after Martello and Toth's dominance reduction.

Whether documents fit together depends on their lengths only, and a length lies between 1 and the
capacity. So the plan is made on the histogram of lengths, which has at most `capacity` rows however
many documents there are: first sets that provably dominate every other choice for some length are
fixed, all copies at once, then the rest is packed best-fit, longest first. The plan is a list of
patterns with a number of copies. Every piece gets a rank among the pieces of its length, from counts
per bucket and the place in its bucket, and looks its sequence and offset up in the plan.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches, exchange_sizes, staged
from veritally.llm.tokens import tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END_ID = 1


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns that some optimal packing contains, with their number, and what is left.

    For a length a with room r beside it, the set {a, b} with b the largest that fits is fixed if
    b = r, or if no two others fit into r together; {a} alone if nothing fits; {a, b, q} if no three
    others fit, b and q fill the room greedily, and no pair that fits has a smaller half above q.
    Any other set with a then has partners that fit, one by one, into those of the fixed set.
    """
    left = {x: n for x, n in counts.items() if n}
    sizes = sorted(left)
    fixed = []

    def largest(room: int, used: dict[int, int]) -> int:
        i = bisect.bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] <= used.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def smallest(used: dict[int, int], n: int) -> list[int]:
        out = []
        for x in sizes:
            out += [x] * min(n - len(out), left[x] - used.get(x, 0))
            if len(out) == n:
                break
        return out

    def choice(a: int) -> tuple[int, ...] | None:
        room, used = capacity - a, {a: 1}
        b = largest(room, used)
        if not b:
            return (a,)
        if b == room:
            return (a, b)
        low = smallest(used, 3)
        if len(low) < 2 or low[0] + low[1] > room:
            return (a, b)
        if len(low) == 3 and sum(low) <= room:
            return None
        used[b] = used.get(b, 0) + 1
        q = largest(room - b, used)
        # of each pair x >= y that fits, y is at most half of the room
        half = largest(room // 2, {a: 1})
        return (a, b, q) if q and half <= q else None

    changed = True
    while changed and sizes:
        changed = False
        for a in sorted(sizes, reverse=True):
            while left.get(a):
                found = choice(a)
                if found is None:
                    break
                need = {x: found.count(x) for x in found}
                # all copies at once while the same choice stands: one length runs out, or keeps what others need
                n = max(1, min(left[x] // k for x, k in need.items()) - 1)
                fixed.append((found, n))
                for x, k in need.items():
                    left[x] -= n * k
                    if not left[x]:
                        del left[x]
                        sizes.remove(x)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each piece goes to the fullest sequence that still has room."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    full = []

    def put(pattern, room, n):
        if not n:
            return
        if room == 0:
            full.append((pattern, n))
            return
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((pattern, n))

    for a in sorted(counts, reverse=True):
        n = counts[a]
        while n:
            i = bisect.bisect_left(rooms, a)
            if i == len(rooms):
                each = capacity // a
                if n >= each:
                    put((a,) * each, capacity - each * a, n // each)
                if n % each:
                    put((a,) * (n % each), capacity - n % each * a, 1)
                break
            room = rooms[i]
            pattern, have = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // a
            some = min(have, n // each)
            if some:
                put(pattern + (a,) * each, room - each * a, some)
                n -= some * each
                have -= some
            if have and n and n < each:
                put(pattern + (a,) * n, room - n * a, 1)
                n, have = 0, have - 1
            put(pattern, room, have)
    return full + [x for room in rooms for x in open_[room]]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """All patterns with their number, and how many sequences the reduction fixed."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity), sum(n for _, n in fixed)


def _runs(patterns) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: of one length, `each` pieces to a sequence, from `low` on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            each = pattern.count(x)
            low = used.get(x, 0)
            rows.append((x, low, each, sequence, offset))
            used[x] = low + n * each
            offset += x * each
        sequence += n
    rows.sort()
    names = ("length", "low", "each", "sequence", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def _cut(path: str, capacity: int):
    def run(batches):
        encode = tokenizer(path)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lo in range(0, table.num_rows, 512):
                part = table.slice(lo, 512)
                ids, n = encode.ids(part["text"])
                stop = np.cumsum(n)
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for d, b, m in zip(part["doc_id"].to_pylist(), stop.tolist(), n.tolist(), strict=True):
                    whole = np.empty(m + 1, "<u4")
                    whole[:m] = ids[b - m:b]
                    whole[m] = END_ID
                    for k, at in enumerate(range(0, m + 1, capacity)):
                        x = whole[at:at + capacity]
                        for name, value in (("doc_id", d), ("piece", k), ("start", at), ("length", len(x)), ("ids_crc32", zlib.crc32(x.tobytes()))):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})

    return run


def ranked(rows: DataFrame, by: list[str], order: list[str], spread: list[str]) -> DataFrame:
    """rows with `rank`: the place, from 0, among the rows of equal `by`. No task sees more of a
    `by` group than one bucket of it."""
    _, buckets = exchange_sizes(rows.sparkSession)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    keys = [*by, "_b"]
    count = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = upto if not by else Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = count.select(*keys, (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(count, keys).withColumn("rank", (F.col("_before") + place - 1).cast("long")).drop("_b", "_before")


def _assign(runs: dict[str, np.ndarray], capacity: int):
    # one increasing key for (length, rank): ranks of a length are shifted by all ranks before
    def run(batches):
        low, length = runs["low"], runs["length"]
        edge = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            x, r = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.empty(len(x), np.int64)
            for v in np.unique(x):
                m = x == v
                at[m] = edge[v] + np.searchsorted(low[edge[v]:edge[v + 1]], r[m], "right") - 1
            inside, each = r - low[at], runs["each"][at]
            sequence = runs["sequence"][at] + inside // each
            offset = runs["offset"][at] + inside % each * x
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut at `capacity`: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut(path, capacity), PIECES)


def best_fit_pack(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece (from 0), start (ids of the document before it), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit), sequence_id and offset (gapless from 0).
    Null and empty texts are one end id. Rows with one id, or a null id, are packed as separate
    documents. Empty table: empty result. Other columns are not read. The pieces, without their ids,
    are written once to the shared folder; only the histogram of lengths, at most `capacity` rows,
    reaches the driver.
    """
    bounded_batches(docs.sparkSession)
    pieces = staged(token_pieces(docs, path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns, _ = plan(counts, capacity)
    rank = ranked(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], ["doc_id", "piece"])
    return rank.mapInArrow(_assign(_runs(patterns), capacity), PIECES + ", sequence_id long, offset long")
