"""N-gram Jaccard join with parity sketches.

Every distinct shingle flips one bit of a document's sketch, so bits shared by two documents cancel
and the Hamming distance of two sketches is at most the symmetric difference of the sets. Two sets
of sizes x, y with similarity p % or more differ in at most (x + y)(100 - p)/(100 + p) shingles,
which for all partners of a size band is at most k. A sketch of m > k pieces has at least m - k
equal pieces in both documents (pigeonhole), so documents are joined on (band, piece, content), and
every candidate is verified on its whole sets.

Sketches are long and sparse (a few set bits in a piece of `PIECE_BITS`), so equal pieces mean common
shingles, and unrelated documents do not meet. Pieces with less than two set bits say little: with
m = k + 1 + x, a document with fewer than m - k such pieces need not send them, as one of the equal
pieces must be a fuller one; the few documents with more of them send them all.

Groups of copies. Identical sets are one class with one representative. Every document is first
verified against the smallest one it shares a piece with; what is then connected needs no further
test for components. Of the groups of an equal piece that still hold several components, pairs from
different ones are compared by a short parity sketch, folded from the whole one, whose Hamming
distance is a lower bound too; the best pair for each document and other component is verified, and
in a last round all pairs that the bound leaves and that are still apart. Nothing is capped, and
pairs become rows only if the bound allows a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches, exchange_sizes, staged
from veritally.llm.graph import components

U = np.uint64
PIECE_BITS = 4096
FLUSH_KEYS = 750_000
SHORT = (8, 256)
DEAL_ROWS = 20_000


def shingle_sets(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and their number per text. A text of fewer
    than k words has one, its whole word sequence; one without words has none."""
    w = W.words(column, W.LOWER)
    h, at = W.grams(w, k)
    text = w.text_of()[at]
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    if len(short):
        first, more = w.first(), []
        for i in short:
            seed = np.zeros(1, U) + U(int(w.n[i]))
            for x in w.h[first[i]:first[i] + w.n[i]]:
                seed = W.mix(seed * U(W._STEP) + x)
            more.append(seed)
        h, text = np.concatenate([h, *more]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.bincount(text, minlength=len(w.n)).astype(np.int64)


class Bands:
    """Size bands: edges grow by 100 / percent, so partners are in one band or in neighbours."""

    def __init__(self, percent: int, largest: int):
        edge = [1]
        while edge[-1] <= largest:
            edge.append(100 * edge[-1] // percent + 1)
        self.edge = np.array(edge, np.int64)
        top = self.edge[1:] - 1
        k = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
        self.k = k
        self.m = k + 1 + np.where(k < 12, 0, np.ceil(0.06 * k + 1.2 * np.sqrt(k))).astype(np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, sizes, "right") - 1


def sketch_keys(h: np.ndarray, n: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pieces each set sends in the given band, and the index of the set. n > 0."""
    m, k = bands.m[band], bands.k[band]
    doc = np.repeat(np.arange(len(n)), n)
    bits = (m * PIECE_BITS).astype(U)
    bit = ((h >> U(32)) * bits[doc]) >> U(32)  # rises with h, so equal bits are neighbours
    new = np.ones(len(h), bool)
    new[1:] = (bit[1:] != bit[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    odd = first[np.diff(first, append=len(h)) % 2 == 1]  # parity
    bit, doc = bit[odd], doc[odd]
    start = np.cumsum(m) - m
    piece = start[doc] + (bit // U(PIECE_BITS)).astype(np.int64)
    total = int(m.sum())
    count = np.bincount(piece, minlength=total)
    value = np.zeros(total, U)
    if len(piece):
        edge = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        value[piece[edge]] = np.bitwise_xor.reduceat(W.mix(bit + U(1)), edge)
    owner = np.repeat(np.arange(len(n)), m)
    weak = count < 2
    some_weak = np.bincount(owner[weak], minlength=len(n))
    send = ~weak | (some_weak >= m - k)[owner]
    place = np.arange(total) - start[owner]
    salt = W.mix((place.astype(U) << U(16)) + band[owner].astype(U) + U(1))
    return W.mix(value ^ salt)[send], owner[send]


_MESSAGE = "bucket int, keys binary, docs binary"


def _send(k: int, percent: int, buckets: int):
    def flush(keys, docs):
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        cut = np.r_[0, np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(1, buckets)], U)), len(keys)]
        use = [i for i in range(buckets) if cut[i] < cut[i + 1]]
        return pa.RecordBatch.from_arrays([
            pa.array(use, pa.int32()), pa.array([W.pack(keys[cut[i]:cut[i + 1]]) for i in use], pa.binary()),
            pa.array([W.plain_pack(docs[cut[i]:cut[i + 1]]) for i in use], pa.binary())], names=["bucket", "keys", "docs"])

    def run(batches):
        keys, docs, have = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                h, n = shingle_sets(part["text"], k)
                ids = W.ids_of(part["doc_id"])
                full = (n > 0) & (ids != W.NO_ID)
                h, n, ids = h[np.repeat(full, n)], n[full], ids[full]
                if not len(n):
                    continue
                # of equal sets in the batch, one sends
                one = np.add.reduceat(W.mix(h), np.cumsum(n) - n) + n.astype(U)
                _, own = np.unique(one, return_index=True)
                pick = np.zeros(len(n), bool)
                pick[own] = True
                h, n, ids = h[np.repeat(pick, n)], n[pick], ids[pick]
                bands = Bands(percent, int(n.max()))
                band = bands.of(n)
                for b, use in ((band, np.ones(len(n), bool)), (band - 1, band > 0)):
                    key, owner = sketch_keys(h[np.repeat(use, n)], n[use], b[use], bands)
                    keys.append(key)
                    docs.append(ids[use][owner])
                    have += len(key)
            if have >= FLUSH_KEYS:
                yield flush(keys, docs)
                keys, docs, have = [], [], 0
                W.release()
        if have:
            yield flush(keys, docs)

    return run


def _meet(bucket: pa.Table) -> pa.Table:
    keys = np.concatenate([W.unpack(x) for x in bucket["keys"].to_pylist()])
    docs = np.concatenate([W.plain_unpack(x) for x in bucket["docs"].to_pylist()])
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(first, append=len(keys))
    # keys with the same documents are one group, named by a hash of these
    name = np.add.reduceat(W.mix(docs.view(U) + U(1)), first) if len(first) else keys[:0]
    _, one = np.unique(name, return_index=True)
    use = np.zeros(len(first), bool)
    use[one] = True
    use = np.repeat(use & (count > 1), count)
    W.release()
    return pa.table({"key": np.repeat(name, count)[use].view(np.int64), "doc": docs[use], "least": np.repeat(docs[first], count)[use]})


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                h, n = shingle_sets(part["text"], k)
                one, two = np.zeros(len(n), U), np.zeros(len(n), U)
                if len(h):
                    first, full = (np.cumsum(n) - n)[n > 0], n > 0
                    one[full], two[full] = np.add.reduceat(W.mix(h), first), np.add.reduceat(W.mix(h ^ U(0x5851F42D4C957F2D)), first)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *_sketches(h, n)], names=["doc_id", "n_shingles", "one", "two", "sketch", "short"])

    return run


def folded(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketches of two or more bits per shingle, a power of two in all, at least 64."""
    wide = np.array([max(6, int(2 * x - 1).bit_length()) if x else 6 for x in n.tolist()], np.int64)
    size = (1 << wide) // 64
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), U)
    doc = np.repeat(np.arange(len(n)), n)
    bit = h & ((np.ones(1, U) << wide[doc].astype(U)) - U(1))
    np.bitwise_xor.at(out, start[doc] + (bit >> U(6)).astype(np.int64), np.ones(1, U) << (bit & U(63)))
    return [out[a:a + b].tobytes() for a, b in zip(start, size, strict=True)]


def _sketches(h: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """The sketches, and their foldings to a half, which travel with every group a document is in.
    One bit per shingle still tells unrelated texts apart; a long text is in many groups, so its
    folding stops at the larger of SHORT, and pairs are compared by whole sketches before their sets."""
    whole = folded(h, n)
    short = [_fold(np.frombuffer(x, U), min(max(SHORT[0], len(x) // 16), SHORT[1])).tobytes() for x in whole]
    return [pa.array(whole, pa.binary()), pa.array(short, pa.binary())]


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    while x.shape[-1] > width:
        x = x[..., :x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2:]
    return x


def _may_link(percent: int):
    """Pairs whose sizes and sketches leave a link possible."""
    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            m, n = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            for i, (x, y) in enumerate(zip(batch["sketch_a"].to_pylist(), batch["sketch_b"].to_pylist(), strict=True)):
                width = min(len(x), len(y)) // 8
                apart = int(np.bitwise_count(_fold(np.frombuffer(x, U), width) ^ _fold(np.frombuffer(y, U), width)).sum())
                good[i] = apart * (100 + percent) <= (100 - percent) * (m[i] + n[i])
            good &= (100 * m >= percent * n) & (100 * n >= percent * m)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(good)), batch["b"].filter(pa.array(good))], names=["a", "b"])

    return run


def _across(percent: int, best: bool):
    """Of each group in a bucket, the pairs of different components that the sketches leave possible;
    with `best`, only the nearest one for each document and other component, and whether the group
    has more than these."""
    def compare(ids, part, n, sketches):
        width = min(len(x) for x in sketches) // 8
        x = np.stack([_fold(np.frombuffer(s, U), width) for s in sketches])
        step = max(1, (1 << 21) // max(1, len(ids) * width))
        for lo in range(0, len(ids), step):
            s = slice(lo, lo + step)
            apart = np.bitwise_count(x[s, None, :] ^ x[None, :, :]).sum(-1, dtype=np.int64)
            ok = (part[s, None] != part) & (apart * (100 + percent) <= (100 - percent) * (n[s, None] + n))
            ok &= (100 * n[s, None] >= percent * n) & (100 * n >= percent * n[s, None])
            if not best:
                ok &= ids[s, None] < ids
            i, j = np.nonzero(ok)
            all_pairs = len(i)
            if best and len(i):
                order = np.lexsort((apart[i, j], part[j], i))
                i, j = i[order], j[order]
                new = np.r_[True, (i[1:] != i[:-1]) | (part[j][1:] != part[j][:-1])]
                i, j = i[new], j[new]
            a, b = ids[s][i], ids[j]
            yield np.stack([np.minimum(a, b), np.maximum(a, b)]), len(i) < all_pairs

    def run(bucket: pa.Table) -> pa.Table:
        key = bucket["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        ids, part, n = (bucket[c].to_numpy()[order] for c in ("doc", "component", "n"))
        sketches = bucket["short"].take(pa.array(order)).to_pylist()
        key = key[order]
        edge = np.flatnonzero(np.r_[True, np.diff(key) != 0, True])
        pairs, more = [np.zeros((2, 0), np.int64)], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                for found, left in compare(ids[a:b], part[a:b], n[a:b], sketches[a:b]):
                    pairs.append(found)
                    if left:
                        more.append(key[a])
        pairs, more = np.unique(np.concatenate(pairs, axis=1), axis=1), np.unique(np.array(more, np.int64))
        out = pa.table({"a": np.r_[pairs[0], more], "b": np.r_[pairs[1], more], "more": np.arange(pairs.shape[1] + len(more)) >= pairs.shape[1]})
        W.release()
        return out

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                h, n = shingle_sets(part["text"], k)
                stop = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([W.pack(h[b - m:b]) for b, m in zip(stop, n, strict=True)], pa.binary())], names=["doc_id", "set"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            last, x = None, None
            for i, (a, b) in enumerate(zip(batch["set_a"], batch["set_b"], strict=True)):
                a, b = a.as_py(), b.as_py()
                if a != last:
                    last, x = a, W.unpack(a)
                y = W.unpack(b)
                s, t = (x, y) if len(x) < len(y) else (y, x)
                same = int(W.member(s, t).sum())
                good[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(good)), batch["b"].filter(pa.array(good))], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = staged(docs.join(need, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, set binary"), f"{name}-sets")
    a = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    return staged(pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long"), f"{name}-links")


def _dealt(mixed: DataFrame) -> DataFrame:
    """key and deal: groups (key, x, rows) with the same least component x go together.

    Two near copies share most of their pieces and so many groups. Dealt by themselves these are
    spread over all buckets, and each bucket finds the pair anew; together it is found once for each least
    component that its groups have. More
    than DEAL_ROWS rows of one component are dealt in several shares.
    """
    shares = mixed.groupBy("x").agg(F.ceil(F.sum("rows") / DEAL_ROWS).alias("shares"))
    share = F.pmod(F.xxhash64("key"), F.col("shares"))
    return mixed.join(shares, "x").select("key", F.xxhash64("x", share).alias("deal"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked by the Jaccard similarity of their sets of word k-shingles.

    Words are runs without white space 0x09-0x0D, 0x20, A-Z in lower case. A text of fewer than k
    words has one shingle, its whole sequence; a null text or one without words has none and is
    linked with nothing. Two documents link when 100 * intersection >= percent * union.
    Returns a row per document: doc_id, n_shingles, component_id (smallest id reachable by links,
    its own included). Rows with one id are one document with all their links; a row with a null id
    links with nothing and has a null component. Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    _, buckets = exchange_sizes(spark)
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes = docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, one long, two long, sketch binary, short binary")
    sizes = staged(sizes, "jaccard-sizes")
    full = sizes.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "one", "two"]
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    copies = staged(full.select("doc_id", *key).join(classes, key).where("doc_id <> rep").select(F.col("doc_id").alias("doc"), "rep"), "jaccard-copies")
    to = copies.groupBy("doc").agg(F.min("rep").alias("_rep"))

    def of_class(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(to.withColumnRenamed("doc", column), column, "left").withColumn(column, F.coalesce("_rep", column)).drop("_rep")

    shared = docs.mapInArrow(_send(k, percent, buckets), _MESSAGE).groupBy("bucket").applyInArrow(_meet, "key long, doc long, least long").distinct()
    shared = staged(of_class(of_class(shared, "doc"), "least").distinct(), "jaccard-shared")
    seen = full.join(shared.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    seen = staged(seen.select("doc_id", F.col("n_shingles").alias("n"), "sketch", "short"), "jaccard-sketches")

    def possible(pairs: DataFrame, name: str) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(seen.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
        return staged(pairs.mapInArrow(_may_link(percent), "a long, b long").distinct(), name)

    least = shared.where("doc <> least").groupBy("doc").agg(F.min("least").alias("least"))
    tested = staged(least.select(F.least("doc", "least").alias("a"), F.greatest("doc", "least").alias("b")).distinct(), "jaccard-stars")
    links = _linked(possible(tested, "jaccard-possible"), docs, k, percent, "jaccard-stars")

    groups = shared.select("key", "doc")  # in the last round only groups that had more than was tested
    for best in (True, False):
        label = components(links, "jaccard-labels")
        nodes = groups.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        mixed = nodes.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y")
        nodes = nodes.join(_dealt(mixed), "key").join(seen.drop("sketch").withColumnRenamed("doc_id", "doc"), "doc")
        bucket = F.pmod("deal", F.lit(4 * buckets)).alias("bucket")
        found = nodes.select(bucket, "key", "doc", "component", "n", "short").groupBy("bucket").applyInArrow(_across(percent, best), "a long, b long, more boolean")
        found = staged(found, "jaccard-found")
        pairs = found.where("not more").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "jaccard-pairs")
        links = links.union(_linked(possible(pairs, "jaccard-possible"), docs, k, percent, "jaccard-pairs"))
        tested = tested.union(pairs)
        groups = groups.join(found.where("more").select(F.col("a").alias("key")).distinct(), "key", "left_semi")

    links = links.union(copies.select(F.col("rep").alias("a"), F.col("doc").alias("b")))
    final = components(links, "jaccard-components")
    return (sizes.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
