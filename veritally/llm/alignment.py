"""Alignment of the tokens of two tokenizers over whole texts, by windows between verified anchors.

Both tokenizers read a whole text; the byte ends of their tokens are running sums of token lengths. An
anchor is a byte place where tokens of both end and both next tokens begin with a space. Anchors cut a
text into windows of token ids. What a window holds - its groups, its links, its digest text - depends
on its ids alone, so it is worked out once per pair of id tuples and worker and kept in a table, which is
emptied when it has `MOST_WINDOWS` windows. Results of a text are the sums and the
joined texts of its windows.

Counts of linked id pairs over all documents are added up per task before they are shuffled. The most
frequent pairs, `head` at most, go to all workers; the rest, each of which is in few documents, is joined
by key. The highest count of each A id is a table as long as the vocabulary.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches, staged

#: Fixed: the pre-tokenizer of byte-level BPE vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MOST_WINDOWS = 400_000
SLICE = 1 << 21  # bytes of text per step
HEAD = 1 << 20
FLUSH = 1 << 20  # pairs counted in a task before they are sent on
_A = 32  # a pair of ids is one long: A id << 32 | B id


def byte_values() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of whole texts, and the bytes of each id."""

    def __init__(self, path: str):
        model = json.load(open(path))
        values, vocab = byte_values(), model["model"]["vocab"]
        special = {t["id"] for t in model.get("added_tokens", [])}
        ranks = {bytes(values[c] for c in piece): i for piece, i in vocab.items() if i not in special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(order) or model.get("normalizer") or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is no byte-level BPE with ids in the order of its merges")
        import tiktoken

        self.model = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(t) for t in texts]


class Pieces:
    """Tokenizer B: ids of whole texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Vocabulary:
    """The bytes of all ids in one array."""

    def __init__(self, tokenizer):
        self.encode = tokenizer.encode
        self.length = np.array([len(b) for b in tokenizer.bytes], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokenizer.bytes), np.uint8)
        self.space = np.array([b[:1] == b" " for b in tokenizer.bytes])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[_ranges(self.at[ids], self.length[ids])]


def _ranges(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... length[0] places, then those of at[1], ..."""
    stop = np.cumsum(length)
    return np.repeat(at - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)


def align_windows(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> tuple:
    """Of windows in a row, with n_a and n_b ids each: their groups as texts and their number, and the
    linked pairs and their number. Both sides of a window have the same bytes, so places on one line of
    all windows' bytes do for all of them.
    """
    ends_a, ends_b = np.cumsum(a_length[a]), np.cumsum(b_length[b])
    shared = np.intersect1d(ends_a, ends_b)
    of_window = np.searchsorted(ends_a[np.cumsum(n_a) - 1], shared, "left")
    # links: the B tokens whose bytes meet those of each A token
    first = np.searchsorted(ends_b, ends_a - a_length[a], "right")
    each = np.searchsorted(ends_b - b_length[b], ends_a, "left") - first
    pairs = np.repeat(a, each) << _A | b[_ranges(first, each)]
    n_links = np.add.reduceat(each, np.cumsum(n_a) - n_a)
    # texts: ids of both sides in the order of their groups, A before B, each with the sign behind it
    group_a, group_b = np.searchsorted(shared, ends_a, "left"), np.searchsorted(shared, ends_b, "left")
    until_a, until_b = (np.cumsum(np.bincount(g, minlength=len(shared))) for g in (group_a, group_b))
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.r_[0, until_b][group_a]] = a
    ids[np.arange(len(b)) + until_a[group_b]] = b
    sign[until_a + np.r_[0, until_b[:-1]] - 1], sign[until_a + until_b - 1] = ord("|"), ord(";")
    pool, at, length = _decimals(max(len(a_length), len(b_length)))
    text, stop = pool[_ranges(at[ids], length[ids])], np.cumsum(length[ids])
    text[stop - 1] = sign
    line, cut = text.tobytes().decode("ascii"), [0, *stop[np.cumsum(n_a + n_b) - 1].tolist()]
    texts = [line[lo:hi - 1] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    return texts, np.bincount(of_window, minlength=len(n_a)), n_links, pairs


@functools.lru_cache(maxsize=2)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers below n as text with one place behind each, in one array."""
    length = np.array([len(str(i)) + 1 for i in range(n)], np.int64)
    return np.frombuffer("".join(f"{i}," for i in range(n)).encode(), np.uint8), np.cumsum(length) - length, length


class Aligner:
    """Windows seen so far, by the ids of both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Vocabulary(ByteLevel(a_path)), Vocabulary(Pieces(b_path))
        self._empty()

    def _empty(self):
        self.slot: dict = {}
        self.text, self.n_groups, self.n_links = [], np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.at, self.pairs, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        texts, n_groups, n_links, pairs = align_windows(a, n_a, b, n_b, self.a.length, self.b.length)
        self.text += texts
        at = self.used + np.cumsum(n_links) - n_links
        self.n_groups, self.n_links, self.at = (_put(x, len(self.text) - len(texts), y) for x, y in ((self.n_groups, n_groups), (self.n_links, n_links), (self.at, at)))
        self.pairs = _put(self.pairs, self.used, pairs)
        self.used += len(pairs)

    def texts(self, texts: list[str]) -> tuple:
        """Per text: n_a, n_b, n_groups, n_links, digest, and its distinct pairs with their number of links."""
        ids_a, ids_b = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        n_a, n_b = (np.array([len(x) if t else 0 for x, t in zip(ids, texts, strict=True)], np.int64) for ids in (ids_a, ids_b))
        # whole texts that both tokenizers give back are kept
        size = np.array([len(t.encode()) + 1 for t in texts], np.int64)
        whole = np.array([bool(t) for t in texts])
        flat = []
        for v, ids, n in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):
            ids = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x, k in zip(ids, n, strict=True) if k]])
            total = np.bincount(np.repeat(np.arange(len(texts)), n), v.length[ids], len(texts)).astype(np.int64)
            whole &= total == size
            flat.append(ids)
        for v, ids, n in ((self.a, flat[0], n_a), (self.b, flat[1], n_b)):
            keep = np.repeat(whole, n)
            want = np.frombuffer("".join(" " + t for t, w in zip(texts, whole, strict=True) if w).encode(), np.uint8)
            wrong = np.flatnonzero(v.joined(ids[keep]) != want)
            if len(wrong):
                stop = np.cumsum(np.where(whole, size, 0))
                whole[np.unique(np.searchsorted(stop, wrong, "right"))] = False
        flat = [ids[np.repeat(whole, n)] for ids, n in zip(flat, (n_a, n_b), strict=True)]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        # anchors: a shared end, and a space at the start of both next tokens or the end of the text
        ends = [np.cumsum(v.length[ids]) for v, ids in zip((self.a, self.b), flat, strict=True)]
        last = np.cumsum(np.where(whole, size, 0))
        cut = []
        for v, ids, end in zip((self.a, self.b), flat, ends, strict=True):
            starts = np.r_[v.space[ids[1:]], True] if len(ids) else np.zeros(0, bool)
            stops = starts & np.r_[end[1:] != end[:-1], True] if len(ids) else starts
            at = np.flatnonzero(stops)
            cut.append((end[at], at))
        shared, in_a, in_b = np.intersect1d(cut[0][0], cut[1][0], assume_unique=True, return_indices=True)
        hi_a, hi_b = cut[0][1][in_a] + 1, cut[1][1][in_b] + 1
        doc = np.searchsorted(last, shared, "left")
        # every text ends at an anchor, as it begins with a space: no window crosses two texts
        slots = self._slots(*flat, np.r_[0, hi_a].astype(np.int64)[:-1], hi_a, np.r_[0, hi_b].astype(np.int64)[:-1], hi_b)
        count = len(texts)
        n_groups = np.bincount(doc, self.n_groups[slots], count).astype(np.int64)
        links = self.n_links[slots]
        n_links = np.bincount(doc, links, count).astype(np.int64)
        edge = np.searchsorted(doc, np.arange(count + 1))
        order, text = slots.tolist(), self.text
        digest = [hashlib.sha256(";".join([text[s] for s in order[lo:hi]]).encode()).hexdigest() if hi > lo else "" for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        pairs, of = self.pairs[_ranges(self.at[slots], links)], np.repeat(doc, links)
        by = np.lexsort((pairs, of))
        pairs, of = pairs[by], of[by]
        first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])]) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(pairs)])
        return n_a, n_b, n_groups, n_links, digest, pairs[first], times, np.bincount(of[first], minlength=count)

    def _slots(self, a, b, lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        """The table's entry of each window. Equal windows of the batch are looked up once: they are found
        by a hash of their ids, and then compared id by id."""
        if not len(lo_a):
            return np.zeros(0, np.int64)
        if len(self.text) > MOST_WINDOWS:
            self._empty()
        hashed = W.mix(_rolled(a, lo_a, hi_a, 1) ^ W.mix(_rolled(b, lo_b, hi_b, 2)))
        _, first, each = np.unique(hashed, return_index=True, return_inverse=True)
        n_a, n_b, like = hi_a - lo_a, hi_b - lo_b, first[each]
        if not (np.array_equal(n_a, n_a[like]) and np.array_equal(n_b, n_b[like]) and np.array_equal(a, a[_ranges(lo_a[like], n_a)]) and np.array_equal(b, b[_ranges(lo_b[like], n_b)])):
            first = each = np.arange(len(lo_a))  # two windows with one hash: look up every one
        ba, bb, slot, out, new = a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), self.slot, [], []
        known = len(slot)
        for w, p, q, r, s in zip(first.tolist(), (4 * lo_a[first]).tolist(), (4 * hi_a[first]).tolist(), (4 * lo_b[first]).tolist(), (4 * hi_b[first]).tolist(), strict=True):
            key = ba[p:q] + _BETWEEN + bb[r:s]
            k = slot.setdefault(key, known)
            if k == known:
                known += 1
                new.append(w)
            out.append(k)
        if new:
            self._learn(a[_ranges(lo_a[new], n_a[new])], n_a[new], b[_ranges(lo_b[new], n_b[new])], n_b[new])
        return np.array(out, np.int64)[each]


def _put(x: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """x with values from `at` on, grown by doubling."""
    if at + len(values) > len(x):
        x = np.concatenate([x[:at], np.zeros(max(at, len(values)), x.dtype)])
    x[at:at + len(values)] = values
    return x


_BETWEEN = b"\xff" * 4  # no id


def _rolled(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: int) -> np.ndarray:
    """A hash of each window ids[lo:hi]; windows are not empty and follow each other."""
    place = np.arange(len(ids)) - np.repeat(lo, hi - lo)
    return np.add.reduceat(W.mix(ids.astype(np.uint64) << np.uint64(34) | place.astype(np.uint64) << np.uint64(2) | np.uint64(side)), lo)


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_path, b_path)


_ROWS = "place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's place in the scan, id, token, group and link counts, digest, and its distinct linked id pairs."""
    names = [f.split()[0] for f in _ROWS.split(", ")]

    def align(batches):
        work = aligner(a_path, b_path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(2).to_pylist()]
            size, lo = np.cumsum([len(t) for t in texts]), 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, "right")))
                n_a, n_b, n_groups, n_links, digest, pairs, times, each = work.texts(texts[lo:hi])
                at = pa.array(np.r_[0, np.cumsum(each)], pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (pairs >> _A, pairs & 0xFFFFFFFF, times)]
                rows = [batch.column(0)[lo:hi], batch.column(1)[lo:hi], *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(digest, pa.string()), *lists]
                yield pa.record_batch(rows, names)
                lo = hi

    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(align, _ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id) and the number of rows that hold it, added up in the tasks first."""

    def count(batches):
        held: list[np.ndarray] = []
        n = 0

        def merged():
            keys = np.concatenate([k for k, _ in held])
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(np.concatenate([c for _, c in held])[by], first)

        for b in batches:
            a, c = (b.column(i).flatten().to_numpy().astype(np.int64) for i in (0, 1))
            if not len(a):
                continue
            held.append(np.unique(a << _A | c, return_counts=True))
            n += len(held[-1][0])
            if n > FLUSH:
                held = [merged()]
                n = len(held[0][0])
                if n > FLUSH // 2:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in held[0]], ["pair", "n"])
                    held, n = [], 0
        if held:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in merged()], ["pair", "n"])

    return rows.select("a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _looked_up(spark, rows: DataFrame, counts: DataFrame, head: int) -> DataFrame:
    """place, count_sum and n_best of each row."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).agg(F.count("*").alias("n")).collect()
    least, total, pairs = 64, 0, {r["bits"]: r["n"] for r in sizes}
    for bits in sorted(pairs, reverse=True):
        if total + pairs[bits] > head:
            break
        least, total = bits, total + pairs[bits]
    top = counts.where(F.col("n") >= F.lit(float(2 ** least))).toArrow()  # `head` pairs at most
    keys, n = (top.column(i).to_numpy() for i in (0, 1))
    by = np.argsort(keys)
    best = counts.groupBy(F.shiftright("pair", _A).alias("a")).agg(F.max("n").alias("n")).toArrow()  # as long as the vocabulary
    most = np.zeros(max(best.column(0).to_pylist(), default=0) + 1, np.int64)
    most[best.column(0).to_numpy()] = best.column(1).to_numpy()
    shared = spark.sparkContext.broadcast((keys[by], n[by], most))

    def flat(b):
        each = np.diff(b.column(1).offsets.to_numpy())
        a, c, t = (b.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 2, 3))
        keys, n, most = shared.value
        pair = a << _A | c
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        return np.repeat(np.arange(b.num_rows), each), pair, t, known, np.where(known, n[at] if len(keys) else 0, 0), most[a]

    def add(batches):
        for b in batches:
            of, _, t, known, n, most = flat(b)
            sums = [np.bincount(of, x, b.num_rows).astype(np.int64) for x in (n * t, t * (known & (n == most)))]
            yield pa.record_batch([b.column(0), *map(pa.array, sums)], ["place", "count_sum", "n_best"])

    def rest(batches):
        for b in batches:
            of, pair, t, known, _, most = flat(b)
            out = [b.column(0).to_numpy()[of], pair, t, most]
            yield pa.record_batch([pa.array(x[~known], pa.int64()) for x in out], ["place", "pair", "times", "most"])

    source = rows.select("place", "a", "b", "times")
    found = source.mapInArrow(add, "place long, count_sum long, n_best long")
    if total == sum(pairs.values()):
        return found
    seldom = source.mapInArrow(rest, "place long, pair long, times long, most long").join(counts.withColumnRenamed("n", "c"), "pair")
    seldom = seldom.select("place", (F.col("c") * F.col("times")).alias("count_sum"), F.when(F.col("c") == F.col("most"), F.col("times")).otherwise(0).alias("n_best"))
    return found.unionByName(seldom).groupBy("place").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and its pairs a, b, times.

    Groups, links and counts are as the module says; a text that is null or empty, or that one of the
    tokenizers does not give back byte by byte, has no tokens: zeros, an empty digest and no pairs. Each
    row is a document of its own, whatever its id; null ids stay. Empty table: empty result. Extra
    columns are not read. The result does not depend on `head`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = staged(aligned(docs, a_path, b_path, id_col, text_col), "alignment-rows")
    counts = staged(pair_counts(rows), "alignment-counts")
    sums = _looked_up(spark, rows, counts, head)
    return rows.join(sums, "place").drop("place")
