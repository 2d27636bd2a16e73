"""Interpolated modified Kneser-Ney language model of order two.

Counting runs on Spark. Tasks count the bigrams of a few million tokens at a time and send them,
sorted and packed, to buckets of (context, part of the word); spreading a context over `SPREAD` parts
keeps one that a third of all tokens follow from filling a bucket. A bucket adds up its counts, writes
them as a sorted array of bigram hashes with counts to the model folder, and sends on what the lower
order needs: continuation counts of words, and how many kinds of followers occur once, twice or more
after each context. Buckets of words write a second kind of sorted array. The driver sees a row of
counts of counts per bucket, from which the discounts follow.

Scoring maps the arrays into memory in each worker, so a model larger than memory is paged in from
the shared folder as it is needed, and workers of a machine share the pages.

The model folder must be a mounted one that all workers see, since files are mapped into memory.
A file is written under another name first and then renamed, so repeated tasks do no harm.
Order two is deliberate: arrays and counts of the third order exceed four times the input on disk.
"""

from __future__ import annotations

import functools
import os
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches, fresh, partitions

U = np.uint64
FLUSH_TOKENS = 1_500_000
SPREAD = 8
END, START = (int(x) for x in W.mix(np.array([101, 102], U)) >> U(16))
_MESSAGE = "bucket int, a binary, b binary, c binary, d binary, e binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in "abcde")])
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


class Model(NamedTuple):
    folder: str
    buckets: int
    tokens: int
    types: int
    followers: int
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    floor: float
    files: dict[str, int]  # what was written, and how long it is: a bucket without n-grams has no file


def local_folder(uri: str) -> str:
    """The mounted path of a file: URI; the model cannot be mapped from another kind of store."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        raise ValueError(f"the model folder must be mounted on all workers (file:), not {uri}")
    return uri


def _write(path: str, arrays: list[np.ndarray]) -> int:
    """Writes the arrays under another name first; returns the length of the file."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.array([len(a) for a in arrays], "<i8").tobytes())
        for a in sorted(arrays, key=lambda a: -a.itemsize):
            f.write(a.tobytes())
        size = f.tell()
    os.replace(part, path)
    return size


@functools.lru_cache(maxsize=2048)
def _map(path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    size = data[:8 * len(kinds)].view("<i8")
    out, at = {}, 8 * len(kinds)
    for i in sorted(range(len(kinds)), key=lambda i: -np.dtype(kinds[i]).itemsize):
        stop = at + int(size[i]) * np.dtype(kinds[i]).itemsize
        out[i], at = data[at:stop].view(kinds[i]), stop
    return [out[i] for i in range(len(kinds))]


PAIRS = ("<u8", "u1", "<u8", "<u8")  # hash, count or 255, hashes of large counts, large counts
WORDS = ("<u8", "<i8", "<i8", "<i8", "<i8", "<i8")  # hash, count, continuations, followers seen once, twice, more


def _chain(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, tokens and number of tokens per text; each text ends with END and follows START."""
    w = W.words(column, W.LOWER)
    n = w.n + 1
    last = np.cumsum(n) - 1
    token = np.empty(int(n.sum()), U)
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner], token[last] = w.h >> U(16), END
    context = np.empty(len(token), U)
    context[1:] = token[:-1]
    context[last - n + 1] = START
    return context, token, n


def _pair(context, word):
    return W.mix(context * U(0xA0761D6478BD642F) + word)


def _pair_bucket(context, word, buckets: int):
    return (((W.mix(context * U(SPREAD) + word % U(SPREAD)) >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)


def _word_bucket(word, buckets: int):
    return ((word >> U(16)) * U(buckets) >> U(32)).astype(np.int32)


def _sum_runs(keys, *values):
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _count(buckets: int):
    def flush(contexts, tokens):
        context, word = np.concatenate(contexts), np.concatenate(tokens)
        order = np.lexsort((word, context, _pair_bucket(context, word, buckets)))
        context, word = context[order], word[order]
        first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
        count = np.diff(first, append=len(context))
        context, word = context[first], word[first]
        bucket = _pair_bucket(context, word, buckets)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        use = [i for i in range(buckets) if cut[i] < cut[i + 1]]
        part = lambda f, x: pa.array([f(x[cut[i]:cut[i + 1]]) for i in use], pa.binary())
        none = pa.nulls(len(use), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), part(W.pack, context), part(W.plain_pack, word), part(W.plain_pack, count), none, none], schema=_SCHEMA)

    def run(batches):
        contexts, tokens, have = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                context, token, _ = _chain(batch.slice(lo, 1024)["text"])
                contexts.append(context)
                tokens.append(token)
                have += len(token)
                if have >= FLUSH_TOKENS:
                    yield flush(contexts, tokens)
                    contexts, tokens, have = [], [], 0
        if have:
            yield flush(contexts, tokens)

    return run


def _four(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _add_pairs(folder: str, buckets: int):
    def reduce(rows: pa.Table) -> pa.Table:
        context = np.concatenate([W.unpack(x) for x in rows["a"].to_pylist()])
        word = np.concatenate([W.plain_unpack(x) for x in rows["b"].to_pylist()]).astype(U)
        count = np.concatenate([W.plain_unpack(x) for x in rows["c"].to_pylist()])
        key = _pair(context, word)
        order = np.argsort(key)
        key, context, word, count = key[order], context[order], word[order], count[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, context, word, count = key[first], context[first], word[first], np.add.reduceat(count, first)
        large = count >= 255
        bucket = rows["bucket"][0].as_py()
        size = _write(f"{folder}/pairs-{bucket}", [key, np.minimum(count, 255).astype(np.uint8), key[large], count[large].astype(U)])
        one = np.ones(len(count), np.int64)
        words, kinds, total = _sum_runs(word, one, count)
        contexts, once, twice, more = _sum_runs(context, (count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64))
        out = {f.name: [] for f in _SCHEMA}

        def send(bucket, *values):
            for name, value in zip(_SCHEMA.names, (bucket, *values, *[None] * (5 - len(values))), strict=True):
                out[name].append(value)

        for keys, values, mark in ((words, (kinds, total), b"w"), (contexts, (once, twice, more), b"c")):
            cut = np.searchsorted(_word_bucket(keys, buckets), np.arange(buckets + 1))
            for i in range(buckets):
                if cut[i] < cut[i + 1]:
                    s = slice(cut[i], cut[i + 1])
                    send(i, mark, W.pack(keys[s]), *(W.plain_pack(v[s]) for v in values))
        send(-1, np.array(_four(count), "<i8").tobytes(), np.array([bucket, size], "<i8").tobytes())
        return pa.table([pa.array(out[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)

    return reduce


def _add_words(folder: str):
    def written(level: int, stats: list[int], files: list[int]) -> pa.Table:
        lists = pa.list_(pa.int64())
        return pa.table({"level": pa.array([level], pa.int32()), "stats": pa.array([stats], lists), "files": pa.array([files], lists)})

    def reduce(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        if bucket < 0:
            stats = np.sum([np.frombuffer(x, "<i8") for x in rows["a"].to_pylist()], axis=0)
            return written(2, stats.tolist(), np.frombuffer(b"".join(rows["b"].to_pylist()), "<i8").tolist())
        rows = rows.to_pylist()
        empty = np.zeros(0, np.int64)
        words = [(W.unpack(r["b"]), W.plain_unpack(r["c"]), W.plain_unpack(r["d"])) for r in rows if r["a"] == b"w"]
        contexts = [(W.unpack(r["b"]), *(W.plain_unpack(r[x]) for x in "cde")) for r in rows if r["a"] == b"c"]
        both = [np.concatenate([x[0] for x in words] + [x[0] for x in contexts] + [empty.astype(U)])]
        seen = sum(len(x[0]) for x in words)
        for i in (1, 2):
            both.append(np.concatenate([*(x[i] for x in words), np.zeros(len(both[0]) - seen, np.int64)]))
        for i in (1, 2, 3):
            both.append(np.concatenate([np.zeros(seen, np.int64), *(x[i] for x in contexts)]))
        key, kinds, total, once, twice, more = _sum_runs(*both)
        size = _write(f"{folder}/words-{bucket}", [key, total, kinds, once, twice, more])
        stats = [*_four(kinds), int((kinds > 0).sum()), int(kinds.sum()), int(total.sum())]
        return written(1, stats, [bucket, size])

    return reduce


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; where a count of counts is missing, half a count."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = []
    for k, (x, z) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * z / x if x else 0.5
        out.append(min(max(d, 0.0), float(k)) or 0.5)
    return tuple(out)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts the model over all rows of docs and writes its arrays to a new shared folder. The model
    knows the length of each file; scoring with a file lost or cut short is an error."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    folder, buckets = local_folder(fresh(spark, "ngram")), partitions(spark)
    os.makedirs(folder, exist_ok=True)
    rows = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(buckets), _MESSAGE)
            .groupBy("bucket").applyInArrow(_add_pairs(folder, buckets), _MESSAGE)
            .groupBy("bucket").applyInArrow(_add_words(folder), "level int, stats array<long>, files array<long>").collect())
    names = {2: "pairs", 1: "words"}
    files = {f"{names[r['level']]}-{i}": size for r in rows for i, size in zip(r["files"][::2], r["files"][1::2], strict=True)}
    two = next((r["stats"] for r in rows if r["level"] == 2), [0] * 4)
    one = np.sum([r["stats"] for r in rows if r["level"] == 1] or [[0] * 7], axis=0).tolist()
    n1, n2, n3, n4, types, followers, tokens = one
    d1 = discounts(n1, n2, n3, n4)
    mass = d1[0] * n1 + d1[1] * n2 + d1[2] * (types - n1 - n2)
    floor = mass / followers / (types + 1) if followers else 1.0
    return Model(folder, buckets, tokens, types, followers, discounts(*two), d1, floor, files)


def _find(model: Model, name: str, kinds, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    if name not in model.files:
        return [np.zeros(0, k) for k in kinds], np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    path = f"{model.folder}/{name}"
    have = os.path.getsize(path) if os.path.exists(path) else None
    if have != model.files[name]:
        raise RuntimeError(f"{path} has {have} bytes instead of {model.files[name]}: the model folder must be shared by all workers and kept")
    arrays = _map(path, kinds)
    at = np.searchsorted(arrays[0], keys)
    at[at == len(arrays[0])] = 0
    return arrays, at, arrays[0][at] == keys if len(arrays[0]) else np.zeros(len(keys), bool)


def _lookup_words(model: Model, keys: np.ndarray) -> np.ndarray:
    """Rows of (count, continuations, once, twice, more) for sorted keys."""
    out = np.zeros((5, len(keys)), np.int64)
    cut = np.searchsorted(_word_bucket(keys, model.buckets), np.arange(model.buckets + 1))
    for i in range(model.buckets):
        s = slice(cut[i], cut[i + 1])
        if cut[i] < cut[i + 1]:
            arrays, at, hit = _find(model, f"words-{i}", WORDS, keys[s])
            for j in range(5):
                out[j, s][hit] = arrays[j + 1][at[hit]]
    return out


def _lookup_pairs(model: Model, context, word) -> np.ndarray:
    key, bucket = _pair(context, word), _pair_bucket(context, word, model.buckets)
    order = np.lexsort((key, bucket))
    sorted_key, out = key[order], np.zeros(len(key), np.int64)
    cut = np.searchsorted(bucket[order], np.arange(model.buckets + 1))
    for i in range(model.buckets):
        if cut[i] < cut[i + 1]:
            part = sorted_key[cut[i]:cut[i + 1]]
            arrays, at, hit = _find(model, f"pairs-{i}", PAIRS, part)
            count = np.zeros(len(part), np.int64)
            count[hit] = arrays[1][at[hit]]
            large = np.flatnonzero(count == 255)
            if len(large):
                count[large] = arrays[3][np.searchsorted(arrays[2], part[large])]
            out[order[cut[i]:cut[i + 1]]] = count
    return out


def _discount(d: tuple[float, float, float], count: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                context, token, n = _chain(part["text"])
                keys, each = np.unique(np.r_[token, np.array([START], U)], return_inverse=True)
                table = _lookup_words(model, keys)
                own, start = each[:-1], each[-1]
                count, kinds = table[0], table[1]
                first = np.cumsum(n) - n
                before = np.empty_like(own)
                before[1:] = own[:-1]
                before[first] = start
                followed = table[2] + table[3] + table[4]
                # what a context was followed by: its own tokens, or for START the training texts
                total = np.where(followed > 0, count, 0)
                total[start] = table[0][start] or model_texts(model)
                low = np.maximum(kinds - _discount(model.d1, kinds), 0.0) / max(model.followers, 1) + model.floor
                back = (table[2:] * np.array(model.d2)[:, None]).sum(0) / np.maximum(total, 1)
                c = _lookup_pairs(model, context, token)
                seen = total[before] > 0
                p = np.where(seen, np.maximum(c - _discount(model.d2, c), 0.0) / np.maximum(total[before], 1) + back[before] * low[own], low[own])
                base = np.log10((count[own] + 1) / (model.tokens + model.types + 1))
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array(n), pa.array(np.add.reduceat((count[own] > 0).astype(np.int64), first) if len(n) else n),
                    pa.array(np.add.reduceat(base, first) if len(n) else base), pa.array(np.add.reduceat(np.log10(p), first) if len(n) else base)],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def model_texts(model: Model) -> int:
    """Training texts: the number of END tokens."""
    return int(_lookup_words(model, np.array([END], U))[0, 0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_score(model), SCORES)


def perplexity_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all documents with a model of those for which `learn` holds.

    Tokens are words (runs without white space 0x09-0x0D, 0x20; A-Z in lower case) and one end.
    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (add-one unigram) and score, both log10 probabilities of the text, and perplexity. Null text:
    the end alone. A null `learn` counts as held out. With no training text every token has
    probability one. Repeated rows are counted and scored each. Empty table: empty result.
    """
    docs = docs.withColumn("_learn", F.coalesce(learn, F.lit(False)))
    model = fit(docs.where("_learn"), id_col, text_col)
    both = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), "_learn").alias("doc"), F.col(text_col).cast("string").alias("text"))
    out = both.mapInArrow(_score_struct(model), f"doc struct<id: long, _learn: boolean>, {SCORES.removeprefix('doc_id long, ')}")
    return out.select(
        F.col("doc.id").alias("doc_id"), (~F.col("doc._learn")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _score_struct(model: Model):
    inner = _score(model)

    def run(batches):
        for batch in inner(b.rename_columns(["doc_id", "text"]) for b in batches):
            yield batch.rename_columns(["doc", *batch.schema.names[1:]])

    return run
