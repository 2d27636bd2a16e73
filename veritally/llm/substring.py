"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of `block` words, the reference blocks; every
rolling run of `block` words of every document probes them. A window of 2 * block - 1 or more words
that occurs in two documents holds one whole block of each of them, so no repeat is missed. Hits are
then extended word by word: the windows around them are compared as windows, and touching ones are
merged to maximal exact repeats.

How it runs. Documents are dealt to groups by a hash of their id; one task sees a group at a time.
Groups send sorted, packed fingerprints of their runs to buckets of the fingerprint space; a run
that a group holds a thousand times is sent once, so a passage in a third of all documents costs a
bucket one entry per group. Buckets answer each group with the runs that are a block somewhere and
occur in two documents. The second exchange does the same with the windows around these hits, whole
64-bit hashes this time, and answers with the smallest id that has the window. All of it is a
function of the ids, so a lost executor's part is computed again alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches, exchange_sizes

U = np.uint64
FINGERPRINT_BITS = 48
OUT = "n_words long, n_removed long, kept string, cut string, spans array<struct<start: long, stop: long>>"


def _send(h: np.ndarray, bits: int, buckets: int):
    """Bounds of each bucket's slice in the sorted array h of `bits`-bit numbers."""
    width = -(-(1 << bits) // buckets)
    edges = np.array([min(i * width, (1 << bits) - 1) for i in range(1, buckets)], U)
    return np.r_[0, np.searchsorted(h, edges), len(h)].astype(np.int64)


def _distinct(h: np.ndarray, doc: np.ndarray, aligned: np.ndarray | None = None):
    """Sorted distinct h; whether two texts have it; whether any place is aligned."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return h, np.zeros(0, bool), np.zeros(0, bool)
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    return h[first], many, (np.logical_or.reduceat(aligned[order], first) if aligned is not None else None)


def _rows(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_MESSAGE = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_ANSWER = pa.schema([("grp", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _blocks(block: int, buckets: int):
    def send(group: pa.Table) -> pa.Table:
        W.release()
        w = W.words(group["text"])
        h, at = W.grams(w, block)
        text = w.text_of()[at]
        aligned = (at - w.first()[text]) % block == 0
        h, many, aligned = _distinct(h >> U(64 - FINGERPRINT_BITS), text, aligned)
        cut = _send(h, FINGERPRINT_BITS, buckets)
        out = {f.name: [] for f in _MESSAGE}
        grp = group["grp"][0].as_py()
        for i in range(buckets):
            s = slice(cut[i], cut[i + 1])
            if cut[i] == cut[i + 1]:
                continue
            hs, m, al = h[s], many[s], aligned[s]
            for name, keep in (("a", ~m & ~al), ("b", ~m & al), ("c", m & ~al), ("d", m & al)):
                out[name].append(W.pack(hs[keep]))
            out["bucket"].append(i)
            out["grp"].append(grp)
        return _rows(out, _MESSAGE)

    return send


def _answer_blocks(bucket: pa.Table) -> pa.Table:
    W.release()
    grps = bucket["grp"].to_numpy()
    h, who, flag = [], [], []
    for bit, name in enumerate("abcd"):
        for i, data in enumerate(bucket[name].to_pylist()):
            v = W.unpack(data)
            h.append(v)
            who.append(np.full(len(v), i, np.int32))
            flag.append(np.full(len(v), bit, np.uint8))
    h, who, flag = np.concatenate(h), np.concatenate(who), np.concatenate(flag)
    order = np.argsort(h)
    h, who, flag = h[order], who[order], flag[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.diff(first, append=len(h))
    flags = np.bitwise_or.reduceat(flag, first)
    hot = np.repeat((flags & 1 > 0) & ((count > 1) | (flags & 2 > 0)), count)
    h, who = h[hot], who[hot]
    order = np.argsort(who, kind="stable")
    h, who = h[order], who[order]
    out = {"grp": [], "a": [], "b": []}
    cut = np.searchsorted(who, np.arange(len(grps) + 1))
    for i, g in enumerate(grps):
        if cut[i] < cut[i + 1]:
            out["grp"].append(int(g))
            out["a"].append(W.pack(h[cut[i]:cut[i + 1]]))
            out["b"].append(None)
    return _rows(out, _ANSWER)


def _least(h, ids):
    """Sorted distinct windows and the smallest id of each."""
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first], np.minimum.reduceat(ids, first) if len(first) else ids[:0]


def _windows(block: int, window: int, buckets: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {f.name: [] for f in _MESSAGE}
        if not docs.num_rows or not answers.num_rows:
            return _rows(out, _MESSAGE)
        W.release()
        hot = np.sort(np.concatenate([W.unpack(x) for x in answers["a"].to_pylist()]))
        w = W.words(docs["text"])
        h, at = W.grams(w, block)
        hit = np.zeros(len(w.h) + 1, np.int64)
        hit[at[W.member(h >> U(64 - FINGERPRINT_BITS), hot)] + 1] = 1
        hit = np.cumsum(hit)
        h, at = W.grams(w, window)
        near = hit[at + window - block + 1] > hit[at]  # a hit run lies inside the window
        h, least = _least(h[near], W.ids_of(docs["doc_id"])[w.text_of()[at[near]]])
        cut = _send(h >> U(1), 63, buckets)
        grp = docs["grp"][0].as_py()
        for i in range(buckets):
            if cut[i] < cut[i + 1]:
                s = slice(cut[i], cut[i + 1])
                for name, value in (("bucket", i), ("grp", grp), ("a", W.pack(h[s])), ("b", W.plain_pack(least[s])), ("c", None), ("d", None)):
                    out[name].append(value)
        return _rows(out, _MESSAGE)

    return send


def _answer_windows(bucket: pa.Table) -> pa.Table:
    grps = bucket["grp"].to_numpy()
    hs, ids = [W.unpack(x) for x in bucket["a"].to_pylist()], [W.plain_unpack(x) for x in bucket["b"].to_pylist()]
    everyone, least = _least(np.concatenate(hs), np.concatenate(ids))
    out = {"grp": [], "a": [], "b": []}
    for g, h, own in zip(grps, hs, ids, strict=True):
        best = least[np.searchsorted(everyone, h)]
        other = best < own
        if other.any():
            for name, value in (("grp", int(g)), ("a", W.pack(h[other])), ("b", W.plain_pack(best[other]))):
                out[name].append(value)
    return _rows(out, _ANSWER)


def _remove(window: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:  # answers go to groups that have documents, so this is an empty table
            return pa.table({"carried": docs["carried"], **{k: pa.array([], t) for k, t in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("cut", pa.string()), ("spans", spans_type))}})
        W.release()
        ids = W.ids_of(docs["doc_id"])
        w = W.words(docs["text"], spans=True)
        h, at = W.grams(w, window)
        doc = ids[w.text_of()[at]]
        here, least = _least(h, doc)
        if answers.num_rows:
            far = np.concatenate([W.unpack(x) for x in answers["a"].to_pylist()])
            best = np.concatenate([W.plain_unpack(x) for x in answers["b"].to_pylist()])
            place = np.searchsorted(here, far)
            least[place] = np.minimum(least[place], best)
        repeated = at[least[np.searchsorted(here, h)] < doc]
        step = np.zeros(len(w.h) + 1, np.int64)
        np.add.at(step, repeated, 1)
        np.add.at(step, repeated + window, -1)
        gone = np.cumsum(step)[:-1] > 0
        first = w.first()
        lost = np.add.reduceat(np.r_[gone, False].astype(np.int64), first) * (w.n > 0) if len(first) else w.n
        kept, cut, spans = [], [], []
        for i, text in enumerate(docs["text"].to_pylist()):
            if not lost[i]:
                kept.append(b" ".join((text or "").encode().split()).decode())
                cut.append(text)
                spans.append([])
                continue
            raw, s = text.encode(), slice(first[i], first[i] + w.n[i])
            g = gone[s]
            kept.append(b" ".join(x for x, y in zip(raw.split(), g, strict=True) if not y).decode())
            turn = np.flatnonzero(np.diff(np.r_[False, g, False]))
            spans.append([{"start": int(a), "stop": int(b)} for a, b in turn.reshape(-1, 2)])
            turn = np.flatnonzero(np.diff(np.r_[False, ~g, False])).reshape(-1, 2)
            cut.append(b" ".join(raw[w.start[s][a]:w.end[s][b - 1]] for a, b in turn).decode())
        return pa.table({"carried": docs["carried"], "n_words": w.n, "n_removed": lost, "kept": pa.array(kept, pa.string()), "cut": pa.array(cut, pa.string()), "spans": pa.array(spans, spans_type)})

    return remove


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Marks every word that a repeated window covers.

    A window is `window` consecutive words (runs without white space 0x09-0x0D, 0x20) of one
    document; it is repeated if its words also start somewhere in a document with a smaller id.
    Returns doc_id, n_words, n_removed, kept (the words left, joined by one space), cut (the text
    without the removed ranges, kept ranges as they were) and spans (maximal removed word ranges).
    Null text: no words, kept empty, cut null. Null id: counts as larger than any id and comes back
    null. Rows with one id repeat nothing of each other. Empty table: empty result. Columns of `carry`
    come back as the struct `carried`; others are not read.
    """
    block = (window + 1) // 2
    groups, buckets = exchange_sizes(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    carried = F.struct(F.col(id_col).cast("long").alias("_id"), *carry).alias("carried")
    dealt = docs.select(
        carried,
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(17)), F.lit(groups)).cast("int").alias("grp"))
    message, answer = "bucket int, grp int, a binary, b binary, c binary, d binary", "grp int, a binary, b binary"
    by_group = dealt.groupBy("grp")
    hits = by_group.applyInArrow(_blocks(block, buckets), message).groupBy("bucket").applyInArrow(_answer_blocks, answer)
    repeats = (by_group.cogroup(hits.groupBy("grp")).applyInArrow(_windows(block, window, buckets), message)
               .groupBy("bucket").applyInArrow(_answer_windows, answer))
    out = by_group.cogroup(repeats.groupBy("grp")).applyInArrow(_remove(window), f"carried {dealt.schema['carried'].dataType.simpleString()}, {OUT}")
    return out.withColumn("doc_id", F.col("carried._id"))
