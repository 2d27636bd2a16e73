"""Language ID by string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams (n = 1..3, inside
words padded with a space, letters in lower case) that both contain, divided by the root of the product
of their own counts. N-grams are hashed to `FEATURES` places. `landmarks` training texts per
language are the Nystroem landmarks Z; a text x has the features k(x, Z) K(Z, Z)^(-1/2), and
one-versus-rest kernel ridge regression is ridge regression on them. Its sums over all training texts
are added up by tasks; the driver solves a system of as many unknowns as there are landmarks.
A batch is scored by two matrix products: presence x landmarks, kernel values x weights.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches

FEATURES = 1 << 13
BATCH = 128
UNKNOWN = "und"


class Classifier(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # FEATURES x m, columns of length one
    weights: np.ndarray  # (m + 1) x languages, the last row is the bias


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters (lower-case code points, 32 for anything else) and the text of each."""
    low = [(t or "").lower() for t in texts.to_pylist()]
    n = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    ascii_letter = (points >= 97) & (points <= 122)
    other = points >= 128
    if other.any():
        kinds = np.unique(points[other])
        letter = np.array([chr(c).isalpha() for c in kinds])
        other[other] = letter[np.searchsorted(kinds, points[other])]
    points[~(ascii_letter | other)] = 32
    return points.astype(np.uint64), np.repeat(np.arange(len(low)), n)


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrix texts x FEATURES, and whether a text has a letter."""
    points, text = _points(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    letter = points != 32
    has = np.bincount(text[letter], minlength=len(texts)) > 0
    a, b, c = points[:-2], points[1:-1], points[2:]
    one = W.U(1)
    for key, at, good in (
        (points, text, letter),
        (points[:-1] * W.U(0x9E3779B97F4A7C15) + points[1:] + one, text[:-1], (letter[:-1] | letter[1:]) & (text[:-1] == text[1:])),
        ((a * W.U(0x9E3779B97F4A7C15) + b) * W.U(0xD6E8FEB86659FD93) + c, text[:-2], letter[1:-1] & (text[:-2] == text[2:])),
    ):
        place = (W.mix(key[good]) & W.U(FEATURES - 1)).astype(np.int64)
        out[at[good], place] = 1
    return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def _kernel(texts: pa.Array, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, has = presence(texts)
    k = _unit(x) @ z
    return np.concatenate([k, np.ones((len(k), 1), k.dtype)], axis=1), has


def _sums(languages: list[str], z: np.ndarray):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches):
        m = z.shape[1] + 1
        left, right = np.zeros((m, m)), np.zeros((m, len(languages)))
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                k, has = _kernel(part["text"], z)
                y = np.array([index.get(x, -1) for x in part["lang"].to_pylist()])
                k, y = k[has & (y >= 0)].astype(np.float64), y[has & (y >= 0)]
                left += k.T @ k
                np.add.at(right.T, y, k)
        yield pa.RecordBatch.from_pydict({"left": pa.array([left.tobytes()]), "right": pa.array([right.tobytes()])})

    return run


def _add(rows: pa.Table) -> pa.Table:
    add = lambda name: np.sum([np.frombuffer(x) for x in rows[name].to_pylist()], axis=0).tobytes()
    return pa.table({"left": pa.array([add("left")], pa.binary()), "right": pa.array([add("right")], pa.binary())})


def fit(docs: DataFrame, landmarks: int = 24, ridge: float = 1e-3, most_languages: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """Learns from all rows of docs with a language and a text.

    Landmarks are the `landmarks` texts of each language with the smallest hash among those of 200 to
    20,000 characters (of all, if a language has none), so at most landmarks * most_languages texts
    reach the driver; more than `most_languages` languages are refused.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    size = F.char_length("text")
    order = F.struct(F.when(size.between(200, 20_000), 0).otherwise(1).alias("far"), F.xxhash64("text").alias("hash"))
    # the least hash of each of 64 parts of a language: a bounded number of small rows
    best = docs.select("lang", order.alias("o")).groupBy("lang", F.pmod(F.col("o.hash"), F.lit(64)).alias("part")).agg(F.min("o").alias("o"))
    best = best.limit(64 * most_languages + 1).collect()
    by_lang: dict[str, list] = {}
    for r in best:
        by_lang.setdefault(r["lang"], []).append((r["o"]["far"], r["o"]["hash"]))
    if len(by_lang) > most_languages or len(best) > 64 * most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(by_lang)
    chosen = {x: sorted(by_lang[x])[:landmarks] for x in languages}
    hashes = [h for x in languages for _, h in chosen[x]]
    if not hashes:
        return Classifier([], np.zeros((FEATURES, 0), np.float32), np.zeros((1, 0), np.float32))
    texts = docs.where(F.xxhash64("text").isin(hashes)).groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    x = texts.mapInArrow(_landmarks, "h long, bits binary").collect()
    z = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in sorted(x, key=lambda r: r["h"])], np.float32)
    z = _unit(z).T
    sums = docs.select("text", "lang").mapInArrow(_sums(languages, z), "left binary, right binary")
    sums = sums.groupBy(F.pmod(F.spark_partition_id(), F.lit(32)).alias("g")).applyInArrow(_add, "left binary, right binary").collect()
    m, c = z.shape[1] + 1, len(languages)
    left = np.sum([np.frombuffer(r["left"]) for r in sums], axis=0).reshape(m, m)
    right = np.sum([np.frombuffer(r["right"]) for r in sums], axis=0).reshape(m, c)
    n = max(left[-1, -1], 1.0)
    # Nystroem kernel ridge regression: (K'K + ridge n K_zz) w = K'y; the bias is not penalised
    penalty = np.zeros((m, m))
    penalty[:-1, :-1] = z.T @ z
    weights = np.linalg.solve(left + ridge * n * penalty + 1e-8 * n * np.eye(m), right)
    return Classifier(languages, z, weights.astype(np.float32))


def _landmarks(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            part = batch.slice(lo, BATCH)
            x, _ = presence(part["text"])
            yield pa.RecordBatch.from_pydict({"h": part["h"], "bits": pa.array([r.tobytes() for r in np.packbits(x > 0, axis=1)], pa.binary())})


def _predict(model: Classifier):
    def run(batches):
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                k, has = _kernel(part["text"], model.landmarks)
                if not model.languages:
                    has = np.zeros(len(has), bool)
                    best, sure = np.zeros(len(has), np.int64), np.zeros(len(has))
                else:
                    value = k @ model.weights
                    best = value.argmax(1)
                    e = np.exp(4.0 * (value - value.max(1, keepdims=True)))
                    sure = e.max(1) / e.sum(1)
                best = np.where(has, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(names[best], pa.string()), pa.array(np.where(has, sure, 0.0).astype(np.float64))], names=["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Classifier, keep: Column, text_col: str = "text") -> DataFrame:
    """id (the struct `keep`), lang_pred and score (0 to 1) of every row's whole text."""
    kept = docs.select(keep.alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_predict(model), f"id {kept.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, learn: Column, landmarks: int = 24, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicts the language of every document with a classifier of those for which `learn` holds.

    Returns doc_id, held_out (learn does not hold, or is null), lang_pred and score. `und` and score 0
    if the text is null or has no letter, or if nothing can be learned. A language seen in one text
    still gets its landmark. Repeated rows and null ids are predicted like others. Empty table: empty
    result. Language, source and id are not read by a prediction.
    """
    docs = docs.withColumn("_learn", F.coalesce(learn, F.lit(False)))
    model = fit(docs.where("_learn"), landmarks, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = predict(docs, model, F.struct(F.col(id_col).cast("long").alias("doc_id"), "_learn"), text_col)
    return out.select("id.doc_id", (~F.col("id._learn")).alias("held_out"), "lang_pred", "score")
