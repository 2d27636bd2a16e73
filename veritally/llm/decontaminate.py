"""Benchmark decontamination: seeds that no edit can hide, then Smith-Waterman alignment.

The test items are a stated query set. They are taken in blocks of at most `BLOCK_GRAMS` words, so what a
task receives is bounded, and each block is run against all documents. The score is the alignment
score over that of the item with itself, so words left out, added or replaced lower it without hiding
the copy.

Seeds are single words and lose nothing: an alignment that reaches the threshold matches at least
`need` of the n words of an item, so of any n - need + t places of the item it matches at least t. The rarest
ones are taken, by a first pass that counts the block's words; the count only decides what is cheap, any
choice is complete. Such an alignment covers at most `span` words of the document. A second pass looks
for t seeds within a span, then for `need` words of the item within a span, and aligns item and
passage word by word. The result is that of aligning every item with every whole document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches

U = np.uint64
BLOCK_GRAMS = 500_000
SEED_HITS = 4  # seeds asked for within a span
MOST_HITS = 2_000_000  # in memory at a time, for texts of usual length
MATCH, MISMATCH, GAP = 2, -1, -1
OUT = "doc_id long, item_id long, score double, first_word long, last_word long"


class Items(NamedTuple):
    ids: np.ndarray
    h: np.ndarray  # word hashes of all items in a row
    n: np.ndarray
    need: np.ndarray  # words an alignment has to match
    span: np.ndarray  # words of a document that it covers at most
    word: np.ndarray  # sorted distinct word hashes
    pair: np.ndarray  # sorted item * len(word) + place in word

    def first(self):
        return np.cumsum(self.n) - self.n

    def item_of(self):
        return np.repeat(np.arange(len(self.n)), self.n)


class Seeds(NamedTuple):
    word: np.ndarray  # sorted place in Items.word, with its item
    item: np.ndarray
    hits: np.ndarray  # per item: seeds asked for


def _items(rows: list, threshold: float, min_words: int) -> Items:
    w = W.words(pa.array([r["text"] for r in rows], pa.string()), W.ALNUM)
    need = np.maximum(np.ceil(threshold * w.n - 1e-9).astype(np.int64), np.minimum(min_words, w.n))
    need = np.maximum(need, 1)
    # m matched words and c charged ones score at most 2 m - c, and cover at most m + c words
    span = np.maximum(3 * w.n - np.ceil(MATCH * threshold * w.n - 1e-9).astype(np.int64), w.n)
    word, place = np.unique(w.h, return_inverse=True)
    return Items(np.array([r["item_id"] for r in rows], np.int64), w.h, w.n, need, span, word, np.unique(w.text_of() * len(word) + place))


def _frequencies(word: np.ndarray):
    def run(batches):
        total = np.zeros(len(word), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                at = _places(W.words(batch.slice(lo, 1024)["text"], W.ALNUM).h, word)
                total += np.bincount(at[at >= 0], minlength=len(word))
        use = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"g": pa.array(use), "n": pa.array(total[use])})

    return run


def _places(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places of words in the sorted array `word`, -1 for words that it does not have."""
    at = np.searchsorted(word, h)
    at[at == len(word)] = 0
    at[word[at] != h if len(word) else slice(None)] = -1
    return at


def rare_seeds(items: Items, frequency: np.ndarray) -> Seeds:
    """The rarest n - need + t places of every item: whoever matches `need` places matches t of these."""
    hits = np.minimum(SEED_HITS, items.need)
    item, place = items.item_of(), np.searchsorted(items.word, items.h)
    order = np.lexsort((place, frequency[place], item))
    rank = np.arange(len(order)) - items.first()[item]
    possible = items.need <= items.n
    keep = (rank < (items.n - items.need + hits)[item]) & possible[item]
    pair = np.unique(place[order[keep]] * len(items.n) + item[keep])
    return Seeds(pair // max(len(items.n), 1), pair % max(len(items.n), 1), hits)


def smith_waterman(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of x (nx words) with that of y: score, and the first and last
    aligned place in y. One step of the recurrence treats a whole row of all tables at once."""
    rows, wide = y.shape
    place = np.arange(wide)
    best, start, stop = np.zeros(rows, np.int32), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    h, s = np.zeros((rows, wide + 1), np.int32), np.zeros((rows, wide + 1), np.int32)
    inside = place < ny[:, None]
    for i in range(x.shape[1]):
        same = (x[:, i:i + 1] == y) & inside & (i < nx)[:, None]
        diagonal = h[:, :-1] + np.where(same, MATCH, MISMATCH)
        fresh = h[:, :-1] == 0
        begin = np.where(fresh, place, s[:, :-1])
        up = h[:, 1:] + GAP
        t = np.maximum(diagonal, up)
        begin = np.where(diagonal >= up, begin, s[:, 1:])
        t = np.maximum(t, 0)
        # a gap in the row costs one per place: a running maximum of t + place does all of them
        run = np.maximum.accumulate(t - GAP * place, axis=1)
        source = np.maximum.accumulate(np.where(run == t - GAP * place, place, 0), axis=1)
        h[:, 1:] = np.maximum(run + GAP * place, 0)
        s[:, 1:] = np.take_along_axis(begin, source, axis=1)
        live = np.where(inside & (i < nx)[:, None], h[:, 1:], 0)
        top = live.argmax(1)
        value = live[np.arange(rows), top]
        better = value > best
        best[better], stop[better] = value[better], top[better]
        start[better] = s[better, top[better] + 1]
    return best, start, stop


def best_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Score of the best local alignment of each row of x with that of y, as of smith_waterman.

    Rows are filled up with numbers that meet nothing. A step treats one falling diagonal of all
    tables, whose places do not depend on each other; places are rows of memory, tables its columns.
    """
    tall, wide = x.shape[1], y.shape[1]
    kind = np.int16 if MATCH * min(tall, wide) < 1 << 14 else np.int32
    down = np.ascontiguousarray(x.T)
    across = np.full((wide + 2 * tall - 2, len(x)), -2, y.dtype)  # from the last place to the first
    across[tall - 1:tall - 1 + wide] = y.T[::-1]
    older, old, new, most = (np.zeros((tall + 1, len(x)), kind) for _ in range(4))
    value, same = np.empty((tall, len(x)), kind), np.empty((tall, len(x)), bool)
    for d in range(wide + tall - 1):
        begin = wide + tall - 2 - d
        np.equal(down, across[begin:begin + tall], out=same)
        np.multiply(same, kind(MATCH - MISMATCH), out=value, dtype=kind)
        value += kind(MISMATCH)
        value += older[:-1]
        np.maximum(old[:-1], old[1:], out=new[1:])
        new[1:] += kind(GAP)
        np.maximum(new[1:], value, out=new[1:])
        np.maximum(new[1:], 0, out=new[1:])
        np.maximum(most, new, out=most)
        older, old, new = old, new, older
    return most.max(0)


def _align(items: Items, seeds: Seeds, threshold: float, min_words: int):
    def run(batches):
        each = np.bincount(seeds.word, minlength=len(items.word))
        base = np.cumsum(each) - each
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                w = W.words(part["text"], W.ALNUM)
                word = _places(w.h, items.word)
                at = np.flatnonzero(word >= 0)
                at = at[each[word[at]] > 0]
                if not len(at):
                    continue
                # whole texts at a time, until their hits are many
                total = np.bincount(w.text_of()[at], each[word[at]], len(w.n)).cumsum().astype(np.int64)
                cut = np.flatnonzero(np.diff(total // MOST_HITS)) + 1
                for places in np.split(at, np.searchsorted(at, w.first()[cut])):
                    found = _passages(w, word, places, items, seeds, each, base)
                    if len(found[0]):
                        yield from _scored(part["doc_id"], w, word, items, *found, threshold, min_words)

    return run


def _passages(w, word, at, items, seeds, each, base):
    """text, item, begin and end of all stretches that can hold an alignment reaching the threshold."""
    size = each[word[at]]
    seed = np.repeat(base[word[at]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    at, item = np.repeat(at, size), seeds.item[seed]
    order = np.lexsort((at, item))  # places of a text follow each other
    at, item = at[order], item[order]
    text = w.text_of()[at]
    other = np.arange(len(at)) + seeds.hits[item] - 1
    inside = other < len(at)
    other[~inside] = 0
    use = np.flatnonzero(inside & (item[other] == item) & (text[other] == text) & (at[other] - at < items.span[item]))
    first, last, text, item = at[use], at[other[use]], text[use], item[use]
    start = w.first()[text]
    begin = np.maximum(last - items.span[item] + 1 - start, 0)
    end = np.minimum(first + items.span[item] - start, w.n[text])
    text, item, begin, end = _merged(text, item, begin, end)
    good = np.zeros(len(text), bool)
    stop = np.cumsum(end - begin)
    for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(stop // MOST_HITS)) + 1):
        good[part] = _enough(w, word, items, text[part], item[part], begin[part], end[part])
    return text[good], item[good], begin[good], end[good]


def _merged(text, item, begin, end):
    """Stretches of one text and item that overlap as one; they arrive sorted by item, text and place."""
    if not len(text):
        return text, item, begin, end
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])]
    edge = np.flatnonzero(new)
    return text[edge], item[edge], np.minimum.reduceat(begin, edge), np.maximum.reduceat(end, edge)


def _enough(w, word, items, text, item, begin, end):
    """Whether some span of a stretch holds as many words of the item as an alignment has to match."""
    if not len(text):
        return np.zeros(0, bool)
    size = end - begin
    edge = np.cumsum(size) - size
    flat = np.arange(size.sum())
    which = np.repeat(np.arange(len(text)), size)
    known = word[flat - edge[which] + (w.first()[text] + begin)[which]]
    hit = (known >= 0) & W.member(item[which] * len(items.word) + known, items.pair)
    total = np.r_[0, np.cumsum(hit)]
    within = total[np.minimum(flat + items.span[item][which], (edge + size)[which])] - total[flat]
    return np.maximum.reduceat(within, edge) >= items.need[item]


def _scored(ids, w, word, items, text, item, begin, end, threshold, min_words):
    first_item = items.first()
    base = w.first()[text] + begin
    size = end - begin
    found = []
    least = np.maximum(threshold * MATCH * items.n - 1e-6, MATCH * np.minimum(min_words, items.n))  # rounding is left to the test below
    item_word = np.searchsorted(items.word, items.h).astype(np.int32)
    word = word.astype(np.int32)

    def blocks(order):
        """Of similar size, so that little is filled up."""
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo) * int(size[order[hi]]) < 60_000:
                hi += 1
            yield order[lo:hi]
            lo = hi

    # scores alone first: most passages do not reach the threshold, and need no places
    good = np.zeros(len(text), bool)
    for c in blocks(np.lexsort((items.n[item], size))):
        wide, tall = np.arange(int(size[c].max())), np.arange(int(items.n[item[c]].max()))
        y = np.where(wide < size[c][:, None], word[np.minimum(base[c][:, None] + wide, len(word) - 1)], np.int32(-1))
        x = np.where(tall < items.n[item[c]][:, None], item_word[np.minimum(first_item[item[c]][:, None] + tall, len(item_word) - 1)], np.int32(-3))
        good[c] = best_scores(x, y) >= least[item[c]]
    order = np.lexsort((items.n[item], size))
    for c in blocks(order[good[order]]):
        wide, tall = int(size[c].max()), int(items.n[item[c]].max())
        column = np.minimum(base[c][:, None] + np.arange(wide), len(w.h) - 1)
        row = np.minimum(first_item[item[c]][:, None] + np.arange(tall), len(items.h) - 1)
        best, start, stop = smith_waterman(items.h[row], items.n[item[c]], w.h[column], size[c])
        score = best / (MATCH * items.n[item[c]])
        full = (score >= threshold) & (best >= MATCH * np.minimum(min_words, items.n[item[c]]))
        found += [(int(text[i]), int(item[i]), float(s), int(begin[i] + x), int(begin[i] + y)) for i, s, x, y in zip(c[full], score[full], start[full], stop[full], strict=True)]
    found.sort(key=lambda r: (r[0], r[1], -r[2], r[3]))
    kept, seen = [], None
    for r in found:  # the best passage of a document and an item
        if (r[0], r[1]) != seen:
            kept.append(r)
            seen = (r[0], r[1])
    if kept:
        yield pa.RecordBatch.from_arrays([
            ids.take(pa.array([r[0] for r in kept])), pa.array(items.ids[[r[1] for r in kept]]), pa.array([r[2] for r in kept]),
            pa.array([r[3] for r in kept]), pa.array([r[4] for r in kept])], names=["doc_id", "item_id", "score", "first_word", "last_word"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_words: int = 6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that hold a copy, whole or edited, of a benchmark item.

    Words are runs of ASCII letters and digits (A-Z in lower case) and of characters beyond ASCII.
    Returns a row per document and item whose best alignment scores at least `threshold` of the
    item's own score and that of `min_words` matching words (of all, if the item has fewer): doc_id, item_id, score (0 to 1),
    first_word and last_word (the aligned words of the document, from 0). No alignment that
    does so is missed, whatever was edited. Null texts have no words; items with a null id are left out.
    Repeated rows each give their rows; items with one id are searched each. Empty tables: empty
    result. Extra columns are not read.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    # a text has no more words than characters
    size = items.agg(F.coalesce(F.sum(F.char_length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_GRAMS))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        block = _items(sorted(rows, key=lambda r: (r["item_id"], r["text"])), threshold, min_words)
        frequency = np.zeros(len(block.word), np.int64)
        for r in docs.select("text").mapInArrow(_frequencies(block.word), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
            frequency[r["g"]] = r["n"]
        found = docs.mapInArrow(_align(block, rare_seeds(block, frequency), threshold, min_words), OUT)
        out = found if out is None else out.union(found)
    return out
