"""The archive: chunks, snapshots, ranked search, vector search, context packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from veritally.functions import fixed as X
from veritally.functions.text import strip, unix_lines
from veritally.sources.stage import staged
from veritally.sources.stored import StoredTables


# --- tokens and chunks --------------------------------------------------------------
def tokens(text: Column) -> Column:
    """Hangul runs as 2-grams, then Latin and digit words in lower case without edge marks."""
    runs = F.regexp_extract_all(text, F.lit("([가-힣]+)"), F.lit(1))
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        ),
    )
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9](?:[A-Za-z0-9.,]*[A-Za-z0-9])?)"), F.lit(1))
    return F.concat(F.flatten(pairs), F.transform(words, F.lower))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([가-힣A-Za-z0-9]{2,})"), F.lit(1)))


def chunk_array(text: Column) -> Column:
    """Paragraphs packed up to the chunk size; longer ones cut with an overlap."""
    size, step = X.CHUNK_CHARS, X.CHUNK_CHARS - X.CHUNK_OVERLAP
    paras = F.filter(F.transform(F.split(unix_lines(text), "\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        pieces = F.transform(
            F.sequence(F.lit(0), F.length(p) - 1, F.lit(step)), lambda at: F.substring(p, at + 1, F.lit(size)))
        long = F.length(p) > size
        fits = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) + 1 <= size)
        done = F.when(long, F.concat(flushed, pieces)).when(fits, acc["done"]).otherwise(flushed)
        cur = F.when(long, F.lit("")).when(fits, F.concat(acc["cur"], F.lit("\n"), p)).otherwise(p)
        return F.struct(done.alias("done"), cur.alias("cur"))

    return F.aggregate(
        paras, start, add,
        lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))),
    )


def chunks(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """One row per chunk: ids, chunk_no, text, tokens, length.  Map-only."""
    rows = docs.select(*ids, F.posexplode(chunk_array(F.coalesce(F.col(text), F.lit("")))).alias("chunk_no", "text"))
    return rows.withColumn("tokens", tokens(F.col("text"))).withColumn("length", F.size("tokens"))


def guess_year(name: Column) -> Column:
    return F.regexp_extract(name, r"(20[0-9]{2})", 1).try_cast("int")


# --- snapshots ----------------------------------------------------------------------
def archive_diff(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, action): skipped, indexed, failed or removed; one full outer join by path."""
    old = stored.select("path", F.col("mtime").alias("_m0"), F.col("error").alias("_e0"), F.lit(True).alias("_old"))
    new = seen.select("path", F.col("mtime").alias("_m1"), F.col("error").alias("_e1"), F.lit(True).alias("_new"))
    same = (F.abs(F.col("_m0") - F.col("_m1")) < X.MTIME_TOLERANCE) & (F.coalesce("_e0", F.lit("")) == "")
    action = (
        F.when(F.col("_new").isNull(), "removed")
        .when(F.col("_old").isNotNull() & same, "skipped")
        .when(F.coalesce("_e1", F.lit("")) != "", "failed")
        .otherwise("indexed")
    )
    return old.join(new, "path", "full_outer").select("path", action.alias("action"))


def reindex(stored_docs: DataFrame, stored_chunks: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks) after a snapshot; only new and changed documents are chunked.

    `stored_docs`: path, name, mtime, year, error.  `stored_chunks`: path, chunk_no, label, text,
    tokens, length.  `seen`: path, name, mtime, error, text.
    """
    actions = archive_diff(stored_docs, seen)
    fresh = seen.join(actions.where("action in ('indexed', 'failed')"), "path")
    untouched = actions.where("action = 'skipped'").select("path")
    cols = ["path", "name", "mtime", "year", "error"]
    docs = stored_docs.join(untouched, "path", "left_semi").select(*cols).unionByName(
        fresh.withColumn("year", guess_year(F.col("name"))).select(*cols))
    new_chunks = chunks(fresh.where("action = 'indexed'"), ["path"]).withColumn("label", F.lit(X.BODY_LABEL))
    kept = stored_chunks.join(untouched, "path", "left_semi")
    return docs, kept.unionByName(new_chunks.select(*kept.columns))


DOC_ROW = "path string, name string, mtime double, year int, error string"
CHUNK_ROW = "path string, chunk_no int, label string, text string, tokens array<string>, length int"


def update_index(store: StoredTables, seen: DataFrame, complete: bool = True, notes: dict[str, int] | None = None,
                 seen_before: DataFrame | None = None) -> DataFrame:
    """Brings the stored tables `docs` and `chunks` up to date with a snapshot; returns (path, action).

    `seen`: path, name, mtime, error, text, one row per path. Only buckets with a new, changed, failed or
    vanished document are written; only new and changed documents are chunked; without any change there
    is no new version (with `notes` there is a manifest). If the snapshot is not `complete`, documents
    that it does not name stay - but for those that `seen_before` (path) does not name either, if given.
    """
    stored = store.read("docs", DOC_ROW)
    actions = archive_diff(stored, seen)
    if not complete:
        if seen_before is None:
            actions = actions.where("action <> 'removed'")
        else:
            actions = actions.join(seen_before.select("path", F.lit(True).alias("_before")), "path", "left").where("action <> 'removed' or _before is null").select("path", "action")
    actions = staged(actions.withColumn("bucket", store.bucket("path")), "actions")
    changed = actions.where("action <> 'skipped'")
    touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]
    if not touched:
        if notes:
            store.commit({}, [], notes)
        return actions.drop("bucket")
    fresh = seen.join(changed.where("action <> 'removed'").select("path", "action"), "path")
    docs = store.read("docs", DOC_ROW, touched).join(changed.select("path"), "path", "left_anti").unionByName(
        fresh.withColumn("year", guess_year(F.col("name"))).selectExpr("path", "name", "cast(mtime as double) as mtime", "year", "error"))
    # stored chunks, whole texts seen and actions meet where the store deals them by path
    held = store.read("chunks", CHUNK_ROW, touched).select("path", "chunk_no", "label", "text")
    held = held.withColumn("whole", F.lit(False)).withColumn("action", F.lit(None).cast("string"))
    arrived = seen.where(F.col("path").isNotNull() & store.bucket("path").isin(touched)).selectExpr(
        "path", "cast(null as int) as chunk_no", "cast(null as string) as label", "text", "true as whole", "cast(null as string) as action")
    done = changed.selectExpr("path", "cast(null as int) as chunk_no", "cast(null as string) as label", "cast(null as string) as text", "cast(null as boolean) as whole", "action")
    store.commit({"docs": docs, "chunks": held.unionByName(arrived).unionByName(done)}, touched, notes, {"chunks": _indexed})
    return actions.drop("bucket")


def _indexed(rows: DataFrame) -> DataFrame:
    """Chunk rows of paths whose stored chunks (not whole), text seen (whole) and action lie in one task.

    Stored chunks stay if nothing is done to their path, and texts are chunked if it is indexed. Tokens
    follow from the text, so they are made here and not shuffled.
    """
    action = F.max("action").over(Window.partitionBy("bucket", "path"))
    rows = rows.withColumn("action", action).where("(whole and action = 'indexed') or (not whole and action is null)")
    texts = F.when(F.col("whole"), chunk_array(F.coalesce("text", F.lit("")))).otherwise(F.array("text"))
    rows = rows.select("bucket", "path", "whole", "chunk_no", "label", F.posexplode(texts).alias("_at", "text"))
    rows = rows.select(
        "bucket", "path", F.coalesce("chunk_no", "_at").alias("chunk_no"),
        F.when(F.col("whole"), X.BODY_LABEL).otherwise(F.col("label")).alias("label"), "text")
    return rows.withColumn("tokens", tokens(F.col("text"))).withColumn("length", F.size("tokens"))


def archive_stats(docs: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """docs, failed, chunks in one row, each counted with partial sums."""
    a = docs.select(F.col("error").isNull().cast("long").alias("docs"),
                    F.col("error").isNotNull().cast("long").alias("failed"), F.lit(0).cast("long").alias("chunks"))
    b = chunk_rows.select(F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("failed"), F.lit(1).cast("long").alias("chunks"))
    return a.unionByName(b).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "failed", "chunks")])


# --- ranked search --------------------------------------------------------------------
def in_scope(chunk_rows: DataFrame, year: int | None = None, name_contains: str | None = None) -> DataFrame:
    """Filters stay below the statistics, which count only what they let through."""
    if year is not None:
        chunk_rows = chunk_rows.where(F.col("year") == year)
    if name_contains:
        chunk_rows = chunk_rows.where(F.col("name").ilike(f"%{name_contains}%"))
    return chunk_rows


def term_df(chunk_rows: DataFrame) -> DataFrame:
    """Number of chunks per term; terms are made distinct inside the chunk before the shuffle."""
    return chunk_rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))


#: Chunks of a shard, and postings of a block.
SHARD, BLOCK = 16384, 64
#: Scores within so much of the k-th best are compared to the last digit that ranks.
MARGIN = 1e-8


def term_postings(chunk_rows: DataFrame, ids: list[str], within: str | None = None) -> DataFrame:
    """The postings of chunk rows (ids, tokens, length), to be stored and searched by search_postings().

    Each task cuts its rows into shards of at most `SHARD` chunks, none of which mixes values of the
    column `within`. A shard has one row per term - `at`, the places of its chunks in ascending order,
    and `tf` of each - and one row without a term that holds the ids of its chunks in `keys`, in their
    order, and their `length`. No shuffle.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = dict(chunk_rows.dtypes)
    extra = [] if within is None else [within]
    schema = "".join(f"{c} {kinds[c]}, " for c in extra) + f"shard long, term string, at array<int>, tf array<int>, length array<int>, keys array<struct<{','.join(f'{c}:{kinds[c]}' for c in ids)}>>"

    def lists(starts, values):
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))

    def shard(table, number):
        table = table.take(pc.sort_indices(table.select(ids), sort_keys=[(c, "ascending") for c in ids], null_placement="at_start"))
        tokens, n = table.column("tokens").combine_chunks(), table.num_rows
        length = table.column("length").to_numpy().astype("int64")
        words = pc.dictionary_encode(tokens.flatten())
        of = np.repeat(np.arange(n), np.diff(tokens.offsets.to_numpy()))
        pair, tf = np.unique(words.indices.to_numpy().astype("int64") * n + of, return_counts=True)
        term, at = pair // n, pair % n
        starts = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
        size = len(words.dictionary) + 1
        keys = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ids], names=ids)
        header = lambda x: pa.ListArray.from_arrays(pa.array([0, n] + [n] * (size - 1), pa.int32()), x, mask=pa.array([False] + [True] * (size - 1)))
        columns = [pa.array([number] * size, pa.int64()), pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.cast(pa.string())]),
                   lists(np.r_[0, starts], at), lists(np.r_[0, starts], tf), header(pa.array(length, pa.int32())), header(keys)]
        groups = [pa.chunked_array([table.column(c).combine_chunks().take(pa.array(np.zeros(size, np.int64)))]).combine_chunks() for c in extra]
        return pa.record_batch(groups + columns, [*extra, "shard", "term", "at", "tf", "length", "keys"])

    def parts(batches):
        """Rows of one value each, or without one whole shards, which may take several batches."""
        held = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if within is not None:
                yield from (table.filter(pc.equal(table.column(within), v)) for v in pc.unique(table.column(within)))
                continue
            held.append(table)
            if sum(t.num_rows for t in held) >= SHARD:
                table = pa.concat_tables(held)
                whole = table.num_rows // SHARD * SHARD
                yield table.slice(0, whole)
                held = [table.slice(whole)]
        if sum(t.num_rows for t in held):
            yield pa.concat_tables(held)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in parts(batches):
            for lo in range(0, part.num_rows, SHARD):
                yield shard(part.slice(lo, SHARD), number)
                number += 1

    return chunk_rows.select(*extra, *ids, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("length", F.lit(0)).cast("int").alias("length")).mapInArrow(run, schema)


def search_postings(postings: DataFrame, queries: DataFrame, ids: list[str], query_id: str = "query_id",
                    k: int = X.SEARCH_TOP_K, block: int = 256) -> DataFrame:
    """Top k chunks per query by stored postings: query_id, ids, score (unrounded), rank.

    Only the rows of terms that some query has are read on; they meet in their shard, whose size is
    bounded, and every shard meets the queries in blocks of `block`. In a shard a query takes its terms
    by falling upper bound, rare ones first, until the terms that are left cannot lift a chunk without
    any of the others above the k-th best; from then on only the chunks that can still get there are
    looked up, and not in blocks of postings whose highest part is too low. Each pair of shard and query
    keeps k chunks, and each task keeps k per query of all its shards before anything is shuffled.
    """
    kinds, key_kind = dict(queries.dtypes), dict(postings.dtypes)["keys"]
    names = [f.split(":")[0] for f in key_kind[len("array<struct<"):-2].split(",")]
    terms = queries.select(query_id, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    hits = postings.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi")
    headers = postings.where("term is null")
    totals = headers.agg(F.sum(F.size("keys")).alias("n"), F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    n, words = totals["n"] or 0, totals["words"] or 0
    avgdl = max(words / n if n else 0.0, 1e-9)
    df = hits.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df.select("term", idf.alias("idf")), "term").groupBy(query_id).agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    blocks = weighted.groupBy(F.pmod(F.xxhash64(query_id), F.lit(-(-queries.count() // block) or 1)).alias("_b")).agg(
        F.collect_list(F.struct(F.col(query_id).alias("id"), F.col("terms"))).alias("queries")).drop("_b")
    shards = headers.unionByName(hits.select(headers.columns)).groupBy("shard").agg(
        F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "at", "tf"))).alias("postings"), *[F.first(c, ignorenulls=True).alias(c) for c in ("length", "keys")])
    schema = f"{query_id} {kinds[query_id]}, key struct<{key_kind[len('array<struct<'):-1]}, score double"
    best = shards.where(F.size("postings") > 0).crossJoin(blocks).mapInArrow(_shard_scorer(query_id, k, avgdl), schema)
    best = best.select(query_id, *[F.col(f"key.{c}").alias(c) for c in names], "score")
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), *ids)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _shard_scorer(query_id: str, k: int, avgdl: float):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, keys = batch.column("postings")[i].values, batch.column("keys")[i].values
                cut = rows.field("at").offsets.to_numpy()
                at, tf = (rows.field(c).values.to_numpy()[cut[0]:cut[-1]] for c in ("at", "tf"))
                cut = cut - cut[0]
                length = batch.column("length")[i].values.to_numpy()[at]
                part = tf * (X.BM25_K1 + 1) / (tf + X.BM25_K1 * (1 - X.BM25_B + X.BM25_B * length / avgdl))
                found = {t: TermPostings(at[lo:hi], part[lo:hi]) for t, lo, hi in zip(rows.field("term").to_pylist(), cut[:-1], cut[1:], strict=True)}
                wanted = batch.column("queries")[i].values
                query, place, score = [], [], []
                for q, terms in enumerate(wanted.field("terms").to_pylist()):
                    mine = [(t["idf"], found[t["term"]]) for t in terms if t["term"] in found]
                    top, scores = best_chunks(mine, len(keys), k)
                    query += [q] * len(top)
                    place.append(top)
                    score.append(scores)
                if query:
                    yield pa.record_batch([wanted.field("id").take(pa.array(query)), keys.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(score))], [query_id, "key", "score"])

    return run


class TermPostings:
    """Of one term in one shard: places, parts of the score without the idf, and the highest part per block."""

    def __init__(self, at: np.ndarray, part: np.ndarray):
        self.at, self.part = at, part
        self.block = np.maximum.reduceat(part, np.arange(0, len(part), BLOCK))
        self.most = self.block.max()


def best_chunks(terms: list[tuple[float, TermPostings]], n: int, k: int, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best of n chunks, ties to the smaller place; `looked` gets the postings read."""
    terms = sorted(terms, key=lambda t: -t[0] * t[1].most)
    left = np.r_[np.cumsum([w * t.most for w, t in reversed(terms)])[::-1], 0.0]
    score, least = np.zeros(n), 0.0
    chosen = None  # places that can still be among the best
    for i, (w, t) in enumerate(terms):
        if chosen is None and n > k and left[i] < score.max():
            least = np.partition(score, n - k)[n - k] - MARGIN
            if left[i] < least:
                chosen = np.flatnonzero(score + left[i] >= least)
        if chosen is None:
            score[t.at] += w * t.part
            if looked is not None:
                looked.append(len(t.at))
            continue
        at = np.searchsorted(t.at, chosen)
        block = np.minimum(at, len(t.at) - 1) // BLOCK
        open_ = score[chosen] + w * t.block[block] + left[i + 1] >= least  # others lack this term or cannot make it with it
        there = open_ & (t.at[np.minimum(at, len(t.at) - 1)] == chosen)
        if looked is not None:
            looked.append(int(open_.sum()))
        score[chosen[there]] += w * t.part[at[there]]
        chosen = chosen[open_ | (score[chosen] + left[i + 1] >= least)]
    if chosen is None:
        chosen = np.flatnonzero(score)
    near = np.round(score[chosen], 9)
    by = np.lexsort((chosen, -near))[:k]
    top = chosen[by]
    return top, score[top]


def bm25(chunk_rows: DataFrame, queries: DataFrame, ids: list[str], query_id: str = "query_id",
         k: int = X.SEARCH_TOP_K) -> DataFrame:
    """Top k chunks per query of chunk rows (ids, tokens, length): their postings, stored for this search."""
    return search_postings(staged(term_postings(chunk_rows, ids), "postings"), queries, ids, query_id, k)


def format_results(hits: DataFrame) -> Column:
    return F.concat(F.lit("["), "name", F.lit(" · "), "label", F.lit("] (점수 "), F.round("score", 3).cast("string"), F.lit(")\n"), "text")


# --- vector search --------------------------------------------------------------------
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024


def _blocks(keys: str, vec: str, size: int):
    """Vectors of a partition as rows of at most `size` keys and one matrix of unit vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.iloc[lo:lo + size]
                matrix = np.vstack(part[vec].to_numpy()).astype("float64")
                matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"keys": [part[keys].to_numpy()], "matrix": [matrix.tobytes()]})

    return run


def cosine_topk(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vec: str = "embedding",
                query_id: str = "query_id", k: int = X.SEARCH_TOP_K) -> DataFrame:
    """Exact top k by cosine: query_id, vec_id, score, rank. Rows without a vector are left out.

    Vectors and queries are packed into blocks of bounded size where they are, every block of
    queries meets every block of vectors, and each meeting is one matrix product that keeps k rows
    per query. No query goes through the driver and no pair of single vectors becomes a row.
    """
    kinds = {vec_id: dict(vectors.dtypes)[vec_id], query_id: dict(queries.dtypes)[query_id]}

    def packed(rows: DataFrame, key: str, size: int, names: tuple[str, str]) -> DataFrame:
        full = rows.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(key, vec)
        return full.mapInPandas(_blocks(key, vec, size), f"keys array<{kinds[key]}>, matrix binary").toDF(*names)

    pairs = packed(vectors, vec_id, VECTOR_BLOCK, ("ids", "vectors")).crossJoin(
        packed(queries, query_id, QUERY_BLOCK, ("keys", "queries")))
    best = pairs.mapInPandas(_scorer(query_id, vec_id, k), f"{query_id} {kinds[query_id]}, {vec_id} {kinds[vec_id]}, score double")
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), vec_id)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scorer(query_id, vec_id, k):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, queries, ids, vectors in zip(batch["keys"], batch["queries"], batch["ids"], batch["vectors"]):
                scores = np.frombuffer(queries).reshape(len(keys), -1) @ np.frombuffer(vectors).reshape(len(ids), -1).T
                near, n = np.round(scores, 9), min(k, len(ids))
                # all that reach the k-th best of their query, then ties go to the smaller id
                cut = np.partition(near, len(ids) - n, axis=1)[:, len(ids) - n]
                row, col = np.nonzero(near >= cut[:, None])
                order = np.lexsort((ids[col], -near[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < n], col[place < n]
                yield pd.DataFrame({query_id: keys[row], vec_id: ids[col], "score": scores[row, col]})

    return run


# --- context under a budget -------------------------------------------------------------
def context_pack(blocks: DataFrame, questions: DataFrame, group: str, question: str = "question",
                 budget: int = X.PACK_BUDGET) -> DataFrame:
    """Which blocks of a group go into the context of its question.

    `blocks`: group, block_no, label, text.  If all blocks fit, all go in order; else blocks with
    the most question words come first, misfits are skipped and the rest goes on.

    Room only shrinks, so the accepted blocks of one size are the first ones of that size, at most
    budget / size of them.  Only those are gathered, as numbers: a bounded list per group however
    many blocks it has.
    """
    text = F.when(
        F.length("text") > X.PACK_PART_CHARS,
        F.concat(F.substring("text", 1, X.PACK_PART_CHARS), F.lit(X.PACK_CUT_NOTE)),
    ).otherwise(F.col("text"))
    sized = blocks.withColumn("text", text).withColumn(
        "size", F.length("text") + F.length("label") + X.PACK_OVERHEAD)
    asked = sized.join(questions.select(group, F.col(question).alias("_q")), group)
    scored = asked.withColumn("score", F.size(F.array_intersect(word_set(F.col("_q")), word_set(F.col("text")))))
    rows = scored.select(group, "block_no", "label", "size", "score")
    total = rows.groupBy(group).agg(F.sum("size").alias("total"))
    order = Window.partitionBy(group, "size").orderBy(F.desc("score"), "block_no")
    tried = rows.where(F.col("size") <= budget).withColumn("_r", F.row_number().over(order)).where(
        F.col("_r") <= F.floor(F.lit(budget) / F.col("size")))
    gathered = tried.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "block_no", "size"))).alias("cands"))

    def take(acc: Column, c: Column) -> Column:
        fits = acc["used"] + c["size"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + c["size"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["taken"], F.array(c["block_no"]))).otherwise(acc["taken"]).alias("taken"),
        )

    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))
    chosen = gathered.select(group, F.aggregate("cands", zero, take)["taken"].alias("taken"))
    both = rows.join(total, group).join(chosen, group, "left")
    kept = both.where((F.col("total") <= budget) | F.array_contains("taken", F.col("block_no")))
    return kept.select(group, "block_no", "label", "size", "score", (F.col("total") > budget).alias("over_budget"))


def part_budget(parts: DataFrame, doc: str, limit: int = X.PART_BUDGET, min_tail: int = X.PART_MIN_TAIL) -> DataFrame:
    """Parts of each document up to a size: kept whole, one cut tail if it is worth it, then none.

    `parts`: doc, part_no, block (heading line and text).
    """
    size = F.length("block")
    before = Window.partitionBy(doc).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_used", F.coalesce(F.sum(size + 2).over(before), F.lit(0)))
    rows = rows.withColumn("_over", F.col("_used") + size > limit)
    rows = rows.withColumn("_stopped", F.coalesce(F.max("_over").over(before), F.lit(False)))
    remain = (F.lit(limit) - F.col("_used")).cast("int")
    kept = rows.where(~F.col("_stopped") & (~F.col("_over") | (remain > min_tail)))
    return kept.select(
        doc, "part_no",
        F.when(F.col("_over"), F.concat(F.substring("block", F.lit(1), remain), F.lit(X.PART_CUT_NOTE))).otherwise(F.col("block")).alias("block"),
        F.col("_over").alias("truncated"),
    )
