import random

import numpy as np
from pyspark.sql import functions as F

from veritally.operators import archive as A


def test_tokens(spark):
    df = spark.createDataFrame([("합동점검 표 A.B, 2026.1. x",)], "t string")
    assert df.select(A.tokens(F.col("t"))).collect()[0][0] == ["합동", "동점", "점검", "표", "a.b", "2026.1", "x"]


def test_chunks(spark):
    text = "짧은 문단\r\n\r\n" + "가" * 690 + "\n" + "나" * 1400 + "\n끝"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.text for r in A.chunks(df, ["doc_id"]).orderBy("chunk_no").collect()]
    assert [len(c) for c in got] == [696, 700, 700, 240, 1]
    assert got[0].startswith("짧은 문단\n가") and got[-1] == "끝"


def test_diff_and_reindex(spark):
    old = spark.createDataFrame([("a", "a", 1.0, None, None), ("b", "b", 1.0, None, None), ("c", "c", 1.0, None, "x"), ("d", "d", 1.0, None, None)],
                                "path string, name string, mtime double, year int, error string")
    new = spark.createDataFrame([("a", "a", 1.0, None, "글"), ("b", "b", 2.0, "err", ""), ("c", "c", 1.0, None, "새"), ("e", "2024 e", 1.0, None, "글 둘")],
                                "path string, name string, mtime double, error string, text string")
    chunks = A.chunks(spark.createDataFrame([("a", "글"), ("b", "글"), ("d", "글")], "path string, text string"), ["path"]).withColumn("label", F.lit("본문"))
    assert {r.path: r.action for r in A.archive_diff(old, new).collect()} == {
        "a": "skipped", "b": "failed", "c": "indexed", "d": "removed", "e": "indexed"}
    docs, rows = A.reindex(old, chunks, new)
    assert {(r.path, r.year, r.error) for r in docs.collect()} == {("a", None, None), ("b", None, "err"), ("c", None, None), ("e", 2024, None)}
    assert {(r.path, r.text) for r in rows.collect()} == {("a", "글"), ("c", "새"), ("e", "글 둘")}


def test_bm25_ranks_more_hits_first_and_drops_misses(spark):
    df = spark.createDataFrame([(1, "apple pear apple"), (2, "apple kiwi plum"), (3, "kiwi plum fig")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "apple apple")], "query_id long, text string")
    got = [(r.doc_id, r.rank) for r in A.bm25(A.chunks(df, ["doc_id"]), q, ["doc_id", "chunk_no"]).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def greedy(blocks, budget):
    if sum(s for _, s, _ in blocks) <= budget:
        return {n for n, _, _ in blocks}
    used, out = 0, set()
    for n, size, score in sorted(blocks, key=lambda b: -b[2]):
        if used + size <= budget:
            used += size
            out.add(n)
    return out


def test_packing_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    rows, want = [], {}
    for g in range(8):
        blocks = []
        for n in range(rng.randint(1, 60)):
            hits = rng.sample(words, rng.randint(0, 4))
            text = (" ".join(hits) + " " + "z" * rng.randint(1, 90)).strip()
            rows.append((g, n, "L", text))
            blocks.append((n, len(text) + 1 + 6, len(hits)))
        want[g] = greedy(blocks, 400)
    b = spark.createDataFrame(rows, "g int, block_no int, label string, text string")
    q = spark.createDataFrame([(g, " ".join(words)) for g in range(8)], "g int, question string")
    got = {}
    for r in A.context_pack(b, q, "g", budget=400).collect():
        got.setdefault(r.g, set()).add(r.block_no)
    assert got == want


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [3.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.1])], "query_id long, embedding array<float>")
    got = [r.vec_id for r in A.cosine_topk(v, q, k=3).orderBy("rank").collect()]
    assert got == [1, 4, 2]


def plain_best(terms, n, k):
    score = [0.0] * n
    for w, t in terms:
        for a, p in zip(t.at, t.part):
            score[a] += w * p
    return sorted((i for i in range(n) if score[i]), key=lambda i: (-round(score[i], 9), i))[:k], score


def test_pruned_search_equals_a_full_one():
    rng, skipped = np.random.default_rng(1), 0
    for trial in range(200):
        n, k = int(rng.integers(1, 3000)), int(rng.integers(1, 8))
        terms = []
        for _ in range(int(rng.integers(1, 9))):
            at = np.flatnonzero(rng.random(n) < rng.choice([0.002, 0.05, 0.9]))
            if len(at):
                part = np.round(rng.random(len(at)), 1 if trial % 2 else 6) + 0.1  # ties in every other trial
                terms.append((float(np.log(1 + n / len(at))), A.TermPostings(at, part)))
        looked = []
        top, scores = A.best_chunks(terms, n, k, looked)
        want, score = plain_best(terms, n, k)
        assert top.tolist() == want
        assert np.allclose(scores, [score[i] for i in want])
        skipped += sum(looked) < sum(len(t.at) for _, t in terms)
    assert skipped > 50


def test_search_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD", 7)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    docs = [(i % 40 if i % 11 else None, " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randint(0, 40)))) for i in range(90)]
    rows = A.chunks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("place", F.monotonically_increasing_id()).repartition(4), ["doc_id", "place"])
    rows = rows.cache()
    queries = spark.createDataFrame([(i, " ".join(rng.sample([*words, "none"], rng.randint(1, 12)))) for i in range(25)] + [(99, "none"), (98, "")], "query_id long, text string")
    got = {}
    for r in A.search_postings(A.term_postings(rows, ["doc_id", "place", "chunk_no"]).cache(), queries, ["doc_id", "place", "chunk_no"], block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], (r.doc_id, r.place), round(r.score, 7)))
    data = [((r.doc_id, r.place), r.tokens) for r in rows.collect()]
    n, avgdl = len(data), sum(len(t) for _, t in data) / len(data)
    want = {}
    for q in queries.collect():
        scored = []
        for key, t in data:
            s = 0.0
            for term in set(q.text.split()):
                tf, df = t.count(term), sum(term in u for _, u in data)
                if tf:
                    s += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
            if s:
                scored.append((-round(s, 9), (key[0] is not None, key[0], key[1]), key, s))
        if scored:
            want[q.query_id] = [(i + 1, x[2], round(float(x[3]), 7)) for i, x in enumerate(sorted(scored)[:5])]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_postings_keep_groups_apart_and_take_empty_tables(spark):
    rows = A.chunks(spark.createDataFrame([(i, f"word{i} all") for i in range(20)], "doc_id long, text string"), ["doc_id"]).withColumn("bucket", (F.col("doc_id") % 3).cast("int"))
    p = A.term_postings(rows, ["doc_id", "chunk_no"], "bucket")
    for r in p.where("term is null").collect():
        assert {key["doc_id"] % 3 for key in r["keys"]} == {r["bucket"]}
    none = rows.where("false")
    q = spark.createDataFrame([(1, "all")], "query_id long, text string")
    assert A.bm25(none, q, ["doc_id", "chunk_no"]).collect() == []
    assert A.bm25(rows, q.where("false"), ["doc_id", "chunk_no"]).collect() == []


def test_a_shard_takes_rows_of_several_batches(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD", 25)
    rows = spark.createDataFrame([(i, [f"w{i % 7}", "x"], 2) for i in range(110)], "id long, tokens array<string>, length int").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        heads = A.term_postings(rows, ["id"]).where("term is null").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(len(r["keys"]) for r in heads) == [10, 25, 25, 25, 25]
    assert sorted(k["id"] for r in heads for k in r["keys"]) == list(range(110))


def test_tokens_end_with_a_letter_or_digit(spark):
    texts = ["", ".,", "a", "a.", ".,a,.", "1.,2", "1,000.50. B.C., ..x..y..", "가A.나다라.1", "A" * 5000 + "." * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(A.tokens(F.col("t"))).collect()]
    assert got == [[], [], ["a"], ["a"], ["a"], ["1.,2"], ["1,000.50", "b.c", "x..y"], ["가", "나다", "다라", "a", "1"], ["a" * 5000]]
