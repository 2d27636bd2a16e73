from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from tests.llm.conftest import ODD
from veritally.llm import jaccard as J
from veritally.llm.decontaminate import contaminated, smith_waterman
from veritally.llm.graph import components
from veritally.llm.substring import substring_dedup


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("window", [13, 4])
def test_substring_dedup_is_brute_force(corpus, window):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup(corpus, window).collect())
    assert got == Counter(plain.repeated(rows_of(corpus), window))


def test_substring_dedup_odd_rows(odd):
    out = substring_dedup(odd).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out) == Counter(plain.repeated(ODD, 13))
    for r in out:
        assert plain.words(r["cut"]) == plain.words(r["kept"])
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_substring_dedup_keeps_layout_and_carries(make):
    line = " ".join(f"p{i}" for i in range(20))
    out = {r["doc_id"]: r for r in substring_dedup(make([(1, line), (2, f"head\n\n{line}\ttail  end")]), carry=("source", "grp")).collect()}
    assert out[1]["n_removed"] == 0 and out[1]["cut"] == line
    assert out[2]["cut"] == "head tail  end" and [tuple(s) for s in out[2]["spans"]] == [(1, 21)]
    assert out[2]["carried"]["source"] == "s" and out[2]["carried"]["grp"] == 1


def test_empty_tables(empty, spark):
    assert substring_dedup(empty).collect() == []
    assert J.jaccard_components(empty).collect() == []
    benchmark = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert contaminated(empty, benchmark).collect() == []


@pytest.mark.parametrize("k,percent", [(4, 85), (2, 50)])
def test_jaccard_is_brute_force(corpus, k, percent):
    got = Counter(tuple(r) for r in J.jaccard_components(corpus, k, percent).collect())
    assert got == Counter(plain.components(rows_of(corpus), k, percent))


def test_jaccard_odd_rows(odd):
    assert Counter(tuple(r) for r in J.jaccard_components(odd, 4, 85).collect()) == Counter(plain.components(ODD, 4, 85))


def test_jaccard_finds_every_link_of_chains_and_families(make):
    # copies with one to nine words changed: some pairs link, some only through others
    base = [f"x{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for d in range(1, 60):
        w = list(base)
        for j in range(1 + d % 9):
            w[(d * 17 + j * 23) % 120] = f"y{d}{j}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join(f"z{(i + d * 3)}" for i in range(90))) for d in range(20)]  # each links its neighbour
    assert Counter(tuple(r) for r in J.jaccard_components(make(rows), 4, 85).collect()) == Counter(plain.components(rows, 4, 85))


def test_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for size in (5, 80, 900):
        a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[size // 8:], r.integers(0, 1 << 63, size // 9).astype(np.uint64)]))
        x, y = (np.frombuffer(J.folded(s, np.array([len(s)]))[0], np.uint64) for s in (a, b))
        width = min(len(x), len(y))
        apart = int(np.bitwise_count(J._fold(x, width) ^ J._fold(y, width)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)] + [(200, x) for x in range(201, 230)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 98 for i in (98, 99, 100)}, **{i: 200 for i in range(200, 230)}}


def test_alignment_scores():
    a = np.array([[1, 2, 3, 4, 5, 6, 7, 8]], np.uint64)

    def score(y):
        y = np.array([y], np.uint64)
        best, start, stop = smith_waterman(a, np.array([8]), y, np.array([y.shape[1]]))
        return int(best[0]), int(start[0]), int(stop[0])

    def brute(y):
        h = np.zeros((9, len(y) + 1), int)
        for i in range(8):
            for j, v in enumerate(y):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if v == i + 1 else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return int(h.max())

    assert score([9, 1, 2, 3, 4, 5, 6, 7, 8, 9]) == (16, 1, 8)
    assert score([1, 2, 3, 9, 5, 6, 7, 8]) == (13, 0, 7)
    r = np.random.default_rng(3)
    for _ in range(60):
        y = r.integers(1, 10, r.integers(1, 14)).tolist()
        assert score(y)[0] == brute(y)


def test_decontamination(make, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    edited = list(item)
    edited[4], edited[11] = "changed", "other words"
    noise = [f"n{i}" for i in range(300)]
    rows = [(1, " ".join(noise[:40] + item + noise[40:])), (2, " ".join(noise[:9] + edited)), (3, " ".join(noise)), (4, " ".join(item[:6] + noise)),
            (5, ", ".join(x.upper() for x in item)), (6, None), (7, "alpha beta"), (1, " ".join(item))]
    benchmark = spark.createDataFrame([(10, " ".join(item), 1), (11, "too short", 2), (12, None, 3), (None, " ".join(item), 4)], "item_id long, text string, doc_id int")
    got = contaminated(make(rows), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 10), (1, 10), (2, 10), (5, 10)]
    one = max((r for r in got if r["doc_id"] == 1), key=lambda r: r["first_word"])
    assert (one["first_word"], one["last_word"], one["score"]) == (40, 59, 1.0)
    assert 0.5 <= next(r for r in got if r["doc_id"] == 2)["score"] < 1
    assert contaminated(make(rows), benchmark.limit(0)).collect() == []


def test_decontamination_finds_all_planted_items(corpus, spark):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")

    def plain_text(t):
        return " " + " ".join(plain.alnum_words(t)) + " "

    items = {r["item_id"]: plain_text(r["text"]) for r in benchmark.collect()}
    want = {(i, n) for i, t in rows_of(corpus) for n, x in items.items() if x in plain_text(t)}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(corpus, benchmark).collect()}
    assert want and want <= got


def test_decontamination_in_blocks_is_the_same(corpus, spark, monkeypatch):
    import veritally.llm.decontaminate as D

    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, contaminated(corpus, benchmark).collect()))
    monkeypatch.setattr(D, "BLOCK_GRAMS", 4000)
    assert [r[:2] for r in sorted(map(tuple, contaminated(corpus, benchmark).collect()))] == [r[:2] for r in whole]


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.mark.parametrize("copies", [0, 3])
def test_decontamination_finds_dense_edits(make, spark, copies):
    noise = [f"n{i}" for i in range(60)]
    every = {k: [f"x{i}" if i % k == k - 1 else w for i, w in enumerate(ITEM)] for k in (3, 4, 5)}
    spread = [x for i, w in enumerate(ITEM) for x in (w, f"y{i}")]  # a new word after each: no two neighbours are left
    rows = [(k, " ".join(noise + w + noise)) for k, w in every.items()] + [(6, " ".join(spread)), (7, " ".join(noise))]
    rows += [(100 + i, " ".join(noise[i:] + ITEM)) for i in range(copies)]
    benchmark = spark.createDataFrame([(10, " ".join(ITEM))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in contaminated(make(rows), benchmark).collect()}
    assert got == {3: 0.55, 4: 0.65, 5: 0.725, 6: 0.525} | {100 + i: 1.0 for i in range(copies)}


@pytest.mark.parametrize("threshold", [0.5, 0.6])
def test_decontamination_is_alignment_with_whole_documents(make, spark, threshold):
    r = np.random.default_rng(8)
    items = [[f"w{x}" for x in r.integers(0, 80, r.integers(8, 30)) ** 2 // 60] for _ in range(12)]
    rows = []
    for i in range(150):
        w = [f"w{x}" for x in r.integers(0, 80, r.integers(0, 120)) ** 2 // 60]
        for x in items[i % 12]:
            u = r.random()
            w += [] if u < 0.15 else [f"w{r.integers(0, 100)}"] if u < 0.35 else [x, "and"] if u < 0.5 else [x]
        rows.append((i, " ".join(w + [f"w{x}" for x in r.integers(0, 80, r.integers(0, 90))])))
    want = set()
    for i, t in rows:
        y = t.split()
        for j, x in enumerate(items):
            code = {v: k for k, v in enumerate(dict.fromkeys(x + y))}
            best = smith_waterman(np.array([[code[v] for v in x]]), np.array([len(x)]), np.array([[code[v] for v in y]]), np.array([len(y)]))[0][0]
            if best >= 12 and best / (2 * len(x)) >= threshold:
                want.add((i, j, best / (2 * len(x))))
    benchmark = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in contaminated(make(rows), benchmark, threshold=threshold).collect()}
    assert want and got == want


def test_short_items_and_null_ids(make, spark, tmp_path):
    from corpus_pipeline import drop_benchmark_leaks

    benchmark = spark.createDataFrame([(1, "one two"), (2, "red green blue cyan"), (3, " ".join(ITEM))], "item_id long, text string")
    rows = [(1, "so one two it is"), (2, "a red green blue cyan b"), (3, "two one red blue"), (None, "x " + " ".join(ITEM)), (None, "clean"), (4, None)]
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in contaminated(make(rows), benchmark).collect()) == [(0, 3), (1, 1), (2, 2)]
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = drop_benchmark_leaks(spark, make(rows), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, "clean"), (3, "two one red blue"), (4, "")]


def test_stages_take_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = " ".join(f"w{i}" for i in range(40))
    rows = [(1, some, 9, 7, "x", 9), (2, some, 9, 8, "y", 8), (3, "other " + some + " " + " ".join(f"z{i}" for i in range(60)), 9, 1, "q", 2), (None, "alone", 5, 1, "k", 3), (4, None, None, 2, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _id int, _h string, _text_key int")
    extra = {r[:1] + r[3:] for r in rows}
    for stage, gone in ((C.drop_near_duplicates, {2}), (C.cut_repeated_passages, {2}), (C.drop_benchmark_leaks, set())):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {(r["doc_id"], r["_id"], r["_h"], r["_text_key"]) for r in out.collect()} == {r for r in extra if r[0] not in gone}


def test_scores_alone_are_those_of_the_alignment():
    from veritally.llm.decontaminate import best_scores

    r = np.random.default_rng(11)
    for rows, tall, wide in ((1, 1, 1), (3, 1, 9), (5, 12, 4), (60, 9, 30), (4, 70, 150)):
        nx, ny = r.integers(1, tall + 1, rows), r.integers(1, wide + 1, rows)
        x, y = r.integers(1, 7, (rows, tall)), r.integers(1, 7, (rows, wide))
        best = smith_waterman(x.astype(np.uint64), nx, y.astype(np.uint64), ny)[0]
        x[np.arange(tall) >= nx[:, None]], y[np.arange(wide) >= ny[:, None]] = -3, -1
        assert (best_scores(x.astype(np.int32), y.astype(np.int32)) == best).all()


def test_only_passages_that_reach_the_threshold_are_aligned_with_places(monkeypatch):
    from veritally.llm import decontaminate as D

    item = [f"w{i}" for i in range(20)]
    texts = [" ".join(item), " ".join(item[::-1]), " ".join(f"{x} z{i}" for i, x in enumerate(item[::-1]))] * 40
    items = D._items([{"item_id": 7, "text": " ".join(item)}], 0.5, 6)
    rows = []
    full = D.smith_waterman
    monkeypatch.setattr(D, "smith_waterman", lambda x, nx, y, ny: rows.append(len(x)) or full(x, nx, y, ny))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = [r for b in D._align(items, D.rare_seeds(items, np.zeros(len(items.word), np.int64)), 0.5, 6)([batch]) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in out) == list(range(0, len(texts), 3)) and sum(rows) == 40


def test_groups_of_one_component_are_dealt_together(spark, monkeypatch):
    groups = spark.createDataFrame([(100 * x + i, x, x + 1, 10) for x in range(3) for i in range(100)], "key long, x long, y long, rows long")
    one = J._dealt(groups).collect()
    assert sorted(r.key for r in one) == list(range(300)) and len({r.deal for r in one}) == 3  # by key there were 300
    assert all(len({r.deal for r in one if r.key // 100 == x}) == 1 for x in range(3))
    monkeypatch.setattr(J, "DEAL_ROWS", 250)
    some = J._dealt(groups).collect()
    assert sorted(r.key for r in some) == list(range(300)) and 3 < len({r.deal for r in some}) <= 12
