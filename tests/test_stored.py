"""Stored tables, the kept index, and jobs that go on where they stopped."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from veritally.operators import archive as A
from veritally.sources import parts as S
from veritally.sources.stored import StoredTables
from veritally.streaming import jobs as J

FILE = "path string, name string, mtime double, error string, text string"


def files(spark, rows):
    return spark.createDataFrame([(p, f"2024 {p}", float(m), e, t) for p, m, e, t in rows], FILE)


def state(folder):
    """Data files by path and time of writing."""
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/[cd]*/**/*.parquet", recursive=True)}


def test_only_changed_buckets_are_written(spark, tmp_path):
    store = StoredTables(spark, str(tmp_path), "path", buckets=8)
    first = [(f"p{i}", 1, None, f"text {i}") for i in range(40)]
    A.update_index(store, files(spark, first))
    before, was = dict(((n, b), v) for n, b, v in store.manifest() if n[0] != "#"), state(tmp_path)
    assert {b for n, b in before if n == "chunks"} == set(range(8)) and store.version() == 1
    # the same again: nothing is written
    assert {r["action"] for r in A.update_index(store, files(spark, first)).collect()} == {"skipped"}
    assert store.version() == 1 and state(tmp_path) == was
    # one changed, one new, one gone, one failed
    second = [("p0", 2, None, "new text"), *first[2:3], ("p3", 5, "broken", None), *first[4:], ("p99", 1, None, "more")]
    actions = {r["path"]: r["action"] for r in A.update_index(store, files(spark, second)).collect()}
    assert {p: a for p, a in actions.items() if a != "skipped"} == {"p0": "indexed", "p1": "removed", "p3": "failed", "p99": "indexed"}
    after = dict(((n, b), v) for n, b, v in store.manifest() if n[0] != "#")
    touched = {r["b"] for r in files(spark, [(p, 0, None, "") for p in ("p0", "p1", "p3", "p99")]).select(store.bucket().alias("b")).collect()}
    assert 0 < len(touched) < 8
    assert {b for (n, b), v in after.items() if v == 2} == touched and all(after[k] == v for k, v in before.items() if k[1] not in touched)
    assert {k: v for k, v in state(tmp_path).items() if k in was} == was  # old files are as they were
    texts = {r["path"]: r["text"] for r in store.read("chunks", A.CHUNK_ROW).collect()}
    assert texts == {p: t for p, _, e, t in second if e is None}
    assert {r["path"]: r["error"] for r in store.read("docs", A.DOC_ROW).collect()} == {p: e for p, _, e, _ in second}


def test_an_update_deals_texts_and_no_tokens(spark, tmp_path, monkeypatch):
    """Each task writes a bounded number of rows, whatever the number of shuffle partitions is."""
    given, commit = [], StoredTables.commit
    monkeypatch.setattr(StoredTables, "commit", lambda self, tables, *more: given.append(tables["chunks"].columns) or commit(self, tables, *more))
    monkeypatch.setattr("veritally.sources.stored.TASK_ROWS", 10)
    store = StoredTables(spark, str(tmp_path), "path", buckets=1)
    first = [(f"p{i:03}", 1, None, f"Text {i}\n" + "가" * 701 * (i % 3)) for i in range(200)]
    A.update_index(store, files(spark, [*first, (None, 1, None, "no path")]))
    assert len(state(tmp_path)) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # p0 has another text at the same time: it is not read; p1 is emptied, p2 has no text, p3 goes
    second = [("p000", 1, None, "other"), ("p001", 2, None, ""), ("p002", 2, None, None), *first[4:], (None, 2, None, "none")]
    A.update_index(store, files(spark, second))
    assert len(given) == 2 and not any({"tokens", "length"} & set(c) for c in given)
    got = store.read("chunks", A.CHUNK_ROW)
    want = A.chunks(files(spark, [first[0], *first[4:]]), ["path"]).withColumn("label", F.lit("본문"))
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() > 300


def test_an_update_that_dies_changes_nothing(spark, tmp_path):
    store = StoredTables(spark, str(tmp_path), "path", buckets=4)
    A.update_index(store, files(spark, [("a", 1, None, "one"), ("b", 1, None, "two")]))
    bad = spark.createDataFrame([("a", 0)], "path string, chunk_no int").withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"chunks": bad}, [0, 1, 2, 3])
    assert store.version() == 1 and {r["text"] for r in store.read("chunks", A.CHUNK_ROW).collect()} == {"one", "two"}
    A.update_index(store, files(spark, [("b", 1, None, "two")]))
    assert store.version() == 2 and [r["text"] for r in store.read("chunks", A.CHUNK_ROW).collect()] == ["two"]


def test_empty_snapshots(spark, tmp_path):
    store = StoredTables(spark, str(tmp_path), "path")
    assert A.update_index(store, files(spark, [])).collect() == [] and store.version() == 0
    A.update_index(store, files(spark, [("a", 1, None, "")]))
    assert store.read("docs", A.DOC_ROW).count() == 1 and store.read("chunks", A.CHUNK_ROW).collect() == []
    A.update_index(store, files(spark, []))
    assert store.read("docs", A.DOC_ROW).collect() == []


def test_the_ignore_list_is_appended_to_once(spark, tmp_path):
    store = StoredTables(spark, str(tmp_path), "raw", buckets=8)
    add = lambda *rows: S.keep_ignored(store, spark.createDataFrame(list(rows), "raw string, ordinal long"))
    kept = lambda: [r["raw"] for r in store.read("ignored", S.IGNORED_ROW).orderBy("added", "ordinal").collect()]
    assert add(("b", 2), ("a", 5), ("b", 1), (None, 0)) == 2 and kept() == ["b", "a"]
    assert add(("a", 1)) == 0 and store.version() == 1
    assert add(("c", 9), ("b", 0), ("d", 3)) == 2 and kept() == ["b", "a", "d", "c"] and store.version() == 2


def test_rows_outside_the_touched_buckets_are_an_error(spark, tmp_path):
    store = StoredTables(spark, str(tmp_path), "path", buckets=64)
    with pytest.raises(ValueError, match="outside"):
        store.commit({"docs": files(spark, [(f"p{i}", 1, None, "") for i in range(30)])}, [1])


def test_the_index_stream_goes_on_and_removes(spark, tmp_path):
    arriving, folder = str(tmp_path / "in"), str(tmp_path / "index")

    def arrive(rows):
        files(spark, rows).coalesce(1).write.mode("append").parquet(arriving)
        docs, chunks = J.index_stream(spark.readStream.schema(FILE).parquet(arriving), folder, buckets=4)
        return {r["path"]: r["mtime"] for r in docs.collect()}, {r["path"]: r["text"] for r in chunks.collect()}

    assert arrive([("a", 1, None, "one"), ("b", 1, None, "two"), ("c", 1, "broken", None)]) == ({"a": 1, "b": 1, "c": 1}, {"a": "one", "b": "two"})
    store = StoredTables(spark, folder, "path", 4)
    assert store.note("batch") == 0
    docs, _ = J.index_stream(spark.readStream.schema(FILE).parquet(arriving), folder, buckets=4)
    assert store.note("batch") == 0 and docs.count() == 3  # nothing new arrived
    assert arrive([("a", 2, None, "uno"), ("a", 1, None, "old")]) == ({"a": 2, "b": 1, "c": 1}, {"a": "uno", "b": "two"})
    # a complete snapshot: a, b and c were seen since the start
    assert arrive([("d", 1, None, "four"), (None, 0, None, None)])[1] == {"a": "uno", "b": "two", "d": "four"}
    # the next one names b and d in two deliveries: a and c go
    assert arrive([("b", 1, None, "two")])[1] == {"a": "uno", "b": "two", "d": "four"}
    assert arrive([("d", 1, None, "four"), (None, 0, None, None)]) == ({"b": 1, "d": 1}, {"b": "two", "d": "four"})


def test_messages_are_taken_once(spark, tmp_path):
    arriving, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "conv_id long, turn long, text string, at timestamp"

    def arrive(rows):
        if rows:
            spark.createDataFrame(rows, "conv_id long, turn long, text string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(schema).parquet(arriving)
        return sorted((r["conv_id"], r["turn"]) for r in J.intake_stream(stream, ["conv_id", "turn"], folder, at="at").collect())

    assert arrive([(1, 0, "3번째로 가줘", "2024-01-01 10:00:00"), (1, 0, "3번째로 가줘", "2024-01-01 10:00:05")]) == [(1, 0)]
    written = sorted(glob.glob(f"{folder}/rows/*/*.parquet"))
    assert arrive([]) == [(1, 0)] and sorted(glob.glob(f"{folder}/rows/*/*.parquet")) == written
    assert arrive([(1, 0, "3번째로 가줘", "2024-01-01 10:10:00"), (1, 1, "안녕", "2024-01-01 10:11:00")]) == [(1, 0), (1, 1)]


def test_a_hot_key_sends_twenty_calls_a_task(spark, tmp_path):
    rows = [(1 if i % 2 else 100 + i, i, 10.0 + i, 1e9) for i in range(4_000)]
    calls = spark.createDataFrame(rows, "k long, at long, eval_count double, eval_ns double").repartition(4)
    sent = calls.mapInPandas(J.last_calls("k", 20), calls.schema).where("k = 1")
    tasks = calls.where("k = 1").select(F.spark_partition_id()).distinct().count()
    assert sent.count() == 20 * tasks
    arriving, folder = str(tmp_path / "in"), str(tmp_path / "speed")
    run = lambda: {r["k"]: r["low"] for r in J.speed_stream(spark.readStream.schema(calls.schema).parquet(arriving), "k", 300, folder).collect()}
    calls.where("at < 3000").write.parquet(arriving)
    run()
    calls.where("at >= 3000").write.mode("append").parquet(arriving)
    last = [c for k, a, c, _ in rows if k == 1][-20:]
    assert run()[1] == pytest.approx(300 / (sum(last) / 20) * 0.8)


def test_a_stream_of_a_table_in_one_file_or_a_folder(spark, tmp_path):
    from veritally.plans.streams import stream_intake

    rows = spark.createDataFrame([(c, t, "user", f"말 {c}") for c in range(6) for t in range(3)], "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = glob.glob(f"{tmp_path}/one/*.parquet")
    os.makedirs(tmp_path / "file")
    os.link(part, tmp_path / "file" / "conversations.parquet")
    for folder in ("many", "file"):
        got = sorted((r.conv_id, r.turn) for r in stream_intake(spark, str(tmp_path / folder)).collect())
        assert got == [(c, t) for c in range(6) for t in range(3)]


def test_a_stream_to_which_nothing_has_come(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "none"))
    rows = J.intake_stream(stream, ["conv_id", "turn"], str(tmp_path / "job"))
    assert rows.columns == ["conv_id", "turn", "kinds", "command", "item", "tool"] and rows.count() == 0


def test_snapshots_of_the_index_stream_are_files_of_many_tasks(spark, tmp_path, monkeypatch):
    from veritally.plans import streams as S

    docs = [(i, f"글 {i}", "web") for i in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(S, "fresh_path", lambda spark, name: str(tmp_path / name))
    got = {r.path: r.mtime for r in S.stream_index(spark, str(tmp_path)).collect()}
    want = {i: i + (60 if i % 10 == 0 else 0) for i in range(40) if i % 13 != 5 or i % 10 != 1}
    assert {int(p.split("_")[-1][:-4]): t for p, t in got.items()} == want
    assert len(list((tmp_path / "arrivals").glob("part-*"))) > 2  # one file is one task that reads a whole snapshot


def test_verdicts_of_a_stream_make_their_lists_once(spark, tmp_path, monkeypatch):
    """Batches share the lists, a report that comes again without values loses its verdicts, and nothing is joined for it."""
    from veritally.operators import reconcile as R

    made, lists = [], R.fact_lists
    monkeypatch.setattr(R, "fact_lists", lambda *a: made.append(1) or lists(*a))
    schema = "case_id long, ord long, type string, normalized string, raw string, source_file string, location string, label string, row_label string, column_header string, from_text boolean"
    pool = spark.createDataFrame([(1, 1, "amount", "1200", "1200", "f", "B1", "", "", "", False)], schema)
    docs, ids = "case_id long, doc_id long, text string", ["case_id", "doc_id", "type", "s", "raw"]
    want = [[(1, 1, "match"), (1, 2, "mismatch")], [(1, 2, "mismatch"), (1, 3, "match")]]
    for tasks in (0, 3):
        for k, rows in enumerate([[(1, 1, "금액 1,200원"), (1, 2, "금액 7원")], [(1, 1, "없음"), (1, 3, "1,200원"), (1, 4, None)]]):
            spark.createDataFrame(rows, docs).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{tasks}"))
            stream = spark.readStream.schema(docs).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{tasks}"))
            out = J.verify_stream(stream, pool, ids, str(tmp_path / f"job{tasks}"), tasks=tasks)
            assert sorted(tuple(r) for r in out.select("case_id", "doc_id", "verdict").collect()) == want[k]
    made.clear()
    J.verify_stream(stream, pool, ids, str(tmp_path / "anew"))  # two batches
    assert len(made) == 1
