from pyspark.sql import functions as F

from veritally.sources import parts as S
from veritally.sources import cells as C
from veritally.sources.stage import staged


def test_read_texts_replaces_broken_bytes_and_skips_other_kinds(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("가 \n".encode() + b"\xff")
    (tmp_path / "sub" / "b.md").write_text("둘", encoding="utf-8")
    (tmp_path / "c.png").write_bytes(b"x")
    got = sorted(r.text for r in S.read_texts(spark, str(tmp_path)).collect())
    assert got == ["가 \n�", "둘"]


def test_parts_kinds_and_errors(spark):
    df = spark.createDataFrame([(1, "x/a.TXT", " 글　"), (2, "b.docx", "글"), (3, "c.csv", "  "), (4, "d.hwpx", "글")], "doc_id long, path string, text string")
    docs, parts = S.parts(df)
    assert {(r.doc_id, r.kind, r.error is None) for r in docs.collect()} == {(1, "text", True), (2, None, False), (3, "text", True), (4, "hwp", True)}
    assert [(r.doc_id, r.label, r.text) for r in parts.collect()] == [(1, "본문", "글")]


def test_path_set_keeps_first_and_skips_temporary_files(spark):
    rows = [("/a/./b.txt", 5), ("/a//b.txt", 2), ("/a/~$b.txt", 1), ("/a/_testb.txt", 1), ("/a/c.png", 1), ("\\a\\d.hwp", 3)]
    df = spark.createDataFrame(rows, "path string, ordinal int")
    assert {(r.path, r.first_no) for r in S.path_set(df).collect()} == {("/a/b.txt", 2), ("/a/d.hwp", 3)}


def test_retention_keeps_the_newest(spark):
    df = spark.createDataFrame([("d", f"p{i}", float(i)) for i in range(8)] + [("e", "q", 1.0)], "folder string, path string, mtime double")
    assert {r.path for r in S.outdated(df, ["folder"]).collect()} == {"p0", "p1", "p2"}


def test_ignore_list_and_templates(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "raw string, ordinal int")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("c", 3)], "raw string, ordinal int")
    assert {tuple(r) for r in S.upsert_ignored(old, new).collect()} == {("a", True, 1), ("b", True, 2), ("c", False, 2)}
    values = spark.createDataFrame([(1, "가", None)], "template_id int, k string, v string")
    templates = spark.createDataFrame([(1, "{{k}}/{{v}}/{{x}}/{{k}}")], "template_id int, template string")
    assert S.merge_templates(values, templates, ["k", "v"]).collect()[0].text == "가//{{x}}/가"


def test_sheet_text_and_preview_note_what_is_left_out(spark):
    rows = [("f", "s", i, 1, "str", None, None, "x" * 30 if i == 1 else f"r{i}") for i in range(1, 21)] + [("f", "s", 1, 9, "str", None, None, "far")]
    cells = spark.createDataFrame(rows, "source_file string, sheet string, row int, col int, kind string, v_num decimal(38,10), v_date date, v_str string")
    text = C.sheet_text(cells, limit=3).collect()[0].text
    assert text == "x" * 30 + " | far\nr2\nr3\n… (이하 17행 생략)"
    preview = {(r.row, r.col): r.text for r in C.preview_rows(cells).collect()}
    assert preview[(1, 1)] == "x" * 17 + "…" and (1, 9) not in preview and len(preview) == 16
    assert preview[(16, 1)] == "... 더 있음 (전체 20행 x 9열)"


def test_staged_tables_go_to_the_shared_folder(spark):
    from veritally.sources.stage import shared_folder

    kept = staged(spark.range(5), "five")
    assert kept.count() == 5
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert not named or shared_folder(spark) == named.rstrip("/")
    assert all(shared_folder(spark).removeprefix("file:") in f for f in kept.inputFiles())


def test_a_staged_table_leaves_no_shuffle_files(spark):
    import time

    from veritally.sources.stage import LET_GO

    blocks = lambda: {b.name() for b in _scala_list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle()}
    before, setting = blocks(), spark.conf.get(LET_GO, None)
    kept = staged(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().groupBy("count").agg(F.sum("k").alias("k")), "sums")
    for _ in range(100):
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before and spark.conf.get(LET_GO, None) == setting
    assert [tuple(r) for r in kept.collect()] == [(100, 45)]


def _scala_list(items):
    return [items.apply(i) for i in range(items.size())]


def test_numbers_keep_all_their_digits(spark):
    from decimal import Decimal

    from veritally.sources.cells import cell_raw, unpivot_cells

    rows = [(1, Decimal("0.000000000001"), 1e-12, Decimal("1234567890123456789012345678901234567890"[:38])), (2, Decimal("5.500000000000"), 2.5, Decimal(7)), (3, None, 1e30, None)]
    wide = spark.createDataFrame(rows, "row int, a decimal(20,12), b double, c decimal(38,0)")
    cells = unpivot_cells(wide, F.lit("f"), F.lit("s"), F.col("row"), ["a", "b", "c"])
    got = {(r["row"], r["col"]): (r["kind"], r["t"]) for r in cells.withColumn("t", cell_raw()).collect()}
    assert got == {
        (1, 1): ("num", "0.000000000001"), (1, 2): ("num", "0.000000000001"), (1, 3): ("num", "12345678901234567890123456789012345678"),
        (2, 1): ("num", "5.5"), (2, 2): ("num", "2.5"), (2, 3): ("num", "7"), (3, 2): ("num", "1" + "0" * 30)}


def test_sheet_that_starts_late_keeps_its_note(spark):
    from veritally.sources.cells import sheet_text

    schema = "source_file string, sheet string, row int, col int, kind string, v_num decimal(38,10), v_date date, v_str string"
    cells = spark.createDataFrame([("f", "late", 501, 1, "str", None, None, "x"), ("f", "both", 1, 1, "str", None, None, "a"), ("f", "both", 502, 1, "str", None, None, "b"), ("f", "blank", 3, 1, "str", None, None, "  ")], schema)
    assert {r["sheet"]: r["text"] for r in sheet_text(cells).collect()} == {"late": "… (이하 1행 생략)", "both": "a\n… (이하 2행 생략)"}


def test_shared_folder_is_needed_on_a_cluster():
    import pytest

    from veritally.sources.stage import shared_folder

    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_folder(Session)
