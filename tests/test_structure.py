from pyspark.sql import functions as F

from veritally.operators import outline as O
from veritally.operators import rules as U


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_numbering(spark):
    text = "1. 가\n가. 나\n1) 다\n3) 라\n나. 마\n1) 바\n2. 사\n다. 아\n힣. 자\n본문"
    got = [(r.line, r.expected, r.actual) for r in U.item_numbering(docs(spark, text), ["doc_id"]).orderBy("line").collect()]
    assert got == [(4, "2", "3"), (8, "가", "다"), (9, "라", "힣")]


def test_subtotals(spark):
    text = "예산 500,000\n인건비 300,000\n2026-09-07 031-1234-5678 14:00~16:00 9월 7일\n1) 항목 99\n합계 900,000\n소계 없음\n값 1\n총계 1"
    got = [(r.line, r.stated, r.computed) for r in U.subtotal_check(docs(spark, text), ["doc_id"]).collect()]
    assert got == [(5, 900000.0, 800000.0)]


def test_heading_levels(spark):
    from pyspark.sql import functions as F

    want = {"Ⅰ. 개요": 0, "1. 개요": 1, "가. 나": 2, "1) 가": 3, "가) 나": 4, "(1) 가": 5, "(가) 나": 6, "① 가": 7, "㉮ 가": 8,
            "□ 가": 9, "○ 가": 10, "- 가": 11, "· 가": 12, "2026. 1.": None, "2026. 1. 15.": None, "본문": None, "  1. 들여씀": 1}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.l for r in df.select("t", U.heading_level(F.col("t")).alias("l")).collect()} == want


PARAS = ["겉장", "Ⅱ\r\n\r\n수리 기록\r\n", "1. 지붕", " 기와 넉 장", "폭\n30\n40", "가. 물받이", "새는 곳 없음", "2. 다음 달"]


def paras(spark, texts=PARAS, tables=(1, 4)):
    return spark.createDataFrame([(1, i, t, i in tables) for i, t in enumerate(texts)], "doc_id long, para int, text string, is_table boolean")


def test_outline_with_tables_and_title_box(spark):
    got = [(r.section_id, r.kind, r.level, r.title, r.body_start, r.body_end, r.table_index)
           for r in O.outline(paras(spark)).orderBy("para").collect()]
    assert got == [
        ("s1", "heading", 0, "Ⅱ. 수리 기록", 2, 7, 0), ("s2", "heading", 1, "1. 지붕", 3, 6, None),
        ("s4", "table", None, "[표] 폭 | 30 | 40", None, None, 1), ("s5", "heading", 2, "가. 물받이", 6, 6, None),
        ("s7", "heading", 1, "2. 다음 달", None, None, None)]


def test_outline_without_headings(spark):
    got = [(r.section_id, r.kind, r.body_start) for r in O.outline(paras(spark, ["첫 줄", "\t", "끝 줄"], ())).orderBy("para").collect()]
    assert got == [("s0", "paragraph", None), ("s2", "paragraph", None)]


def test_section_of_paragraph(spark):
    p = paras(spark)
    got = {r.para: r.section_id for r in O.section_of_paragraph(p, O.outline(p)).collect()}
    assert got == {0: None, 1: "s1", 2: "s2", 3: "s2", 4: "s4", 5: "s5", 6: "s5", 7: "s7"}


def test_read_section(spark):
    p = paras(spark)
    wanted = spark.createDataFrame([(1, "s5"), (1, "s9")], "doc_id long, section_id string")
    got = {r.section_id: (r.title, r.body, r.error) for r in O.read_section(p, O.outline(p), wanted).collect()}
    assert got["s5"] == ("가. 물받이", "새는 곳 없음", None)
    assert got["s9"][2] == "구간 s9이(가) 없습니다"


def edit(spark, section, mode, text):
    p = paras(spark)
    e = spark.createDataFrame([(1, section, mode, text)], "doc_id long, section_id string, mode string, text string")
    out, log = O.apply_edits(p, O.outline(p), e)
    return [r.text for r in out.orderBy("para").collect()], log.collect()[0]


def test_edits(spark):
    out, log = edit(spark, "s5", "replace_body", "새 내용\n둘")
    assert out == PARAS[:6] + ["새 내용", "둘"] + PARAS[7:] and log.before == "새는 곳 없음"
    out, log = edit(spark, "s7", "replace_body", "본문")
    assert out == PARAS + ["본문"] and log.before == ""
    out, _ = edit(spark, "s5", "append", "덧붙임")
    assert out == PARAS[:7] + ["덧붙임"] + PARAS[7:]
    out, log = edit(spark, "s2", "replace", "x")
    assert out == PARAS and log.reason == "교체 범위 안에 표가 있어 덮어쓰지 않았습니다"
    assert edit(spark, "s4", "append", "x")[1].reason.startswith("표 구간")
    assert edit(spark, "s99", "append", "x")[1].reason == "구간 s99이(가) 없습니다"


def test_two_edits_of_one_document(spark):
    p = paras(spark)
    rows = [(1, "s5", "replace_body", "새 내용"), (1, "s7", "replace_body", "본문"), (1, "s5", "append", "겹침")]
    e = spark.createDataFrame(rows, "doc_id long, section_id string, mode string, text string")
    out, log = O.apply_edits(p, O.outline(p), e)
    assert [r.text for r in out.orderBy("para").collect()] == PARAS[:6] + ["새 내용"] + PARAS[7:] + ["본문"]
    log = {(r.section_id, r["mode"]): r for r in log.collect()}
    assert log["s5", "replace_body"].before == "새는 곳 없음" and log["s7", "replace_body"].before == ""
    assert log["s5", "append"].reason == "앞의 수정과 범위가 겹칩니다"


def lines(df):
    return [(r.text, r.is_table) for r in df.orderBy("para").collect()]


def test_reverts_of_every_kind(spark):
    p = paras(spark)
    for rows in ([("s5", "replace_body", "a\nb\nc"), ("s7", "replace_body", "x")], [("s5", "append", "a\nb"), ("s7", "append", "c")],
                 [("s5", "replace", "all new"), ("s7", "insert_after", "z\n\n y")], [("s7", "replace", "one\ntwo")]):
        out, log = O.apply_edits(p, O.outline(p), spark.createDataFrame([(1, *r) for r in rows], "doc_id long, section_id string, mode string, text string"))
        assert all(r.applied for r in log.collect())
        back, states = O.revert_edits(out, log)
        assert lines(back) == lines(p) and {r.state for r in states.collect()} == {"reverted"}


def test_revert_states(spark):
    p = paras(spark)
    e = spark.createDataFrame([(1, "s5", "replace_body", "새는 곳 없음"), (1, "s7", "replace_body", "본문"), (1, "s99", "append", "x")], "doc_id long, section_id string, mode string, text string")
    out, log = O.apply_edits(p, O.outline(p), e)
    assert {r.section_id: r.state for r in O.revert_edits(out, log)[1].collect()} == {"s5": "no_change", "s7": "reverted"}
    later = out.withColumn("text", F.regexp_replace("text", "^본문$", "다른 본문"))
    back, states = O.revert_edits(later, log)
    assert {r.section_id: r.state for r in states.collect()} == {"s5": "no_change", "s7": "no_target"} and lines(back) == lines(later)
    assert lines(O.revert_edits(p, log.where("false"))[0]) == lines(p)


def test_no_side_of_an_outline_join_is_broadcast(spark):
    p = paras(spark).repartition(2, "doc_id")
    e = spark.createDataFrame([(1, "s5", "replace_body", "새 내용")], "doc_id long, section_id string, mode string, text string")
    sections = O.outline(p)
    out, log = O.apply_edits(p, sections, e)
    back, states = O.revert_edits(out, log)
    for rows in (O.read_section(p, sections, e.select("doc_id", "section_id")), O.section_of_paragraph(p, sections), out, log, back, states):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_those_of_splitlines(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\na\nb", "a\r\nb\r", "a\x0bb\x0c", "a\x1cb\x1db\x1e", "a\x85b\u2028c\u2029", "a\n\x85", "\r\n\n"]
    got = {}
    for r in U.text_lines(docs(spark, *texts), ["doc_id"]).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert [got.get(i, []) for i in range(len(texts))] == [t.splitlines() for t in texts]


def test_rule_checks_counts_both_kinds_in_one_pass(spark):
    texts = ["1. 가\n3. 나\n값 5\n합계 6\n값 1\n총계 1", "", None, "본문", "1. 합계 7\n값 7\n소계 8\n5. 끝", "\n\n가. 나\n다. 라"]
    rows = docs(spark, *texts)
    checks = U.rule_checks(rows, ["doc_id"])
    assert sorted(tuple(r) for r in checks.collect()) == [(0, 1, 1, 2), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 1, 2), (5, 1, 0, 1)]
    assert plan(U.rule_checks(rows.repartition(3, "doc_id"), ["doc_id"])).count("Exchange") == 1


def test_tasks_of_lines_grow_with_the_table_and_move_no_text(spark, tmp_path, monkeypatch):
    from veritally.plans import render, structure

    orders = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.range(500).selectExpr("id", "id", "id * 1.5D", "timestamp_ntz'1995-03-04 00:00:00'", "'1-URGENT'").toDF(*[c.split()[0] for c in orders.split(", ")]).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(render, "TASK_ROWS", 20)
    for query in (structure.rule_checks, structure.subtotal_check, structure.outline, structure.outline_text, structure.item_numbering):
        out = plan(query(spark, str(tmp_path)))
        assert out.count("Exchange") == 1 and "hashpartitioning(o_orderkey" in out and ", 25)" in out


def test_sections_of_paragraphs_need_no_join(spark):
    p = paras(spark).unionByName(spark.createDataFrame([(None, 0, "1. 가", False), (2, 0, "본문", False)], "doc_id long, para int, text string, is_table boolean"))
    rows = O.section_of_paragraph(p, O.outline(p))
    assert "Join" not in plan(rows)
    assert {(r.doc_id, r.para): r.section_id for r in rows.collect() if r.doc_id != 1} == {(None, 0): None, (2, 0): "s0"}
