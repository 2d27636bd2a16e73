"""Golden rows for extraction; every expectation is written out by hand."""

import re

from veritally.functions import fixed as X
from veritally.operators import mentions as M

GOLDEN = [
    ("문의 042-7654-3210, 회비 64,200원, 2025-03-11 09:30~11:00 모임",
     [("amount", "64200"), ("date", "2025-03-11"), ("phone", "042-7654-3210"), ("time", "09:30~11:00")]),
    ("예산은 1.005천원입니다", [("amount", "1005")]),
    ("사업비 7.25억원, 4.1조원, 36만원, 오차 0.00000025%", [("amount", "0.00000025"), ("amount", "360000"), ("amount", "4100000000000"), ("amount", "725000000")]),
    ("12345678901234567890123456789012345678901원", [("amount", "12345678901234567890123456789012345678901")]),
    ("2026-09-07, 9월 7일, '26.9.7(화), 2026. 1., 2026. 1. 15., 2024.1월, 2024.1월~12월",
     [("date", "2024-01"), ("date", "2024-01~2024-12"), ("date", "2026-01"), ("date", "2026-01-15"),
      ("date", "2026-09-07"), ("date", "2026-09-07"), ("date", "2026-09-07")]),
    ("14:00~16시 14:100~16시 09:001~10시",
     [("amount", v) for v in sorted(["14", "0", "16", "14", "100", "16", "9", "1", "10"])]),
    ("14:30~16:45, 14시~16시, 14~16시", [("time", "14:00~16:00"), ("time", "14:00~16:00"), ("time", "14:30~16:45")]),
    ("(`19) 3,210명 → ('20) 4,055 → (21) 5,871", [("amount", "3210"), ("amount", "4055"), ("amount", "5871")]),
    ("2026년 '26년 24년도", [("year", "2024"), ("year", "2026"), ("year", "2026")]),
    ("대여 권수(4,306)는 감소. 총합은 9120000.", [("amount", "4306"), ("amount", "9120000")]),
    ("1. 개요\n 2) 항목\n(3) 셋\n붙임  1. 계획서 1부.", [("amount", "1")]),
    ("1 2 3 4 5 6 7 8 9 10 11 12 합 78", [("amount", "78")]),
    ("3 4 5 6 7", [("amount", v) for v in "34567"]),
    ("12026-09-07", [("date", "2026-09-07")]),
    ("목  차\n\nⅠ. 여는 글\t 3\n 별 지 2. 통계표\t 27\n\n첫 쪽\n회비는 64,200원", [("amount", "64200")]),
    ("２０２４년 예산 ３０원", [("amount", "30"), ("year", "2024")]),
    ("숫자 없음", []),
]


def test_golden_values(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "doc_id long, text string")
    rows = M.extract_all(df, ["doc_id"]).collect()
    for i, (text, want) in enumerate(GOLDEN):
        got = sorted((r.type, r.normalized) for r in rows if r.doc_id == i)
        assert got == sorted(want), text
        for r in (r for r in rows if r.doc_id == i):
            assert text[r.s:r.e] == r.raw


def test_spans_are_those_of_the_pattern(spark):
    text = "가 1,2 나 12,345.6원 😀 7% 12\n3.5 만원 0012 2,0000 " * 40 + "x" * 20000 + " 9원"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted((r.s, r.e, r.raw) for r in M.extract(df, ["doc_id"], types=("amount",)).collect())
    assert got == [(m.start(), m.end(), m.group()) for m in re.finditer(X.AMOUNT, text)]


def test_context_ends_at_clause_not_at_grouping_comma(spark):
    text = "첫 문장. 도서 대출 : ('18) 2,408권 → ('19) 3,117, 이어서 8명; 끝 9"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.normalized: r.context for r in M.extract_all(df, ["doc_id"]).collect()}
    assert got == {"2408": "도서 대출 : ('18)", "3117": "도서 대출 : ('18) 2,408권 → ('19)", "8": "이어서", "9": "끝"}


def test_weekdays(spark):
    df = spark.createDataFrame([(1, "'26.9.7(화) '26.9.7(월) '26.13.7(월) 2026-09-07")], "doc_id long, text string")
    got = sorted((r.raw, r.actual_weekday, r.issue) for r in M.weekday_check(df, ["doc_id"]).collect())
    assert got == [("'26.13.7(월)", None, "invalid_date"), ("'26.9.7(화)", "월", "mismatch")]


def test_partitioning_does_not_change_results(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "doc_id long, text string")
    key = lambda d: sorted(map(tuple, M.extract_all(d, ["doc_id"]).collect()))
    assert key(df.repartition(1)) == key(df.repartition(7, "text"))


def test_rows_with_one_id_do_not_mix(spark):
    docs = spark.createDataFrame([(1, "가나 100원"), (1, "긴 앞머리가 있는 글 2026-09-07, 값 200원")], "id int, text string")
    got = {(r["raw"], r["s"], r["e"], r["context"]) for r in M.extract_all(docs, ["id"]).collect()}
    assert ("100원", 3, 7, "가나") in got
    text = "긴 앞머리가 있는 글 2026-09-07, 값 200원"
    assert {(r, s, e) for r, s, e, _ in got} == {("100원", 3, 7), ("2026-09-07", text.index("2026"), text.index(",")), ("200원", text.index("200"), len(text))}


def test_dealt_documents_are_extracted_where_they_lie(spark):
    texts = ["금액 1,200원, 접수일 2026-03-04", "시간 9~11시, 연락처 031-123-4567", "없음", None, "1 2 3 4 5 6 7 8 9 10 11 12 합 40", "'26.3.4(월) 5건"]
    docs = spark.createDataFrame([(i % 3, i % 7, t) for i, t in enumerate(texts * 4)], "case_id long, doc_id long, text string")
    dealt = docs.repartition(3, "doc_id")
    values = M.extract_all(dealt, ["case_id", "doc_id"], dealt=True)
    rows = lambda df: sorted(map(str, df.collect()))
    assert values._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(values) == rows(M.extract_all(docs, ["case_id", "doc_id"]))
    wrong = M.weekday_check(dealt, ["doc_id"], dealt=True)
    assert wrong._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(wrong) == rows(M.weekday_check(docs, ["doc_id"])) and wrong.count() == 4
