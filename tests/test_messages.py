from pyspark.sql import functions as F

from veritally.operators import routing as G
from veritally.operators import tabular as B


def test_pii(spark):
    want = {"900101-1234567": "주민등록번호", "010-1234-5678": "휴대폰번호", "01012345678": "휴대폰번호", "031-1234-5678": "",
            "110-22-1234567": "계좌번호", "031-1234-5678 그리고 110-22-1234567": "계좌번호", "2026-09-07": "계좌번호", "없음": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "doc_id long, text string")
    assert {r.text: r.kinds for r in G.pii_flags(df, ["doc_id"]).collect()} == want


def test_intents_and_commands(spark):
    want = {"숫자 검증해줘": "verify_numbers", "현장점검 안내": None, "작년 건수": "ask_archive", "작년 첨부에서 찾아줘": "ask_attachment",
            "표로 정리해": "polish_to_formal_style", "그래프": "insert_chart", "쪽맞춤": "fit_to_one_page"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.i for r in df.select("t", G.intent(F.col("t")).alias("i")).collect()} == want
    name, item = G.command(F.col("t"))
    df = spark.createDataFrame([("2번째는 무시해",), ("10번째 보여줘",), ("검증",)], "t string")
    assert [tuple(r) for r in df.select(name, item).collect()] == [("ignore", 2), ("goto", 10), (None, None)]


def test_pending_clarifications(spark):
    texts = ["안녕", "하세요", "표", "음", "검증", "그", "현장", "점검"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    got = [(r.judged, r.pending) for r in G.clarify_fold(df).orderBy("turn").collect()]
    want, waiting = [], None
    for t in texts:
        judged = f"{waiting} {t}" if waiting else t
        known = any(w in judged for w in ("표", "검증", "점검"))
        waiting = None if known else t
        want.append((judged, not known))
    assert got == want


def test_rolling_speed_with_small_slices_equals_brute_force(spark):
    import datetime as dt
    import random

    rng = random.Random(1)
    start = dt.datetime(2026, 1, 1)
    rows = [(i % 3 if i % 2 else 0, start + dt.timedelta(seconds=rng.randint(0, 900)), i, float(rng.randint(0, 50)), 1e9) for i in range(400)]
    df = spark.createDataFrame(rows, "u int, ts timestamp, id long, eval_count double, eval_ns double")
    want = {}
    for u in {r[0] for r in rows}:
        speeds = []
        for r in sorted((r for r in rows if r[0] == u and r[3] > 0), key=lambda r: (r[1], r[2])):
            speeds = (speeds + [r[3]])[-20:]
            want[r[2]] = round(100 / (sum(speeds) / len(speeds)) * 0.8, 6)
    for seconds in (7, 60, 100000):
        got = {r.id: round(r.low, 6) for r in B.rolling_speed(df, "u", "ts", "id", 100, seconds).collect()}
        assert got == want


def test_lines_and_clean_up(spark):
    df = spark.createDataFrame([(1, "① 이름: 값"), (1, "그냥 줄"), (2, "하나"), (2, "둘")], "g int, text string")
    got = sorted((r.g, r.bullet, r.title, r.description) for r in B.split_lines(df, "g").collect())
    assert got == [(1, "", "그냥 줄", ""), (1, "①", "이름", "값"), (2, "", "둘", ""), (2, "", "하나", "")]
    t = spark.createDataFrame([("**굵게** __밑줄__ `코드`\n## 제목\n* 남은  별*",)], "t string")
    assert t.select(B.clean_markup(F.col("t"))).collect()[0][0] == "굵게 밑줄 코드\n제목\n 남은 별"
    t = spark.createDataFrame([("```json\n수정안: 본문\n```",)], "t string")
    assert t.select(B.clean_answer(F.col("t"))).collect()[0][0] == "본문"
