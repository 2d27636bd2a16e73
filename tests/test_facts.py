import random
import re
from datetime import date
from decimal import Decimal, localcontext
from fractions import Fraction

from veritally.operators import facts as P
from veritally.operators import identity as I
from veritally.sources import cells as C

SCHEMA = "source_file string, sheet string, row int, col int, kind string, v_num decimal(38,10), v_date date, v_str string"


def sheet(spark, grid, name="a.xlsx"):
    rows = []
    for r, line in enumerate(grid, 1):
        for c, v in enumerate(line, 1):
            if v is None:
                continue
            kind = "date" if isinstance(v, date) else "str" if isinstance(v, str) else "num"
            rows.append((name, "S", r, c, kind, Decimal(str(v)) if kind == "num" else None,
                         v if kind == "date" else None, v if kind == "str" else None))
    return spark.createDataFrame(rows, SCHEMA)


def test_wide_sheet(spark):
    cells = sheet(spark, [["실적"], [], ["구분", 2024, "'25"], ["점검", 10, 20], ["제재", 1.5, "3건"]])
    pool = {(r.location, r.normalized, r.label, r.row_label, r.column_header, r.from_text)
            for r in P.fact_pool(cells).collect()}
    assert pool == {
        ("S!B4", "10", "점검", "점검", "2024", False), ("S!C4", "20", "점검", "점검", "'25", False),
        ("S!B5", "1.5", "제재 3건", "제재 3건", "2024", False), ("S!C5", "3", "제재 3건", "제재 3건", "'25", True),
        ("S!2024(합계)", "11.5", "", "합계", "2024", False),
    }


def test_two_columns_are_not_wide(spark):
    cells = sheet(spark, [["예산", "인원"], [500000, 10], [300000, 20]])
    got = {(r.location, r.normalized, r.column_header) for r in P.fact_pool(cells).collect()}
    assert ("S!예산(합계)", "800000", "") in got and ("S!A2", "500000", "") in got


def test_dates_and_duplicate_headers(spark):
    cells = sheet(spark, [["a", "a", "일"], [1, 2, date(2026, 9, 7)], [3, None, None]])
    pool = P.fact_pool(cells).collect()
    assert {r.normalized for r in pool if r.location == "S!a(합계)"} == {"5"}
    assert {r.normalized for r in pool if r.type == "date"} == {"2026-09-07"}


def test_growth_and_average_round_half_even(spark):
    data = P.data_rows(sheet(spark, [["x", "y"], [8, 8.5], [8, 8.5]]))
    assert [r.normalized for r in P.growth_rates(data, "x", "y").collect()] == ["6.25"]
    data = P.data_rows(sheet(spark, [["x", "y"], [0.01, 1], [0.04, 1]]))
    assert [r.normalized for r in P.column_averages(data, "x").collect()] == ["0.02"]


def test_ratios_are_exact(spark):
    rng = random.Random(8)
    pairs = [("123450001", "1000000000"), ("1", "3"), ("-1", "3"), ("0.0000000001", "9"), ("1" + "0" * 24, "7"), ("5", "1000"), ("15", "1000"), ("-25", "1000"), ("0", "5"), ("9" * 24, "0.0000000001")]
    for _ in range(300):
        big = rng.choice([10, 10 ** 6, 10 ** 15, 10 ** 22])
        num, den = rng.randrange(-big, big), rng.choice([8, 16, 1000, rng.randrange(1, big)]) * rng.choice([1, -1])
        pairs.append((str(Decimal(num).scaleb(-rng.randint(0, 10))), str(Decimal(den).scaleb(-rng.randint(0, 6)))))
    df = spark.createDataFrame([(i, Decimal(a), Decimal(b)) for i, (a, b) in enumerate(pairs)], "i int, a decimal(38,10), b decimal(38,10)")
    got = {r["i"]: r["x"] for r in P.rounded_ratio(df, "a", "b", 2, 2, "x").collect()}
    with localcontext() as c:
        c.prec = 100
        for i, (a, b) in enumerate(pairs):
            want = Fraction(a) / Fraction(b) * 10 ** 4
            low, rest = divmod(abs(want).numerator, abs(want).denominator)
            low += 2 * rest > abs(want).denominator or (2 * rest == abs(want).denominator and low % 2 == 1)
            want = Decimal(low if want >= 0 else -low).scaleb(-2)
            assert got[i] == want or (got[i] is None and abs(want) > 10 ** 30), (a, b)
    none = spark.createDataFrame([(Decimal("1"), Decimal("0")), (None, Decimal("1")), (Decimal("9" * 28), Decimal("3"))], "a decimal(38,10), b decimal(38,10)")
    assert [r["x"] for r in P.rounded_ratio(none, "a", "b", 0, 2, "x").collect()] == [None] * 3


def test_growth_of_large_sums_and_sums_beyond_the_type(spark):
    data = P.data_rows(sheet(spark, [["x", "y"], [10 ** 9, 1_123_450_001]]))
    assert [r.normalized for r in P.growth_rates(data, "x", "y").collect()] == ["12.35"]
    data = P.data_rows(sheet(spark, [["x", "y"], [9 * 10 ** 27, 1], [9 * 10 ** 27, 1]]))
    assert {r.raw.split()[0] for r in P.column_sums(data).collect()} == {"y"}  # the other sum has no digits left
    assert P.growth_rates(data, "x", "y").collect() == [] and P.column_averages(data, "x").collect() == []


def test_conflicts_use_last_value_and_real_addresses(spark):
    rows = [("a", "S!A2", "amount", 1, "1"), ("a", "S!A2", "amount", 2, "2"), ("b", "S!A2", "amount", 1, "2"),
            ("a", "S!A3", "amount", 1, "1"), ("b", "S!A3", "amount", 1, "2"), ("a", "S!합(합계)", "amount", 1, "1"),
            ("b", "S!합(합계)", "amount", 1, "9")]
    pool = spark.createDataFrame(rows, "source_file string, location string, type string, ord int, normalized string")
    got = {(r.location, r.source_file, r.normalized) for r in P.source_conflicts(pool).collect()}
    assert got == {("S!A3", "a", "1"), ("S!A3", "b", "2")}


def test_column_identity_table(spark):
    want = {
        "2024년": ("2024", ""), "2024년도": ("2024", ""), "2024년도 목표": ("2024", "목표"), "목표": (None, "목표"),
        "120245": (None, "120245"), "'24년": ("2024", ""), "('24)": ("2024", ""), "('24년)": ("2024", ""),
        "’24년": ("2024", ""), "'24년 목표": ("2024", "목표"), "２０２４년 목표": ("2024", "목표"),
        "'2024년": ("2024", ""), "'243": (None, "'243"),
    }
    heads = spark.createDataFrame([(h,) for h in want], "header string")
    assert {r.header: (r.year, r.modifier) for r in I.column_identity(heads).collect()} == want


def test_cell_addresses(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1,), (26,), (27,), (52,), (702,), (703,), (16384,)], "c int")
    got = [r[0] for r in df.select(C.column_letters(F.col("c"))).collect()]
    assert got == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]


def test_large_and_small_totals_keep_their_digits(spark):
    rows = [("f", s, r, c, k, Decimal(v) if k == "num" else None, None, v if k == "str" else None)
            for s, a, b in (("big", "1000000000000000000000", "1500000000000000000000"), ("small", "0.00001", "0.00003"))
            for r, c, k, v in ((1, 1, "str", "이름"), (1, 2, "str", "a"), (1, 3, "str", "b"), (2, 1, "str", "x"), (2, 2, "num", a), (2, 3, "num", b))]
    data = P.data_rows(spark.createDataFrame(rows, SCHEMA))
    assert {r["sheet"]: r["normalized"] for r in P.growth_rates(data, "a", "b").collect()} == {"big": "50", "small": "200"}
    assert {r["sheet"]: r["normalized"] for r in P.column_averages(data, "b").collect()} == {"big": "1500000000000000000000", "small": "0"}


def test_totals_of_equal_missing_and_doubled_columns(spark):
    """Names that come twice, columns without a name and cells that come twice: the last of a row counts."""
    rng = random.Random(3)
    head = {1: "x", 2: "y", 3: "x", 5: "z"}
    rows = [("f", "s", 1, c, "str", None, None, n) for c, n in head.items()]
    rows += [("f", "t", 1, c, "str", None, None, n) for c, n in {1: "x", 2: "y"}.items()]
    want, kept = {}, {"s": 0, "t": 0}
    for sheet, row in [("s", r) for r in range(2, 60)] + [("t", r) for r in range(2, 9)]:
        columns = (1, 2) if sheet == "t" else rng.choice([(1, 2, 3, 4, 6), (1, 2, 4, 5), (2, 3, 6), (2, 2, 1, 4), (2, 3, 3, 6), ()])
        filled = sorted((c, Decimal(rng.randrange(9))) for c in columns)
        rows += [("f", sheet, row, c, "num", v, None, None) for c, v in filled] + [("f", sheet, row, 9, "str", None, None, "a")]
        kept[sheet] += bool(filled)
        for name, v in {(head.get(c) if sheet == "s" or c < 3 else None): v for c, v in filled}.items():
            total, n = want.get((sheet, name), (0, 0))
            want[sheet, name] = (total + v, n + 1)
    rows += [("f", None, 1, 1, "num", Decimal(1), None, None), (None, "s", 3, 1, "num", Decimal(1), None, None), ("f", "s", None, 1, "num", Decimal(1), None, None)]
    got = P.column_totals(P.data_rows(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {(r.sheet, r.name): (r.total, r.n_rows) for r in got} == {k: v for k, v in want.items() if v[1] == kept[k[0]]}
    assert {r.name for r in got if r.sheet == "s"} == {"x", "y", None}


def test_a_sheet_without_its_header_row_has_no_labels(spark):
    rows = [("f", "a", r, 1, "str", None, None, f" t{r} ") for r in (2, 3)]  # no row of two cells, no row 1
    rows += [("f", "b", r, 1, "str", None, None, f" t{r} ") for r in (1, 2)]
    rows += [("f", "c", 2, c, "num", Decimal(c), None, None) for c in (1, 2)] + [("f", "c", 3, 3, "str", None, None, " "), ("f", "c", 4, 2, "str", None, None, "y"), ("f", "c", 4, 1, "str", None, None, "x ")]
    cells = spark.createDataFrame(rows, SCHEMA)
    want = {("b", 2): "t2", ("c", 3): "", ("c", 4): "x y"}
    for labels in (P.row_labels(cells), P.data_rows(cells)):
        assert {(r.sheet, r.row): r.label for r in labels.collect()} == want


def shuffles(spark, df):
    """What each shuffle of the plan moves, but for those that read another's."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "Reused" not in line]


def test_the_cells_of_a_sheet_are_shuffled_once(spark):
    cells = spark.createDataFrame([("f", "s", 1, 1, "str", None, None, "x")], SCHEMA)
    by_row = lambda df: [s for s in shuffles(spark, df) if re.search(r"partitioning\(source_file#\d+, sheet#\d+, row#\d+,", s)]
    assert len(by_row(P.row_labels(cells))) == 1
    assert len(by_row(P.column_sums(P.data_rows(cells)))) == 1
