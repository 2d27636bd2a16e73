"""Fact pools: labelled values from sheets, derived totals and conflicts between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritally.functions import fixed as X
from veritally.functions.text import blank, canonical_number, rx, strip
from veritally.operators import mentions as M
from veritally.operators.identity import header_year
from veritally.sources.cells import address, cell_raw, sheet_rows

SHEET = ["source_file", "sheet"]
#: Stands for the row itself among the columns of its numbers.
ROW_MARK = -2147483648
POOL_COLUMNS = [
    "ord", "type", "normalized", "raw", "source_file", "location", "label", "row_label",
    "column_header", "from_text",
]


def placed(cells: DataFrame) -> DataFrame:
    """Cells that have a place.  The others are dropped here and not by one of the joins of rows with
    their headers, so that all that is asked of the rows reads the same shuffle."""
    return cells.where("source_file is not null and sheet is not null and row is not null")


def header_rows(rows: DataFrame) -> DataFrame:
    """First row with two or more filled cells, else row 1: source_file, sheet, header_row."""
    return rows.groupBy(*SHEET).agg(_header_row(F.size("cells")).alias("header_row"))


def _header_row(n_cells: Column) -> Column:
    return F.coalesce(F.min(F.when(n_cells >= 2, F.col("row"))), F.lit(1))


def header_cells(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The header row of each sheet with the wide-header test: one row per sheet."""
    top = rows.join(headers.hint("shuffle_hash"), SHEET).where(F.col("row") == F.col("header_row"))
    filled = F.filter("cells", lambda c: ~blank(cell_raw(c)))
    low, high = X.WIDE_HEADER_YEARS

    def is_year(c: Column) -> Column:
        number = (c["kind"] == "num") & (c["v_num"] == F.floor(c["v_num"])) & c["v_num"].between(low, high)
        return number | ((c["kind"] != "bool") & header_year(cell_raw(c)).isNotNull())

    wide = (F.size(filled) >= X.WIDE_HEADER_MIN_CELLS) & F.exists(filled, is_year)
    names = F.map_from_entries(F.transform(filled, lambda c: F.struct(c["col"], strip(cell_raw(c)))))
    all_names = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["col"], cell_raw(c))))
    return top.select(
        *SHEET, "header_row", F.size(filled).alias("n_filled"), wide.alias("wide"),
        names.alias("headers"), all_names.alias("names"),
        (F.size(F.array_distinct(F.map_values(all_names))) < F.size("cells")).alias("same_names"),
    )


def data_rows(cells: DataFrame) -> DataFrame:
    """Data rows with their label, their numbers and the header of their sheet.

    The cells are shuffled once, by sheet row, and the header row is picked where its cells already
    lie.  What is derived from a row's cells is there before the rows meet their header, so callers
    that need no cells shuffle none.  The header side has one row per sheet, so a sheet that holds most
    rows is split by the adaptive skew join (or never shuffled, when the headers fit a broadcast).
    """
    rows = sheet_rows(placed(cells))
    headers = header_cells(rows, header_rows(rows))
    texts = F.filter("cells", lambda c: (c["kind"] == "str") & ~blank(c["v_str"]))
    label = _label(texts)
    numbers = F.transform(F.filter("cells", lambda c: c["kind"] == "num"), lambda c: F.struct(c["col"], c["v_num"]))
    derived = rows.select(*SHEET, "row", "cells", label.alias("label"), numbers.alias("numbers"))
    return derived.join(headers, SHEET).where(F.col("row") > F.col("header_row"))


def _label(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda c: strip(c["v_str"])), " ")


def row_labels(cells: DataFrame) -> DataFrame:
    """Labels of data_rows(); of a row only the texts are shuffled, and places for its other cells."""
    text = F.when((F.col("kind") == "str") & ~blank(F.col("v_str")), F.struct("col", "v_num", "v_date", "v_str"))
    rows = placed(cells).groupBy(*SHEET, "row").agg(F.collect_list(F.struct(text.alias("text"))).alias("cells"))
    n_cells = F.size("cells")
    # a sheet whose header row is not there has no data rows
    headers = rows.groupBy(*SHEET).agg(
        _header_row(n_cells).alias("header_row"), F.max((n_cells >= 2) | (F.col("row") == 1)).alias("there"))
    labels = rows.select(*SHEET, "row", _label(F.array_sort(F.array_compact("cells.text"))).alias("label"))
    return labels.join(headers.where("there"), SHEET).where(F.col("row") > F.col("header_row")).select(*SHEET, "row", "label")


def column_totals(data: DataFrame) -> DataFrame:
    """Columns that are numeric in every kept row of their sheet: total and number of rows.

    A kept row has at least one number.  Being numeric in every kept row implies being in the
    first one.  Of columns with the same name the last one of a row counts.  The kept rows are
    counted as a column of their own, in the same pass.
    """
    kept = data.where(F.size("numbers") > 0)
    last = F.transform(
        F.filter("_named", lambda a: ~F.exists("_named", lambda b: b["name"].eqNullSafe(a["name"]) & (b["i"] > a["i"]))),
        lambda a: a["c"],
    )
    columns = F.col("numbers.col")
    plain = ~F.col("same_names") & (F.size(F.array_distinct(columns)) == F.size("numbers")) & (
        F.size(F.array_except(columns, F.map_keys("names"))) == 0)
    named = F.when(~plain, F.transform("numbers", lambda c, i: F.struct(c.alias("c"), F.element_at("names", c["col"]).alias("name"), i.alias("i"))))
    row = F.struct(F.lit(ROW_MARK).alias("col"), F.lit(None).cast("decimal(38,10)").alias("v_num"))
    cells = F.concat(F.when(plain, F.col("numbers")).otherwise(last), F.array(row))
    values = kept.withColumn("_named", named).select(*SHEET, "wide", "names", F.inline(cells))
    is_column = F.col("col").isNull() | (F.col("col") != ROW_MARK)
    values = values.select(*SHEET, "wide", is_column.alias("is_column"), F.element_at("names", F.col("col")).alias("name"), "v_num")
    totals = values.groupBy(*SHEET, "wide", "is_column", "name").agg(
        F.try_sum("v_num").alias("total"), F.count("*").alias("n_rows")
    )
    n_kept = F.max(F.when(~F.col("is_column"), F.col("n_rows"))).over(Window.partitionBy(*SHEET))
    # a sum that 38 digits do not hold is no total
    return totals.withColumn("_kept", n_kept).where("is_column and n_rows = _kept and total is not null").drop("is_column", "_kept")


def column_sums(data: DataFrame) -> DataFrame:
    totals = column_totals(data)
    name = F.coalesce("name", F.lit("None"))
    header = F.when(F.col("wide") & ~blank(F.col("name")), strip(F.col("name"))).otherwise("")
    return totals.select(
        F.struct(
            "source_file", "sheet", F.lit(2147483647).alias("row"), F.lit(0).alias("col"),
            name.alias("name"), F.lit(0).alias("s"),
        ).alias("ord"),
        F.lit("amount").alias("type"), canonical_number(F.col("total")).alias("normalized"),
        F.concat(name, F.lit(" " + X.SUM_SUFFIX)).alias("raw"), "source_file",
        F.concat("sheet", F.lit("!"), name, F.lit(f"({X.SUM_SUFFIX})")).alias("location"),
        F.lit("").alias("label"),
        F.when(header != "", F.lit(X.SUM_SUFFIX)).otherwise("").alias("row_label"),
        header.alias("column_header"), F.lit(False).alias("from_text"),
    )


def rounded_ratio(rows: DataFrame, num: str, den: str, shift: int, places: int, name: str) -> DataFrame:
    """rows with name = num / den * 10^shift, half-even at `places`, exactly; NULL if it cannot be exact.

    Quotient and remainder, then a digit at a time from the remainder: no step rounds, as no value needs
    more digits than its type has. num and den may have ten decimals and 25 digits before them.
    """
    narrow, wide = "decimal(35,10)", "decimal(37,10)"
    a, b = F.abs(F.col(num)).try_cast(narrow), F.abs(F.col(den)).try_cast(narrow)
    out = rows.withColumn("_r", F.struct(a.alias("a"), b.alias("b"), ((F.col(num) < 0) != (F.col(den) < 0)).alias("minus")))
    of = F.col("_r.b")

    def split(value: Column, units: Column) -> Column:
        """What is whole of value / b, behind `units`, and the remainder."""
        rest = (value % of).cast(narrow)
        whole = F.try_divide(value.cast(wide) - rest.cast(wide), of.cast(wide)).cast("decimal(30,0)")
        return F.struct((units * 10 + whole).try_cast("decimal(34,0)").alias("units"), rest.alias("rest"))

    none = F.lit(0).cast("decimal(34,0)")
    digits = F.aggregate(F.sequence(F.lit(1), F.lit(shift + places)), split(F.col("_r.a"), none),
                         lambda acc, _: split((acc["rest"] * F.lit(10).cast("decimal(2,0)")).cast(wide), acc["units"]))
    out = out.withColumn("_d", F.when(F.col("_r.a").isNotNull() & (of != 0), digits))
    twice = (F.col("_d.rest") * F.lit(2).cast("decimal(1,0)")).cast(wide)
    up = (twice > of) | ((twice == of) & (F.col("_d.units") % 2 == 1))
    units = F.col("_d.units") + F.when(up, 1).otherwise(0)
    value = F.when(F.col("_r.minus"), -units).otherwise(units).try_cast("decimal(34,0)") * F.lit(f"1e-{places}").cast(f"decimal({places},{places})")
    return out.withColumn(name, value).drop("_r", "_d")


def column_averages(data: DataFrame, column: str) -> DataFrame:
    totals = column_totals(data).where(F.col("name") == column)
    totals = rounded_ratio(totals.withColumn("n_rows", F.col("n_rows").cast("decimal(20,0)")), "total", "n_rows", 0, 2, "mean").where("mean is not null")
    return totals.select(*SHEET, canonical_number(F.col("mean")).alias("normalized"),
                         F.lit(f"{column} {X.AVERAGE_SUFFIX}").alias("raw"),
                         F.concat("sheet", F.lit(f"!{column}({X.AVERAGE_SUFFIX})")).alias("location"))


def growth_rates(data: DataFrame, before: str, after: str) -> DataFrame:
    """(after - before) / before in percent, two decimals half-even; nothing if before sums to 0."""
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("total")))
    both = column_totals(data).where(F.col("name").isin(before, after)).groupBy(*SHEET).agg(
        pick(before).alias("a"), pick(after).alias("b")
    ).where("a is not null and b is not null and a <> 0")
    # what 37 digits do not hold gives no row
    both = both.withColumn("_more", F.col("b").try_cast("decimal(36,10)") - F.col("a").try_cast("decimal(36,10)"))
    both = rounded_ratio(both, "_more", "a", 2, 2, "rate").where("rate is not null")
    return both.select(*SHEET, canonical_number(F.col("rate")).alias("normalized"),
                       F.lit(f"{before}→{after} {X.GROWTH_SUFFIX}").alias("raw"),
                       F.concat("sheet", F.lit(f"!{before}->{after}({X.GROWTH_SUFFIX})")).alias("location"))


def fact_pool(cells: DataFrame, default_year: int = 2026) -> DataFrame:
    """Numbers, dates and values found in string cells, with labels, plus the column sums."""
    data = data_rows(cells)
    identity = [
        "label",
        F.when(F.col("wide"), F.col("label")).otherwise("").alias("row_label"),
        F.when(F.col("wide"), F.coalesce(F.element_at("headers", F.col("col")), F.lit(""))).otherwise("").alias("column_header"),
    ]
    flat = data.select(*SHEET, "row", "label", "wide", "headers", F.inline("cells"))
    place = F.struct("source_file", "sheet", "row", "col", F.lit("").alias("name"), F.lit(0).alias("s"))
    location = F.concat("sheet", F.lit("!"), address(F.col("col"), F.col("row")))
    typed = flat.where(F.col("kind").isin("num", "date")).select(
        place.alias("ord"),
        F.when(F.col("kind") == "num", "amount").otherwise("date").alias("type"),
        cell_raw().alias("normalized"), cell_raw().alias("raw"), "source_file",
        location.alias("location"), *identity, F.lit(False).alias("from_text"),
    )
    ids = [*SHEET, "row", "col", "label", "wide", "column_header"]
    texts = flat.where((F.col("kind") == "str") & F.col("v_str").rlike(rx(r"\d"))).select(
        *SHEET, "row", "col", "label", "wide", identity[2], "v_str"
    )
    found = M.extract_all(texts, ids, "v_str", default_year)
    rank = F.array_position(F.array(*[F.lit(t) for t in M.VALUE_TYPES]), F.col("type"))
    from_text = found.select(
        F.struct("source_file", "sheet", "row", "col", rank.cast("string").alias("name"), "s").alias("ord"),
        "type", "normalized", "raw", "source_file", location.alias("location"), "label",
        F.when(F.col("wide"), F.col("label")).otherwise("").alias("row_label"), "column_header",
        F.lit(True).alias("from_text"),
    )
    sums = column_sums(data)
    return typed.unionByName(from_text).unionByName(sums).select(*POOL_COLUMNS)


def source_conflicts(pool: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cell addresses whose last values differ between files: one row per file and value.

    The long form keeps a much-used address from being gathered into one row.
    """
    keys = list(keys or [])
    cell = F.substring_index("location", "!", -1)
    one_mark = F.length("location") - F.length(F.replace("location", F.lit("!"), F.lit(""))) == 1
    real = pool.where(one_mark & cell.rlike(X.CELL_ADDRESS))
    place = [*keys, "location", "type"]
    last = real.groupBy(*place, "source_file").agg(F.max_by("normalized", "ord").alias("normalized"))
    differing = last.groupBy(*place).agg(
        F.min("normalized").alias("_low"), F.max("normalized").alias("_high")
    ).where("_low <> _high").select(*place)
    return last.join(differing, place, "left_semi")
