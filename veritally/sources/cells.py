"""Sheets as long cells: one row per filled cell, typed, whatever reader produced them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veritally.functions import fixed as X
from veritally.functions.text import canonical_number, column_letters, plain_digits, strip

CELL_COLUMNS = ["source_file", "sheet", "row", "col", "kind", "v_num", "v_date", "v_str"]


def cell_raw(c: Column | None = None) -> Column:
    """The cell as text: canonical number, ISO date or the string itself."""
    get = (lambda name: F.col(name)) if c is None else (lambda name: c[name])
    return (
        F.when(get("kind") == "num", F.coalesce(get("v_str"), canonical_number(get("v_num"))))
        .when(get("kind") == "date", get("v_date").cast("string"))
        .otherwise(get("v_str"))
    )


def address(col: Column, row: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def unpivot_cells(wide: DataFrame, source_file: Column, sheet: Column, row: Column,
                  columns: list[str]) -> DataFrame:
    """Wide typed rows to long cells, one map-only pass; NULL cells are not emitted.

    v_num is what sums are made of. A number that does not fit there with all its digits keeps
    them in v_str, which is what is shown and compared; v_num is then rounded, or NULL.
    """
    kinds = {f.name: f.dataType for f in wide.schema.fields}

    def cell(i: int, name: str) -> Column:
        t, c = kinds[name], F.col(name)
        number = isinstance(t, T.NumericType)
        date = isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
        kind = "num" if number else "date" if date else "bool" if isinstance(t, T.BooleanType) else "str"
        exact = c.cast("string") if isinstance(t, (T.DoubleType, T.FloatType)) else c
        value = exact.try_cast("decimal(38,10)") if number else F.lit(None).cast("decimal(38,10)")
        text = F.lit(None).cast("string")
        if kind in ("str", "bool"):
            text = c.cast("string")
        elif number and not (isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale <= 10 and t.precision - t.scale <= 28):
            plain = plain_digits(c.cast("string"))
            text = F.when(~plain.eqNullSafe(canonical_number(value)), plain)
        return F.struct(
            F.lit(i).alias("col"), F.lit(kind).alias("kind"), value.alias("v_num"),
            (c.cast("date") if date else F.lit(None).cast("date")).alias("v_date"), text.alias("v_str"),
            c.isNotNull().alias("filled"),
        )

    cells = F.array(*[cell(i, name) for i, name in enumerate(columns, 1)])
    return (
        wide.select(source_file.alias("source_file"), sheet.alias("sheet"),
                    row.cast("int").alias("row"), F.inline(cells))
        .where("filled").select(*CELL_COLUMNS)
    )


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One row per sheet row with its cells in column order (a sheet is at most 16,384 wide)."""
    return cells.groupBy("source_file", "sheet", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "kind", "v_num", "v_date", "v_str"))).alias("cells")
    )


def sheet_text(cells: DataFrame, limit: int = X.SHEET_ROW_LIMIT) -> DataFrame:
    """A sheet as text lines, `limit` rows at most and then a line that says how many are left.

    Only rows up to the limit are gathered, so the text of one sheet stays bounded.
    """
    shown = cells.where((F.col("row") <= limit) & ~((F.col("kind") == "str") & (strip(F.col("v_str")) == "")))
    lines = sheet_rows(shown).select(
        "source_file", "sheet", "row", F.array_join(F.transform("cells", cell_raw), " | ").alias("line")
    )
    last = cells.groupBy("source_file", "sheet").agg(F.max("row").alias("last_row"))
    text = lines.groupBy("source_file", "sheet").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    note = F.when(
        F.col("last_row") > limit,
        F.concat(F.lit("… (이하 "), (F.col("last_row") - limit).cast("string"), F.lit("행 생략)")),
    )
    # a sheet whose first rows are all blank still has its note
    return last.join(text, ["source_file", "sheet"], "left").select(
        "source_file", "sheet", F.concat_ws("\n", "text", note).alias("text")
    ).where("text <> ''")


def preview_rows(cells: DataFrame) -> DataFrame:
    """The first rows and columns of each sheet, long cells cut, and a marker row if more exists."""
    text = cell_raw()
    text = F.when(
        F.length(text) > X.PREVIEW_CELL_CHARS,
        F.concat(F.substring(text, F.lit(1), F.lit(X.PREVIEW_CELL_CHARS - 1)), F.lit("…")),
    ).otherwise(text)
    inside = cells.where((F.col("row") <= X.PREVIEW_ROWS) & (F.col("col") <= X.PREVIEW_COLS))
    top = inside.select("source_file", "sheet", "row", "col", text.alias("text"))
    size = cells.groupBy("source_file", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    marker = size.where((F.col("rows") > X.PREVIEW_ROWS) | (F.col("cols") > X.PREVIEW_COLS)).select(
        "source_file", "sheet", F.lit(X.PREVIEW_ROWS + 1).alias("row"), F.lit(1).alias("col"),
        F.format_string("... 더 있음 (전체 %d행 x %d열)", "rows", "cols").alias("text"),
    )
    return top.unionByName(marker)
