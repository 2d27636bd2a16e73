"""Reshaping: label/value pairs, line splitting, weekly merge, chart series, clean-up, speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from veritally.functions import fixed as X
from veritally.functions.text import blank, extension, rstrip_chars, rx, strip, unix_lines
from veritally.sources.cells import cell_raw


# --- text clean-up ------------------------------------------------------------------
def clean_markup(text: Column) -> Column:
    for pattern, put in (
        (r"\*\*(.*?)\*\*", "$1"), (r"__(.*?)__", "$1"), (r"`(.*?)`", "$1"),
        (r"(?m)^#+\s*", ""), (r"\*+", ""), (r"[ \t]{2,}", " "),
    ):
        text = F.regexp_replace(text, rx(pattern), put)
    return strip(text)


def clean_answer(text: Column) -> Column:
    t = strip(text)
    t = F.regexp_replace(t, rx(r"\A```[a-zA-Z]*\s*"), "")
    # the closing fence is looked for at the end only, from the right
    bare = F.rtrim(t, F.lit(X.STRIP_CHARS))
    t = F.when(F.endswith(bare, F.lit("```")), F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - 3), F.lit(X.STRIP_CHARS))).otherwise(t)
    t = F.regexp_replace(t, rx(r"\A(결과|수정안|수정 결과|고친 본문)\s*[:：]\s*"), "")
    return strip(t)


def suspicious_spans(answers: DataFrame, ids: list[str], text: str = "text", answer: str = "answer") -> DataFrame:
    """`a -> b` lines of an answer whose `a` occurs in the text: s, e, original, suggestion."""
    lines = answers.select(*ids, text, F.explode(F.split(unix_lines(clean_markup(F.col(answer))), "\n")).alias("_l"))
    line = strip(F.ltrim(strip(F.col("_l")), F.lit("- ")))
    cut = F.instr(line, "->")
    rows = lines.where(cut > 0).select(
        *ids, text, strip(F.substring(line, F.lit(1), cut - 1)).alias("original"),
        strip(F.substring(line, cut + 2, F.length(line))).alias("suggestion"))
    at = F.position(F.col("original"), F.col(text)).cast("int")
    return rows.withColumn("s", at - 1).where("s >= 0").select(
        *ids, "s", (F.col("s") + F.length("original")).alias("e"), "original", "suggestion")


def unsupported_numbers(proposals: DataFrame, sources: DataFrame, ids: list[str]) -> DataFrame:
    """Numbers of a proposal that none of its sources holds: one row per number.

    Numbers are made distinct per text before the shuffle; sources of one proposal never meet
    in one row.
    """
    numbers = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(rx(r"(\d[\d,]*(?:\.\d+)?)")), F.lit(1))))
    said = proposals.select(*ids, numbers("text").alias("number")).distinct()
    known = sources.select(*ids, numbers("text").alias("number")).distinct()
    return said.join(known, [*ids, "number"], "left_anti")


# --- lines ----------------------------------------------------------------------------
def split_lines(lines: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Adds bullet, title, description; a group without any bullet or description is one column."""
    raw = strip(F.col(text))
    bullet = F.regexp_extract(raw, rx(X.BULLET), 1)
    rest = F.regexp_replace(raw, rx(X.BULLET), "")
    colon = F.least(F.nullif(F.instr(rest, ":"), F.lit(0)), F.nullif(F.instr(rest, "："), F.lit(0)))
    title = F.when(colon.isNull(), strip(rest)).otherwise(strip(F.substring(rest, F.lit(1), colon - 1)))
    about = F.when(colon.isNull(), F.lit("")).otherwise(strip(F.substring(rest, colon + 1, F.length(rest))))
    rows = lines.where(raw != "").withColumn("bullet", bullet).withColumn("title", title).withColumn("description", about)
    # per group a flag by partial aggregation, not a window over the lines of a large group
    flags = rows.groupBy(group).agg(F.bool_or((F.col("bullet") != "") | (F.col("description") != "")).alias("structured"))
    return rows.join(flags, group).withColumn(
        "title", F.when(F.col("structured"), F.col("title")).otherwise(raw))


def number_prefix(style: Column, n: Column) -> Column:
    number = n.cast("string")
    circled = F.when(n.between(1, 20), F.substring(F.lit("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"), n, F.lit(1)))
    return (
        F.when(style == "arabic_dot", F.concat(number, F.lit(". ")))
        .when(style == "arabic_paren", F.concat(number, F.lit(") ")))
        .when(style == "double_paren", F.concat(F.lit("("), number, F.lit(") ")))
        .when(style == "circled", F.concat(F.coalesce(circled, F.concat(F.lit("("), number, F.lit(")"))), F.lit(" ")))
    )


def number_lines(docs: DataFrame, doc: str, style: str, text: str = "text") -> DataFrame:
    """Non-blank lines numbered from 1 in order; the lines of one text never leave their row."""
    lines = F.filter(F.transform(F.split(unix_lines(F.col(text)), "\n"), strip), lambda l: l != "")
    rows = docs.select(doc, style, F.posexplode(lines).alias("_i", "content"))
    n = F.col("_i") + 1
    return rows.select(doc, n.alias("n"), F.concat(number_prefix(F.col(style), n), F.col("content")).alias("line"))


# --- label and value pairs ------------------------------------------------------------
def label_pairs(cells: DataFrame) -> DataFrame:
    """label -> value of the right neighbour; of equal labels in a sheet the last one counts.

    A neighbour is the same row and the next column: an equi-join would do, but a window over the
    cells of one row needs a single shuffle.
    """
    row = Window.partitionBy("source_file", "sheet", "row").orderBy("col")
    rows = cells.withColumn("value", cell_raw()).withColumn("_v", F.lead(F.struct("col", "value", "kind")).over(row))
    found = rows.where((F.col("kind") == "str") & ~blank(F.col("v_str")) & (F.col("_v.col") == F.col("col") + 1))
    label = rstrip_chars(strip(F.col("v_str")), ":：")
    return found.groupBy("source_file", "sheet", label.alias("label")).agg(
        F.max(F.struct("row", "col", "_v")).alias("_l"), F.min(F.struct("row", "col")).alias("first_at")
    ).select("source_file", "sheet", "label", F.col("_l._v.value").alias("value"),
             F.col("_l._v.kind").alias("kind"), "first_at")


def thousands(number: Column) -> Column:
    """A canonical number with separators in its whole part."""
    whole = F.substring_index(number, ".", 1)
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ",")
    return F.when(F.instr(number, ".") > 0, F.concat(grouped, F.lit("."), F.substring_index(number, ".", -1))).otherwise(grouped)


def draft_text(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One draft line per key from its (bounded) label/value pairs, in first-seen order."""
    value = F.when(F.col("kind") == "num", thousands(F.col("value"))).otherwise(F.col("value"))
    part = F.concat("label", F.lit("은(는) "), value)
    return pairs.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_at", part.alias("part")))), lambda x: x["part"]), ", ").alias("draft"))


# --- weekly reports ---------------------------------------------------------------------
def weekly_lines(styled: DataFrame) -> DataFrame:
    """Blue lines of the two week columns of readable files; blank or unknown colours are dropped."""
    blue = (F.col("b") >= X.BLUE_MIN) & (F.col("b") - F.greatest("r", "g") >= X.BLUE_LEAD)
    return styled.where(extension(F.col("path")).isin(*X.WEEKLY_EXTENSIONS) & F.col("header").isin(X.THIS_WEEK, X.NEXT_WEEK)
                        & (F.col("text") != "") & blue)


def weekly_merge(styled: DataFrame) -> DataFrame:
    """(path, status, this_week, next_week): how many lines each file gives, and its status."""
    blue = weekly_lines(styled)
    n = lambda h: F.count(F.when(F.col("header") == h, 1))
    counts = blue.groupBy("path").agg(n(X.THIS_WEEK).alias("this_week"), n(X.NEXT_WEEK).alias("next_week"))
    files = styled.select("path").distinct()
    status = (
        F.when(~extension(F.col("path")).isin(*X.WEEKLY_EXTENSIONS), "skipped")
        .when(F.col("this_week").isNull(), "no_content").otherwise("merged"))
    return files.join(counts, "path", "left").select(
        "path", status.alias("status"), F.coalesce("this_week", F.lit(0)).alias("this_week"), F.coalesce("next_week", F.lit(0)).alias("next_week"))


# --- chart series -------------------------------------------------------------------------
def chart_series(table: DataFrame, chart: str) -> DataFrame:
    """(label, series, value[, share]) of a table: first column labels, numeric columns series."""
    label, *rest = table.schema.fields
    series = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
    if not series:
        raise ValueError("그래프로 그릴 숫자 열이 없습니다 (첫 열을 뺀 나머지가 전부 숫자가 아님)")
    series = series[:1] if chart == "pie" else series
    long = table.select(F.col(label.name).alias("label"), *[F.col(c).cast("double").alias(c) for c in series]).unpivot(
        ["label"], series, "series", "value")
    if chart != "pie":
        return long
    totals = long.groupBy("series").agg(F.sum("value").alias("_total"))
    return long.join(totals, "series").withColumn("share", F.round(F.col("value") / F.col("_total") * 100, 1)).drop("_total")


# --- speed ---------------------------------------------------------------------------------
def rolling_speed(calls: DataFrame, key: str, time: str, seq: str, expected: int,
                  slice_seconds: int = 3600) -> DataFrame:
    """Low and high estimate in seconds for `expected` tokens after each valid call of a key:
    the mean speed of its last twenty calls.

    A key may hold a large share of all calls, so its calls are cut into time slices that are
    worked on apart.  A slice is also given the calls just before it, taken from the tails of the
    slices, of which there are at most nineteen calls each.
    """
    lookback = X.SPEED_WINDOW - 1
    valid = calls.where((F.col("eval_count") > 0) & (F.col("eval_ns") > 0)).withColumn(
        "speed", F.col("eval_count") / (F.col("eval_ns") / F.lit(1e9))
    ).withColumn("_slice", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / slice_seconds))
    newest = Window.partitionBy(key, "_slice").orderBy(F.desc(time), F.desc(seq))
    tails = valid.select(key, "_slice", time, seq, "speed").withColumn(
        "_r", F.row_number().over(newest)).where(F.col("_r") <= lookback).drop("_r")
    tails = tails.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(time, seq)))
    wanted = tails.groupBy(key, "_slice").agg(F.min("_n").alias("_first")).where("_first > 1").select(
        key, "_slice", F.explode(F.sequence(F.greatest(F.col("_first") - lookback, F.lit(1)), F.col("_first") - 1)).alias("_n"))
    carried = wanted.join(tails.drop("_slice"), [key, "_n"]).select(key, "_slice", time, seq, "speed", F.lit(True).alias("_old"))
    both = valid.withColumn("_old", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    frame = Window.partitionBy(key, "_slice").orderBy(time, seq).rowsBetween(-lookback, 0)
    base = F.lit(expected) / F.avg("speed").over(frame)
    return both.withColumn("low", base * X.SPEED_LOW).withColumn("high", base * X.SPEED_HIGH).where(
        "not _old").drop("_old", "_slice")
