"""Rule checks on lines: item numbering, subtotals, headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritally.functions import fixed as X
from veritally.functions.text import ascii_digits, contains_any, lstrip, rx, strip

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_OTHER_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85  ]"


def text_lines(docs: DataFrame, ids: list[str], text: str = "text", empty: bool = False) -> DataFrame:
    """One row per line (from 1), as splitlines() cuts: no empty line after a final break.

    With `empty`, a text without a line has a row too, whose line is NULL.
    """
    whole = F.col(text)
    # texts with no break but \n, which are most, need no pattern
    unix = F.split(F.when(F.endswith(whole, F.lit("\n")), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole), "\n")
    other = F.split(F.regexp_replace(whole, f"(?:{_LINE_BREAK})\\z", ""), _LINE_BREAK)
    parts = F.when(whole == "", F.array().cast("array<string>")).when(whole.rlike(_OTHER_BREAK), other).otherwise(unix)
    return docs.select(*ids, (F.posexplode_outer if empty else F.posexplode)(parts).alias("_i", "content")).select(
        *ids, (F.col("_i") + 1).alias("line"), "content"
    )


def first_match(text: Column, body: Column, patterns: tuple[str, ...], unless: Column | None = None) -> Column:
    """Place of the first pattern that `body`, the text without blanks before it, has; NULL without one.

    Texts for which `unless` holds have none either. Lines without any, which are most, cost one pattern on the text as it is.
    """
    level = reduce(
        lambda acc, i: F.when(body.rlike(rx(patterns[i])), F.lit(i)).otherwise(acc),
        range(len(patterns) - 1, -1, -1), F.lit(None).cast("int"),
    )
    some = rx(f"^[{X.STRIP_CHARS}]*(?:" + "|".join(p.removeprefix("^") for p in patterns) + ")")
    return F.when(text.rlike(some), level if unless is None else F.when(unless, F.lit(None).cast("int")).otherwise(level))


def item_level(line: Column) -> Column:
    """0..3 for the four numbering styles, NULL for other lines."""
    return first_match(line, strip(line), X.ITEM_LEVELS)


def numbered(lines: DataFrame, ids: list[str], *more: str) -> DataFrame:
    """Items (lines with a level) with their number and the one expected; other rows have neither.

    A scope of a level starts anew after every item of a shallower level. `more` are columns kept.
    """
    body = strip(F.col("content"))
    token = F.when(F.col("level").isNotNull(), F.regexp_extract(body, rx(r"^(\d+|[가-힣])"), 1))
    number = F.when(F.col("level").isin(0, 2), ascii_digits(F.col("token")).try_cast("bigint")).otherwise(
        F.instr(F.lit(X.HANGUL_ORDER), F.col("token")).cast("bigint")
    )
    items = lines.withColumn("token", token).withColumn("number", number).select(*ids, "line", "level", "token", "number", *more)
    before = Window.partitionBy(*ids).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    scope = reduce(
        lambda acc, lv: F.when(
            F.col("level") == lv, F.max(F.when(F.col("level") < lv, F.col("line"))).over(before)
        ).otherwise(acc),
        (1, 2, 3), F.lit(None).cast("int"),
    )
    items = items.withColumn("_scope", F.coalesce(scope, F.lit(0)))
    same = Window.partitionBy(*ids, "level", "_scope").orderBy("line")
    return items.withColumn("_expected", F.when(F.col("level").isNotNull(), F.lag("number", 1, 0).over(same) + 1))


def item_numbering(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Items whose number is not the one after the last item of the same level and scope."""
    lines = text_lines(docs, ids, text).withColumn("level", item_level(F.col("content"))).where("level is not null")
    items = numbered(lines, ids, "content")
    numeric = F.col("level").isin(0, 2)
    size = len(X.HANGUL_ORDER)
    wanted = F.when(numeric, F.col("_expected").cast("string")).when(
        F.col("_expected").between(1, size),
        F.substring(F.lit(X.HANGUL_ORDER), F.col("_expected").cast("int"), F.lit(1)),
    ).otherwise("?")
    found = F.when(numeric, F.col("number").cast("string")).otherwise(F.col("token"))
    return items.where("number <> _expected").select(
        *ids, "line", strip(F.col("content")).alias("content"), wanted.alias("expected"), found.alias("actual"),
        F.concat(F.lit("번호 순서 오류 (기대: "), wanted, F.lit(", 실제: "), found, F.lit(")")).alias("issue"),
    )


def valued(lines: DataFrame) -> DataFrame:
    """Lines with `total` (a total line), and _n, _sum and _last: how many numbers a line without a
    level has, their sum, and the last one of a total line."""
    content = F.col("content")
    total = F.coalesce(contains_any(content, X.TOTAL_WORDS), F.lit(False))
    bare = reduce(lambda acc, p: F.regexp_replace(acc, rx(p), ""), X.NOT_A_VALUE, content)
    texts = F.regexp_extract_all(bare, F.lit(rx("(" + X.PLAIN_NUMBER + ")")), F.lit(1))
    numbers = F.transform(texts, lambda t: ascii_digits(F.replace(t, F.lit(","), F.lit(""))).try_cast("double"))
    asked = (total | F.col("level").isNull()) & content.rlike(rx(r"\d"))
    # made by a generator, as a filter on them would else compute them a second time
    made = F.inline(F.array(F.struct(F.when(asked, numbers).otherwise(F.array().cast("array<double>")).alias("_numbers"))))
    rows = lines.withColumn("total", total).select("*", made)
    items = ~F.col("total")
    return rows.withColumns({
        "_n": F.when(items, F.size("_numbers")).otherwise(0),
        "_sum": F.when(items, F.aggregate("_numbers", F.lit(0.0), lambda x, y: x + y)),
        "_last": F.when(F.col("total"), F.try_element_at("_numbers", F.lit(-1))),
    }).drop("_numbers")


def segments(lines: DataFrame, ids: list[str], *more: Column) -> DataFrame:
    """Of rows with `total`, _n, _sum and _last: one per stretch up to a total line, with `wrong`."""
    before = Window.partitionBy(*ids).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_segment", F.coalesce(F.sum(F.col("total").cast("int")).over(before), F.lit(0)))
    out = lines.groupBy(*ids, "_segment").agg(F.sum("_sum").alias("computed"), F.sum("_n").alias("_n"), F.max(F.when(F.col("total"), F.col("_last"))).alias("stated"), *more)
    wrong = (F.col("_n") > 0) & F.col("stated").isNotNull() & (F.abs(F.col("stated") - F.col("computed")) > X.TOTAL_TOLERANCE)
    return out.withColumn("wrong", F.coalesce(wrong, F.lit(False)))


def subtotal_check(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Total lines whose last number is not the sum of the numbers since the previous total line."""
    lines = text_lines(docs, ids, text).withColumn("level", item_level(F.col("content")))
    # other lines neither end a stretch nor add to it
    lines = valued(lines).where("total or _n > 0").select(*ids, "line", "total", "_n", "_sum", "_last", F.when(F.col("total"), strip(F.col("content"))).alias("content"))
    rows = segments(lines, ids, F.max(F.when(F.col("total"), F.col("line"))).alias("line"), F.max("content").alias("content"))
    return rows.where("wrong").select(*ids, "line", "content", "stated", "computed")


def rule_checks(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Issue counts per document; documents without issues have zeros.

    Both checks run on the same rows, so a text is cut into lines once.
    """
    lines = valued(text_lines(docs, ids, text, empty=True).withColumn("level", item_level(F.col("content"))))
    lines = lines.where("level is not null or total or _n > 0 or line is null or line = 1")  # the first line stands for its document
    rows = segments(numbered(lines, ids, "total", "_n", "_sum", "_last"), ids, F.count_if(F.col("number") != F.col("_expected")).alias("n"))
    return rows.groupBy(*ids).agg(
        F.sum("n").alias("numbering_issues"), F.count_if("wrong").alias("arithmetic_issues"),
        (F.sum("n") + F.count_if("wrong")).alias("total_issue_count"),
    )


def heading_level(text: Column) -> Column:
    """0..12 by the marker a paragraph starts with; NULL without one and for date lines."""
    body = lstrip(text)
    # the marker group repeats once per number, so the guard is kept to short lines of digits
    date_line = body.rlike(r"(?U)^(?:19|20)[\d\s.．]*$") & strip(text).rlike(rx(X.DATE_LINE))
    return first_match(text, body, X.HEADING_LEVELS, unless=date_line)
