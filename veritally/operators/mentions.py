"""Typed value mentions: amounts, dates, times, phone numbers and years in text.

One pass over the text column marks every pattern inside the row, only the hits are
exploded, and one shuffle by document turns gap lengths into offsets and removes
overlaps with running maxima.  Nothing compares all pairs of spans.
"""

from __future__ import annotations

from collections import namedtuple
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritally.functions import fixed as X
from veritally.functions.text import ascii_digits, canonical_decimal, rx, strip

OPEN, CLOSE, CUT = "\u0001", "\u0002", "\u0003"
ROW = "_row"

Kind = namedtuple("Kind", "code name type pattern literal")
# code orders the output: amounts, dates, times, phones, years; 90+ only exclude.
KINDS = [
    Kind(0, "amount", "amount", X.AMOUNT, None),
    Kind(10, "date_iso", "date", X.DATE_ISO, "-"),
    Kind(11, "date_korean", "date", X.DATE_KOREAN, "월"),
    Kind(12, "date_short", "date", X.DATE_SHORT, "'"),
    Kind(13, "date_dotted", "date", X.DATE_DOTTED, "."),
    Kind(14, "date_month_word", "date", X.DATE_MONTH_WORD, "월"),
    Kind(20, "time_colon", "time", X.TIME_COLON, ":"),
    Kind(21, "time_hours", "time", X.TIME_HOURS, "시"),
    Kind(22, "time_short_hours", "time", X.TIME_SHORT_HOURS, "시"),
    Kind(30, "phone", "phone", X.PHONE, "-"),
    Kind(40, "year_short", "year", X.YEAR_SHORT_WORD, "년"),
    Kind(41, "year", "year", X.YEAR_WORD, "년"),
    Kind(90, "quoted_year", None, X.YEAR_QUOTED, None),
    Kind(91, "paren_year", None, X.YEAR_IN_PARENS, "("),
    Kind(92, "list_marker", None, None, None),
    Kind(95, "colon_digits", None, X.COLON_DIGITS, ":"),
]
TOC_CODE = 93
COLON_CODE = 95
FIRST_EXCLUDING = 90
VALUE_TYPES = ("amount", "date", "time", "phone", "year")

_HIT = (
    "array<struct<code:int,pos:int,raw:string,before_len:int,before_cut:int,"
    "before_tail:string,s0:int,e0:int>>"
)
# a comma between two digits groups them and does not end a clause
_BOUNDARY = (
    rf"[.\n;、。]|[{X.GROUPING_COMMAS}](?:(?!{OPEN}?\d)"
    rf"|(?<!\d[{X.GROUPING_COMMAS}])(?<!\d{CLOSE}[{X.GROUPING_COMMAS}]))"
)


def safe_text(text: Column) -> Column:
    """The three marker characters never occur in marked text; offsets stay as they are."""
    text = F.coalesce(text, F.lit(""))
    marks = OPEN + CLOSE + CUT
    return F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, "�" * 3)).otherwise(text)


def _marked(text: Column, kind: Kind) -> Column:
    if kind.name == "list_marker":
        pattern = f"({X.LIST_MARKER_LEAD})({X.LIST_MARKER_NUMBER})(?={X.LIST_MARKER_TAIL})"
        return F.regexp_replace(text, rx(pattern), f"$1{OPEN}$2{CLOSE}")
    marked = F.regexp_replace(text, rx(kind.pattern), f"{OPEN}$0{CLOSE}")
    return marked if kind.literal is None else F.when(F.contains(text, F.lit(kind.literal)), marked)


def _hits(pieces: Column, code: Column) -> Column:
    """One struct per hit of a pattern: its text and the text just before it."""
    n = F.size(pieces) - 1
    pairs = F.arrays_zip(
        F.slice(pieces, F.lit(1), n).alias("before"), F.slice(pieces, F.lit(2), n).alias("here")
    )

    def row(pair: Column, i: Column) -> Column:
        before = pair["before"]
        bare = F.replace(F.replace(before, F.lit(CUT), F.lit("")), F.lit(CLOSE), F.lit(""))
        return F.struct(
            code.alias("code"),
            i.alias("pos"),
            F.replace(F.substring_index(pair["here"], CLOSE, 1), F.lit(CUT), F.lit("")).alias("raw"),
            F.length(bare).alias("before_len"),
            F.contains(before, F.lit(CUT)).cast("int").alias("before_cut"),
            F.when(
                code < FIRST_EXCLUDING,
                F.replace(F.substring_index(before, CUT, -1), F.lit(CLOSE), F.lit("")),
            ).alias("before_tail"),
            F.lit(None).cast("int").alias("s0"),
            F.lit(None).cast("int").alias("e0"),
        )

    return F.transform(pairs, row)


def contents_spans(text: Column) -> Column:
    """ARRAY<STRUCT<line,s,e,text>> of the entry lines of tables of contents.

    A fold over the lines of one document: after a heading, blank lines are skipped,
    entry lines are taken, any other line ends the table.
    """
    headed = F.regexp_replace(text, rx(X.TOC_HEADING), f"$0{CLOSE}")
    lines = F.split(headed, "\n")
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("line"), F.lit(False).alias("inside"),
        F.array().cast("array<struct<line:int,s:int,e:int,text:string>>").alias("found"),
    )

    def step(acc: Column, raw_line: Column) -> Column:
        bare = F.replace(raw_line, F.lit(CLOSE), F.lit(""))
        body = F.rtrim(bare, F.lit("\r"))
        heading = F.contains(raw_line, F.lit(CLOSE))
        entry = body.rlike(rx(X.TOC_ENTRY))
        empty = strip(body) == ""
        hit = acc["inside"] & entry & ~empty
        one = F.array(F.struct(
            acc["line"].alias("line"), acc["pos"].alias("s"),
            (acc["pos"] + F.length(body)).alias("e"), body.alias("text"),
        ))
        return F.struct(
            (acc["pos"] + F.length(bare) + 1).alias("pos"),
            (acc["line"] + 1).alias("line"),
            (heading | (acc["inside"] & (entry | empty))).alias("inside"),
            F.when(hit, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"),
        )

    folded = F.aggregate(lines, start, step)["found"]
    return F.when(text.rlike(rx(X.TOC_HEADING)), folded)


def contents_lines(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Lines of tables of contents: ids, line, s, e, text."""
    spans = docs.select(*ids, contents_spans(safe_text(F.col(text))).alias("_toc"))
    return spans.select(*ids, F.inline_outer("_toc")).where("line is not null")


def _toc_hits(text: Column) -> Column:
    rows = F.transform(
        contents_spans(text),
        lambda t, i: F.struct(
            F.lit(TOC_CODE).alias("code"), i.alias("pos"), t["text"].alias("raw"),
            F.lit(0).alias("before_len"), F.lit(0).alias("before_cut"),
            F.lit(None).cast("string").alias("before_tail"), t["s"].alias("s0"), t["e"].alias("e0"),
        ),
    ).cast(_HIT)
    return F.coalesce(rows, F.array().cast(_HIT))


def _spans(docs: DataFrame, ids: list[str], text: str, kinds: list[Kind], toc: bool,
           with_context: bool, dealt: bool = False) -> DataFrame:
    """One row per hit with code, raw, s, e, context; partitioned by document.

    `_row` tells rows with the same ids apart: gaps of one must not count in the other. With `dealt`,
    documents were dealt by one of their ids before their text was made, and hits stay where they are.
    """
    source = docs.select(
        *ids, safe_text(F.col(text)).alias("_text"), F.monotonically_increasing_id().alias(ROW)
    ).where(F.col("_text").rlike(rx(r"\d")))
    ids = [*ids, ROW]
    marked = F.array(*[
        F.struct(F.lit(k.code).alias("code"), _marked(F.col("_text"), k).alias("text")) for k in kinds
    ])
    hit = F.filter(marked, lambda m: F.contains(m["text"], F.lit(OPEN)))

    def pieces(m: Column) -> Column:
        text = m["text"]
        if with_context:
            text = F.when(
                m["code"] < FIRST_EXCLUDING, F.regexp_replace(text, rx(_BOUNDARY), f"$0{CUT}")
            ).otherwise(text)
        return F.struct(m["code"].alias("code"), F.split(text, OPEN).alias("pieces"))

    found = F.flatten(F.transform(F.transform(hit, pieces), lambda m: _hits(m["pieces"], m["code"])))
    if toc:
        found = F.concat(found.cast(_HIT), _toc_hits(F.col("_text")))
    # the outer form keeps the optimizer from repeating the whole expression as a size filter
    hits = source.select(*ids, found.alias("_h")).select(
        *ids, F.inline_outer("_h")
    ).where("code is not null")
    # the one shuffle: hits only, never the text; every later window is inside a document
    hits = hits if dealt else hits.repartition(*ids)
    order = Window.partitionBy(*ids, "code").orderBy("pos")
    hits = hits.withColumn("s", F.coalesce("s0", F.sum("before_len").over(order).cast("int")))
    hits = hits.withColumn("e", F.coalesce("e0", F.col("s") + F.length("raw")))
    if with_context:
        hits = hits.withColumn("_clause", F.sum("before_cut").over(order))
        clause = Window.partitionBy(*ids, "code", "_clause").orderBy("pos")
        hits = hits.withColumn(
            "context", strip(F.array_join(F.collect_list("before_tail").over(clause), ""))
        )
    else:
        hits = hits.withColumn("context", F.lit(None).cast("string"))
    return hits.select(*ids, "code", "raw", "s", "e", "context")


def touched_by(spans: DataFrame, ids: list[str], excluding: Column) -> DataFrame:
    """Adds _hit: the span shares a character with some other span for which `excluding` holds.

    Two running extremes per document in place of an overlap join: the furthest end among
    spans that start no later, and the nearest start among spans that start later.
    """
    up = Window.partitionBy(*ids).orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*ids).orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(excluding, F.col("e"))).over(up)
    nearest = F.min(F.when(excluding, F.col("s"))).over(down)
    return spans.withColumn("_reach", reach).withColumn("_near", nearest).withColumn(
        "_hit",
        F.coalesce(F.col("_reach") > F.col("s"), F.lit(False))
        | F.coalesce(F.col("_near") < F.col("e"), F.lit(False)),
    ).drop("_reach", "_near")


def _drop_times_inside_colon_digits(spans: DataFrame, ids: list[str]) -> DataFrame:
    up = Window.partitionBy(*ids).orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("code") == COLON_CODE, F.col("e"))).over(up)
    spans = spans.withColumn("_reach", reach)
    inside = F.col("code").isin(21, 22) & F.coalesce(F.col("_reach") > F.col("s"), F.lit(False))
    return spans.where(~inside & (F.col("code") != COLON_CODE)).drop("_reach")


def month_runs(amounts: DataFrame, ids: list[str], candidate: Column) -> DataFrame:
    """Adds in_month_run: the amount belongs to an unbroken run 1, 2, ..., 12 of the document.

    `amounts` needs normalized and s.  Only rows where `candidate` holds take part.
    """
    number = F.when(
        candidate & F.col("normalized").rlike(r"^(?:[1-9]|1[0-2])$"),
        F.col("normalized").try_cast("int"),
    )
    rows = amounts.withColumn("_n", number).withColumn("_c", F.col("_n").isNotNull())
    order = Window.partitionBy(*ids, "_c").orderBy("s")
    rows = rows.withColumn(
        "_new", F.coalesce((F.col("_n") != F.lag("_n").over(order) + 1).cast("int"), F.lit(1))
    ).withColumn("_run", F.sum("_new").over(order))
    run = Window.partitionBy(*ids, "_c", "_run")
    return rows.withColumn(
        "in_month_run",
        F.col("_c") & (F.count("*").over(run) == 12) & (F.min("_n").over(run) == 1),
    ).drop("_n", "_c", "_new", "_run")


def _normalized(default_year: int) -> Column:
    """Canonical text of a hit from its code and `_n`, the digit runs of the hit."""
    n = F.col("_n")
    two = lambda i: F.lpad(F.get(n, F.lit(i)), 2, "0")
    full_year = lambda i: F.concat(F.lit("20"), F.get(n, F.lit(i)))
    join = lambda sep, *cols: F.concat_ws(sep, *cols)
    code = F.col("code")
    raw = F.col("raw")
    digits = F.replace(ascii_digits(F.regexp_extract(raw, rx(r"^[\d,.]+"), 0)), F.lit(","), F.lit(""))
    power = reduce(
        lambda acc, kv: F.when(F.endswith(raw, F.lit(kv[0])), F.lit(kv[1])).otherwise(acc),
        sorted(X.UNIT_POWERS_OF_TEN.items(), key=lambda kv: len(kv[0])), F.lit(0),
    )
    month = join("-", F.get(n, F.lit(0)), two(1))
    hours = F.concat(two(0), F.lit(":00~"), two(1), F.lit(":00"))
    return (
        F.when(code == 0, canonical_decimal(digits, power))
        .when(code == 10, join("-", F.get(n, F.lit(0)), two(1), two(2)))
        .when(code == 11, join("-", F.lit(f"{default_year:04d}"), two(0), two(1)))
        .when(code == 12, join("-", full_year(0), two(1), two(2)))
        .when(code == 13, join("-", F.get(n, F.lit(0)), two(1), two(2)))
        .when((code == 14) & (F.size(n) == 3),
              F.concat(month, F.lit("~"), join("-", F.get(n, F.lit(0)), two(2))))
        .when(code == 14, month)
        .when(code == 20, F.concat(two(0), F.lit(":"), F.get(n, F.lit(1)), F.lit("~"), two(2),
                                   F.lit(":"), F.get(n, F.lit(3))))
        .when(code.isin(21, 22), hours)
        .when(code == 30, F.col("raw"))
        .when(code == 40, full_year(0))
        .when(code == 41, F.get(n, F.lit(0)))
    )


def _value_type() -> Column:
    return reduce(
        lambda acc, k: F.when(F.col("code") == k.code, F.lit(k.type)).otherwise(acc),
        [k for k in KINDS if k.type], F.lit(None).cast("string"),
    )


def extract(docs: DataFrame, ids: list[str], text: str = "text", default_year: int = 2026,
            types: tuple[str, ...] = VALUE_TYPES, context: bool = True) -> DataFrame:
    """Every hit of the given types, before exclusions: ids, type, normalized, raw, s, e, context."""
    kinds = [k for k in KINDS if k.type in types or (k.code == COLON_CODE and "time" in types)]
    spans = _spans(docs, ids, text, kinds, toc=False, with_context=context)
    if "time" in types:
        spans = _drop_times_inside_colon_digits(spans, [*ids, ROW])
    return _finish(spans, ids, default_year)


def extract_all(docs: DataFrame, ids: list[str], text: str = "text",
                default_year: int = 2026, dealt: bool = False) -> DataFrame:
    """All mentions: amounts that touch a date, time, phone, year, year marker, list marker
    or contents line are dropped, then month runs are dropped.

    `dealt`: the documents were dealt by one of their ids, so that nothing has to be shuffled; if they
    were not, the result is the same and costs more.
    """
    spans = _spans(docs, ids, text, KINDS, toc=True, with_context=True, dealt=dealt)
    ids = [*ids, ROW]
    spans = _drop_times_inside_colon_digits(spans, ids)
    spans = touched_by(spans, ids, F.col("code") > 0)
    kept = spans.where((F.col("code") < 90) & ~((F.col("code") == 0) & F.col("_hit"))).drop("_hit")
    values = _finish(kept, ids, default_year, keep_code=True)
    values = month_runs(values, ids, F.col("code") == 0)
    return values.where(~F.col("in_month_run")).drop("in_month_run", "code", ROW)


def _finish(spans: DataFrame, ids: list[str], default_year: int, keep_code: bool = False) -> DataFrame:
    cols = ["code"] if keep_code else []
    digit_runs = F.regexp_extract_all(ascii_digits(F.col("raw")), F.lit(r"([0-9]+)"), F.lit(1))
    return spans.withColumn("_n", digit_runs).select(
        *ids, *cols, _value_type().alias("type"), _normalized(default_year).alias("normalized"),
        "raw", "s", "e", "context",
    )


def snippets(mentions: DataFrame, docs: DataFrame, ids: list[str], text: str = "text",
             width: int = 10) -> DataFrame:
    """Adds location: up to `width` characters on each side of the starred hit."""
    joined = mentions.join(docs.select(*ids, F.col(text).alias("_text")), ids)
    start = F.greatest(F.col("s") - width, F.lit(0))
    return joined.withColumn(
        "location",
        F.concat(
            F.substring("_text", start + 1, F.col("s") - start), F.lit("**"), F.col("raw"),
            F.lit("**"), F.substring("_text", F.col("e") + 1, F.lit(width)),
        ),
    ).drop("_text")


def pattern_spans(docs: DataFrame, ids: list[str], patterns: dict[str, str],
                  text: str = "text", dealt: bool = False) -> DataFrame:
    """Spans of named patterns: ids, name, raw, s, e (partitioned by document)."""
    names = list(patterns)
    kinds = [Kind(FIRST_EXCLUDING + i, name, None, patterns[name], None) for i, name in enumerate(names)]
    spans = _spans(docs, ids, text, kinds, toc=False, with_context=False, dealt=dealt)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("code") - (FIRST_EXCLUDING - 1))
    return spans.select(*ids, name.alias("name"), "raw", "s", "e")


def weekday_check(docs: DataFrame, ids: list[str], text: str = "text", dealt: bool = False) -> DataFrame:
    """Dates written with a weekday that is not theirs; dates that do not exist are told apart."""
    spans = pattern_spans(docs, ids, {"weekday_date": X.WEEKDAY_DATE}, text, dealt)
    n = F.regexp_extract_all(ascii_digits(F.col("raw")), F.lit(r"([0-9]+)"), F.lit(1))
    part = lambda i: F.get(n, F.lit(i)).try_cast("int")
    rows = spans.withColumn("_d", F.try_to_date(F.concat_ws("-", part(0) + 2000, part(1), part(2)), "y-M-d"))
    rows = rows.withColumn("written_weekday", F.substring("raw", F.length("raw") - 1, F.lit(1)))
    rows = rows.withColumn(
        "actual_weekday", F.substring(F.lit(X.WEEKDAY_NAMES), F.weekday("_d") + 1, F.lit(1))
    )
    issue = F.when(F.col("_d").isNull(), "invalid_date").when(
        F.col("written_weekday") != F.col("actual_weekday"), "mismatch"
    )
    return rows.withColumn("issue", issue).where("issue is not null").select(
        *ids, "raw", "s", "e", "written_weekday", "actual_weekday", "issue"
    )
