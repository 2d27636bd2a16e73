"""Queries: values in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions import fixed as X
from veritally.operators import mentions as M
from veritally.plans.registry import query
from veritally.plans.render import expected, frame, table

V = expected("report_values")
R = expected("reports")


def _first_match_spans(docs: str, pattern: str, extra: str = "") -> str:
    """Expected spans of a look-around-free pattern: gaps and hits of a document, summed up."""
    return f"""
    with parts as (
      select doc_id, text, regexp_extract_all(text, '{pattern}') as hit,
        regexp_split_to_array(text, '{pattern}') as gap from {docs} where regexp_matches(text, '{pattern}')),
    numbered as (select doc_id, text, hit, gap, unnest(range(1, len(hit) + 1)) as i from parts),
    placed as (
      select doc_id, text, hit[i] as raw,
        cast(sum(length(gap[i])) over w + coalesce(sum(length(hit[i])) over (
          partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as int) as s
      from numbered window w as (partition by doc_id order by i))
    {extra}"""


_AMOUNTS = _first_match_spans(
    "documents", r"\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:조원|억원|만원|천원|원|%))?",
    r"""
    select doc_id, raw, s, cast(s + length(raw) as int) as e,
      case when strpos(n, '.') > 0 then rtrim(rtrim(regexp_replace(n, '^0+(\d)', '\1'), '0'), '.')
           else regexp_replace(n, '^0+(\d)', '\1') end as normalized
    from (select *, replace(regexp_extract(raw, '^[\d,.]+'), ',', '') as n from placed)""",
)


@query("mentions_amount", _AMOUNTS)
def mentions_amount(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return M.extract(docs, ["doc_id"], types=("amount",), context=False).select(
        "doc_id", "raw", "s", "e", "normalized"
    )


def _one_type(spark, sf, kind):
    return M.extract(frame(spark, sf, "reports"), ["doc_id"], types=(kind,)).select(
        "doc_id", "normalized", "raw", "s", "e", "context"
    )


def _expected_type(normalized: str, raw: str, lead: str) -> str:
    return f"""
    select k as doc_id, {normalized} as normalized, {raw} as raw,
      cast(strpos(text, '{lead} ' || {raw}) + {len(lead)} as int) as s,
      cast(strpos(text, '{lead} ' || {raw}) + {len(lead)} + length({raw}) as int) as e,
      '주문 ' || code || ' {lead}' as context
    from {V} v join {R} r on r.doc_id = v.k"""


@query("mentions_date", _expected_type("said_date", "date_raw", "접수일"))
def mentions_date(spark, sf):
    return _one_type(spark, sf, "date")


@query("mentions_time", _expected_type("said_time", "time_raw", "시간"))
def mentions_time(spark, sf):
    return _one_type(spark, sf, "time")


@query("mentions_phone", _expected_type("phone", "phone", "연락처"))
def mentions_phone(spark, sf):
    return _one_type(spark, sf, "phone")


_YEAR_TEXT = "'서기 ' || cast(2019 + doc_id % 8 as string) || '년, ''' || lpad(cast(doc_id % 100 as string), 2, '0') || '년 그리고 ' || lpad(cast(doc_id % 90 + 5 as string), 2, '0') || '년도'"


@query("mentions_year", """
    select doc_id, cast(2019 + doc_id % 8 as string) as normalized, cast(2019 + doc_id % 8 as string) || '년' as raw, 3 as s from documents
    union all
    select doc_id, '20' || lpad(cast(doc_id % 100 as string), 2, '0'), '''' || lpad(cast(doc_id % 100 as string), 2, '0') || '년', 10 from documents
    union all
    select doc_id, '20' || lpad(cast(doc_id % 90 + 5 as string), 2, '0'), lpad(cast(doc_id % 90 + 5 as string), 2, '0') || '년', 19 from documents""")
def mentions_year(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id", f"{_YEAR_TEXT} as text")
    return M.extract(docs, ["doc_id"], types=("year",)).select("doc_id", "normalized", "raw", "s")


_ALL = " union all ".join(
    f"select k as doc_id, case_id, '{t}' as type, {n} as normalized, {raw} as raw, '주문 ' || code || ' {lead}' as context from {V} v"
    for t, n, raw, lead in (
        ("amount", "cast(said_amount as string)", "amount_raw", "금액"),
        ("date", "said_date", "date_raw", "접수일"),
        ("phone", "phone", "phone", "연락처"),
        ("time", "said_time", "time_raw", "시간"),
    )
)


@query("mentions_all", _ALL)
def mentions_all(spark, sf):
    return M.extract_all(frame(spark, sf, "reports"), ["case_id", "doc_id"]).select(
        "doc_id", "case_id", "type", "normalized", "raw", "context"
    )


@query("mention_context", _first_match_spans(
    r"(select doc_id, regexp_replace(regexp_replace(text, '(\d)([,，])(\d)', '\1' || chr(4) || '\3', 'g'), '(\d)([,，])(\d)', '\1' || chr(4) || '\3', 'g') as text from documents)",
    r"\d+(?:\x04\d{3})*(?:\.\d+)?(?:\s*(?:조원|억원|만원|천원|원|%))?",
    r"""
    select doc_id, s, replace(trim(regexp_extract(substring(text, 1, s), '[^,.\n;、。，]*$'), ' ' || chr(9)), chr(4), ',') as context
    from placed""",
))
def mention_context(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return M.extract(docs, ["doc_id"], types=("amount",)).select("doc_id", "s", "context")


@query("mention_snippet", f"""
    select doc_id, substring(text, greatest(s - 10, 0) + 1, s - greatest(s - 10, 0)) || '**' || raw || '**' || substring(text, s + length(raw) + 1, 10) as location
    from (select r.doc_id, r.text, phone as raw, cast(strpos(text, phone) - 1 as int) as s from {V} v join {R} r on r.doc_id = v.k)""")
def mention_snippet(spark, sf):
    docs = frame(spark, sf, "reports")
    phones = M.extract(docs, ["doc_id"], types=("phone",), context=False)
    return M.snippets(phones, docs, ["doc_id"]).select("doc_id", "location")


@query("toc_lines", f"""
    select doc_id, cast(i - 1 as int) as line, line_text as text from (
      select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line_text, l from (select doc_id, string_split(text, chr(10)) as l from {expected('contents')} c))
    where i < list_position(l, 'Ⅰ. 개요') and regexp_matches(line_text, '\\t\\s*\\d+\\s*$')""")
def toc_lines(spark, sf):
    return M.contents_lines(frame(spark, sf, "contents"), ["doc_id"]).select("doc_id", "line", "text")


@query("contents_amounts", """
    select c_custkey as doc_id, '7' as normalized from customer
    union all select c_custkey, cast(c_custkey + 1000 as string) from customer""")
def contents_amounts(spark, sf):
    all_values = M.extract_all(frame(spark, sf, "contents"), ["doc_id"])
    return all_values.where("type = 'amount'").select("doc_id", "normalized")


@query("month_runs", """
    select c_custkey as doc_id, 1 as n_amounts from customer where c_custkey % 4 <> 0
    union all select c_custkey, 12 from customer where c_custkey % 4 = 0""")
def month_runs(spark, sf):
    values = M.extract_all(frame(spark, sf, "months"), ["doc_id"])
    return values.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_amounts"))


@query("weekday_check", f"""
    select k as doc_id, date_raw as raw, said_weekday as written_weekday,
      substring('월화수목금토일', isodow(dt), 1) as actual_weekday, 'mismatch' as issue
    from {V} v where k % 3 = 2 and k % 13 = 0""")
def weekday_check(spark, sf):
    return M.weekday_check(frame(spark, sf, "reports"), ["doc_id"]).select(
        "doc_id", "raw", "written_weekday", "actual_weekday", "issue"
    )
