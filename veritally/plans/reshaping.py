"""Queries: clean-up, reshaping and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions import fixed as X
from veritally.operators import routing as G
from veritally.operators import tabular as B
from veritally.plans.registry import query
from veritally.plans.render import PHRASES, expected, frame, quote, table

V = expected("order_facts")
STRIP = "' ' || chr(9) || chr(10) || chr(13)"


@query("clean_markup", rf"""
    select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\*\*(.*?)\*\*', '\1', 'g'), '__(.*?)__', '\1', 'g'), '`(.*?)`', '\1', 'g'), '(?m)^#+\s*', '', 'g'), '\*+', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), {STRIP}) as text from pages""")
def clean_markup(spark, sf):
    pages = table(spark, sf, "pages", ["page_id", "html"])
    return pages.select("page_id", B.clean_markup(F.col("html")).alias("text"))


@query("clean_answer", f"""
    select doc_id, trim(text, {STRIP}) as text from documents""")
def clean_answer(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    answer = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```text\n수정안: "), "text", F.lit("\n```")))
              .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  결과 ： "), "text")).otherwise(F.col("text")))
    return docs.select("doc_id", B.clean_answer(answer).alias("text"))


@query("suspicious_spans", """
    select doc_id, cast(strpos(text, w) - 1 as int) as s, cast(strpos(text, w) - 1 + length(w) as int) as e, w as original, '고침' as suggestion
    from (select doc_id, text, regexp_extract(text, '[^\\W\\d_]{5,}') as w from documents) where w <> ''""")
def suspicious_spans(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    word = F.regexp_extract("text", r"[A-Za-z]{5,}", 0)
    docs = docs.withColumn("answer", F.concat(F.lit("- "), word, F.lit(" -> 고침\n설명 줄\n없는표현zz -> 고침")))
    return B.suspicious_spans(docs.where(word != ""), ["doc_id"])


@query("unsupported_numbers", r"""
    with n as (select conv_id, turn, cast(turn * 3 + conv_id % 7 as string) as a, cast(conv_id * 1000 % 9973 as string) || '.5' as b from conversations),
    s as (select conv_id, a as number from n where turn % 2 = 0),
    p as (select conv_id, turn, unnest([a, b]) as number from n where turn % 2 = 1)
    select distinct conv_id, number from p where (conv_id, number) not in (select conv_id, number from s)""")
def unsupported_numbers(spark, sf):
    n = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "cast(turn * 3 + conv_id % 7 as string) as a", "cast(conv_id * 1000 % 9973 as string) || '.5' as b", "text")
    sources = n.where("turn % 2 = 0").selectExpr("conv_id", "text || ' 값 ' || a as text")
    said = n.where("turn % 2 = 1").selectExpr("conv_id", "text || ' 값 ' || a || ' 및 ' || b || '%' as text")
    return B.unsupported_numbers(said, sources, ["conv_id"])


_ITEMS = """case l_linenumber % 5 when 0 then '① 품목 ' || l_partkey || ': 수량 ' || cast(l_quantity as int)
  when 1 then '(2) 반품 ' || l_returnflag || '：예' when 2 then '3) 상태' when 3 then '- 할인 ' || l_linestatus else '본문 ' || l_suppkey end"""


@query("split_lines", f"""
    with l as (select l_orderkey, l_linenumber % 5 as m, * exclude (l_orderkey) from lineitem),
    p as (select l_orderkey, case m when 0 then '①' when 1 then '(2)' when 2 then '3)' when 3 then '-' else '' end as bullet,
      case m when 0 then '품목 ' || l_partkey when 1 then '반품 ' || l_returnflag when 2 then '상태' when 3 then '할인 ' || l_linestatus else '본문 ' || l_suppkey end as title,
      case m when 0 then '수량 ' || cast(l_quantity as int) when 1 then '예' else '' end as description from l)
    select l_orderkey, bullet, title, description, bool_or(bullet <> '' or description <> '') over (partition by l_orderkey) as structured from p""")
def split_lines(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", f"{_ITEMS} as text")
    return B.split_lines(lines, "l_orderkey").select("l_orderkey", "bullet", "title", "description", "structured")


@query("number_lines", r"""
    with l as (select doc_id, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as ls from documents),
    n as (select doc_id, unnest(range(1, len(ls) + 1)) as n, unnest(ls) as content from l)
    select doc_id, cast(n as int) as n, case doc_id % 4 when 0 then n || '. ' when 1 then n || ') ' when 2 then '(' || n || ') ' else case when n <= 20 then chr(cast(9311 + n as int)) else '(' || n || ')' end || ' ' end || content as line from n""")
def number_lines(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    style = F.element_at(F.array(*[F.lit(s) for s in X.NUMBERING_STYLES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return B.number_lines(docs.withColumn("style", style), "doc_id", "style")


_PAIR_CELLS = expected("cells")
_PAIRS = f"""
    with c as (select *, case kind when 'num' then rtrim(rtrim(cast(v_num as string), '0'), '.') when 'date' then cast(v_date as string) else v_str end as t from {_PAIR_CELLS} x),
    p as (select a.source_file, a.sheet, rtrim(trim(a.v_str), ':：') as label, b.t as value, b.kind, a.row, a.col from c a join c b on a.source_file = b.source_file and a.sheet = b.sheet and a.row = b.row and b.col = a.col + 1 where a.kind = 'str' and trim(a.v_str) <> ''),
    l as (select source_file, sheet, label, arg_max(value, row * 100 + col) as value, arg_max(kind, row * 100 + col) as kind, min(row * 100 + col) as first_at from p group by all)"""


@query("label_pairs", _PAIRS + " select source_file, sheet, label, value from l")
def label_pairs(spark, sf):
    return B.label_pairs(frame(spark, sf, "cells")).select("source_file", "sheet", "label", "value")


@query("draft_text", _PAIRS + """
    select source_file, sheet, string_agg(label || '은(는) ' || case when kind = 'num' then format('{:,}', cast(split_part(value, '.', 1) as bigint)) || case when contains(value, '.') then '.' || split_part(value, '.', 2) else '' end else value end, ', ' order by first_at) as draft
    from l group by source_file, sheet""")
def draft_text(spark, sf):
    return B.draft_text(B.label_pairs(frame(spark, sf, "cells")), ["source_file", "sheet"])


@query("weekly_merge", f"""
    with e as (select * from {expected('styled')} s), blue as (select * from e where b >= 120 and b - greatest(r, g) >= 60 and lower(split_part(path, '.', 2)) in ('hwp', 'hwpx'))
    select path, case when lower(split_part(path, '.', 2)) not in ('hwp', 'hwpx') then 'skipped' when not exists (select 1 from blue where blue.path = e.path) then 'no_content' else 'merged' end as status,
      (select count(*) from blue where blue.path = e.path and header = '이번주') as this_week, (select count(*) from blue where blue.path = e.path and header = '다음주') as next_week
    from (select distinct path from e) e""")
def weekly_merge(spark, sf):
    return B.weekly_merge(frame(spark, sf, "styled"))


@query("weekly_lines", f"""
    select path, header, line_no, text from {expected('styled')} s where b >= 120 and b - greatest(r, g) >= 60 and lower(split_part(path, '.', 2)) in ('hwp', 'hwpx')""")
def weekly_lines(spark, sf):
    return B.weekly_lines(frame(spark, sf, "styled")).select("path", "header", "line_no", "text")


@query("chart_series", """
    select r_name as label, 'orders' as series, cast(count(*) as double) as value, null as share from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name
    union all select r_name, 'customers', cast(count(distinct o_custkey) as double), null from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name
    union all select r_name, 'pie', cast(count(*) as double), round(count(*) * 100.0 / (select count(*) from orders join customer on o_custkey = c_custkey), 1) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""")
def chart_series(spark, sf):
    joined = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    grid = joined.groupBy("r_name").agg(
        F.count("*").alias("orders"), F.max("o_orderstatus").alias("note"), F.countDistinct("o_custkey").alias("customers"))
    bars = B.chart_series(grid, "bar").withColumn("share", F.lit(None).cast("double"))
    return bars.unionByName(B.chart_series(grid, "pie").withColumn("series", F.lit("pie")))


@query("rolling_speed", """
    with c as (select event_id, user_id, ts, value * 10 as n, case when event_id % 9 = 0 then 0 else (event_id % 50 + 1) * 1e8 end as ns from events),
    v as (select *, n / (ns / 1e9) as speed from c where n > 0 and ns > 0)
    select event_id, user_id, round(300 / avg(speed) over w * 0.8, 4) as low, round(300 / avg(speed) over w * 1.2, 4) as high
    from v window w as (partition by user_id order by ts, event_id rows between 19 preceding and current row)""")
def rolling_speed(spark, sf):
    calls = table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "ts", "value * 10 as eval_count", "case when event_id % 9 = 0 then 0 else (event_id % 50 + 1) * 1e8 end as eval_ns")
    est = B.rolling_speed(calls, "user_id", "ts", "event_id", 300)
    return est.select("event_id", "user_id", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("pii_flags", f"""
    select doc_id, case doc_id % 5 when 0 then '주민등록번호' when 1 then '휴대폰번호' when 3 then '계좌번호' else '' end as kinds from {expected('personal')} p
    union all select -1 - doc_id, array_to_string(list_filter([case when regexp_matches(text, '\\d{{6}}-[1-4]\\d{{6}}') then '주민등록번호' end, case when regexp_matches(text, '01[016789]-?\\d{{3,4}}-?\\d{{4}}') then '휴대폰번호' end, case when regexp_matches(text, '\\d{{2,6}}-\\d{{2,6}}-\\d{{2,8}}') then '계좌번호' end], lambda x: x is not null), ',') from documents""")
def pii_flags(spark, sf):
    docs = frame(spark, sf, "personal").select("doc_id", "text").unionByName(
        table(spark, sf, "documents").selectExpr("-1 - doc_id as doc_id", "text"))
    return G.pii_flags(docs, ["doc_id"]).select("doc_id", "kinds")


def _sql_intent(text: str) -> str:
    t = text
    for word in X.NOT_KEYWORDS:
        t = f"replace({t}, {quote(word)}, '')"
    arms = []
    for name, words in X.INTENT_RULES:
        test = " or ".join(f"contains(_t, {quote(w)})" for w in words)
        if name == "ask_archive":
            test = f"not contains(_t, {quote(X.ATTACHMENT_WORD)}) and ({test})"
        arms.append(f"when {test} then '{name}'")
    return t, f"case {' '.join(arms)} end"


_T, _CASE = _sql_intent("text")


@query("intent_counts", f"""
    select phrase, {_CASE} as tool, count(*) as n from (select *, {_T} as _t from {expected('messages')} m) group by all""")
def intent_counts(spark, sf):
    rows = frame(spark, sf, "messages")
    return rows.select("phrase", G.intent(F.col("text")).alias("tool")).groupBy("phrase", "tool").agg(F.count("*").alias("n"))


@query("indexed_commands", f"""
    select conv_id, turn, case phrase when {PHRASES.index('3번째로 가줘')} then 'goto' when {PHRASES.index('12번째는 무시해')} then 'ignore' end as command,
      case phrase when {PHRASES.index('3번째로 가줘')} then 3 when {PHRASES.index('12번째는 무시해')} then 12 end as item from {expected('messages')} m""")
def indexed_commands(spark, sf):
    name, item = G.command(F.col("text"))
    return frame(spark, sf, "messages").select("conv_id", "turn", name.alias("command"), item.alias("item"))


@query("clarify_fold", f"""
    with recursive m as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as i from {expected('messages')} m),
    f as (
      select conv_id, turn, i, text as last_text, judged, {_CASE} as tool from (select conv_id, turn, i, text, text as judged, {_T} as _t from m where i = 1)
      union all
      select conv_id, turn, i, last_text, judged, {_CASE} from (
        select m.conv_id, m.turn, m.i, m.text as last_text, case when f.tool is null then f.last_text || ' ' || m.text else m.text end as judged,
          {_sql_intent("case when f.tool is null then f.last_text || ' ' || m.text else m.text end")[0]} as _t
        from m join f on m.conv_id = f.conv_id and m.i = f.i + 1))
    select conv_id, turn, judged, tool, tool is null as pending from f""")
def clarify_fold(spark, sf):
    return G.clarify_fold(frame(spark, sf, "messages"))
