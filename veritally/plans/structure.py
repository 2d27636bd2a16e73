"""Queries: rule checks and document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritally.operators import outline as O
from veritally.operators import rules as U
from veritally.plans.registry import query
from veritally.plans.render import expected, keyed_frame, table
from veritally.sources.stage import staged

V = expected("report_values")
L = expected("lines")


@query("item_numbering", f"""
    select k as doc_id, 4 + 1 as line, '나' as expected, '다' as actual from {V} v where k % 11 = 1
    union all select k, 4, '2', '3' from {V} v where k % 11 = 0
    union all select k, 10, '2', '3' from {V} v where k % 5 = 0""")
def item_numbering(spark, sf):
    return U.item_numbering(keyed_frame(spark, sf, "lines"), ["doc_id"]).select("doc_id", "line", "expected", "actual")


@query("subtotal_check", f"""
    select k as doc_id, 9 as line, cast(amount + k % 100 + 1 as double) as stated, cast(amount + k % 100 as double) as computed from {V} v where k % 19 = 0""")
def subtotal_check(spark, sf):
    return U.subtotal_check(keyed_frame(spark, sf, "lines"), ["doc_id"]).select("doc_id", "line", "stated", "computed")


@query("rule_checks", f"""
    select k as doc_id, cast((k % 11 in (0, 1))::int + (k % 5 = 0)::int as bigint) as numbering_issues, cast((k % 19 = 0)::int as bigint) as arithmetic_issues,
      cast((k % 11 in (0, 1))::int + (k % 5 = 0)::int + (k % 19 = 0)::int as bigint) as total_issue_count from {V} v""")
def rule_checks(spark, sf):
    return U.rule_checks(keyed_frame(spark, sf, "lines"), ["doc_id"])


@query("heading_levels", r"""
    select doc_id, level, count(*) as n from (
      select doc_id, case when regexp_matches(t, '^(19|20)\d{2}\s*[.．]\s*(\d{1,2}\s*[.．]?\s*)*$') then null
        when regexp_matches(t, '^\d+\.\s') then 1 when regexp_matches(t, '^\d+\)\s') then 3 when regexp_matches(t, '^\(\d+\)\s') then 5 when regexp_matches(t, '^[-–—]\s') then 11 when regexp_matches(t, '^[·•ㆍ]\s?') then 12 end as level
      from (select doc_id, ltrim(unnest(string_split(text, chr(10)))) as t from documents
            union all select doc_id, unnest(['2026. 1.', '2026. ' || doc_id % 100 || '. 안내', '1) 항목', '(' || doc_id || ') 괄호', '- 줄', '· 점'])  from documents)) group by all""")
def heading_levels(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    extra = F.array(F.lit("2026. 1."), F.concat(F.lit("2026. "), (F.col("doc_id") % 100).cast("string"), F.lit(". 안내")), F.lit("1) 항목"),
                    F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(") 괄호")), F.lit("- 줄"), F.lit("· 점"))
    lines = docs.select("doc_id", F.explode(F.concat(F.split("text", "\n"), extra)).alias("t"))
    return lines.select("doc_id", U.heading_level(F.col("t")).alias("level")).groupBy("doc_id", "level").agg(F.count("*").alias("n"))


# the rendered documents have paragraphs 0..11; headings at 0-4 and 9
_SECTIONS = f"""
    select k as doc_id, p as para, lv as level, case when b > p then p + 1 end as body_start, case when b > p then b end as body_end from (
      select k, unnest([{{'p': 0, 'lv': 1, 'b': 8}}, {{'p': 1, 'lv': 2, 'b': 3}}, {{'p': 2, 'lv': 3, 'b': 2}}, {{'p': 3, 'lv': 3, 'b': 3}},
        {{'p': 4, 'lv': 2, 'b': 8}}, {{'p': 9, 'lv': 1, 'b': 11}}], recursive := true) from {V} v)"""
_LINES = f"(select doc_id, unnest(range(0, len(l))) as para, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from {L} x))"


def parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    paras = O.paragraphs(keyed_frame(spark, sf, "lines"))
    return paras, O.outline(paras)


@query("outline", f"""
    select s.*, 's' || s.para as section_id, 'heading' as kind, substring(trim(p.text), 1, 60) as title
    from ({_SECTIONS}) s join {_LINES} p on s.doc_id = p.doc_id and s.para = p.para""")
def outline(spark, sf):
    return parts(spark, sf)[1].select("doc_id", "section_id", "kind", "level", "para", "title", "body_start", "body_end")


@query("outline_text", f"""
    select s.doc_id, string_agg(repeat('  ', least(level, 4)) || '[s' || s.para || '] ' || p.text || case when body_start is null then '' else ' (본문 문단 ' || body_start || '~' || body_end || ')' end, chr(10) order by s.para) as text
    from ({_SECTIONS}) s join {_LINES} p on s.doc_id = p.doc_id and s.para = p.para group by s.doc_id""")
def outline_text(spark, sf):
    return O.outline_text(parts(spark, sf)[1])


@query("section_of_para", f"""
    select doc_id, cast(para as int) as para, 's' || case when para <= 4 or para = 9 then para when para between 5 and 8 then 4 else 9 end as section_id from {_LINES} p""")
def section_of_para(spark, sf):
    paras, sections = parts(spark, sf)
    return O.section_of_paragraph(paras, sections)


@query("read_section", f"""
    select d.k as doc_id, section_id, p.text as title, case when section_id = 's77' then '구간 s77이(가) 없습니다' end as error,
      case section_id when 's77' then '' else (select string_agg(b.text, chr(10) order by b.para) from {_LINES} b where b.doc_id = d.k and b.para between 5 and 8) end as body
    from (select k, case when k % 9 = 0 then 's77' else 's4' end as section_id from {V} v) d left join {_LINES} p on p.doc_id = d.k and p.para = 4 and section_id = 's4'""")
def read_section(spark, sf):
    paras, sections = parts(spark, sf)
    pick = F.when(F.col("doc_id") % 9 == 0, "s77").otherwise("s4")
    wanted = paras.where("para = 0").select("doc_id", pick.alias("section_id"))
    return O.read_section(paras, sections, wanted)


def edits(paras: DataFrame) -> DataFrame:
    m = F.col("doc_id") % 6
    mode = (F.when(m == 0, "replace_body").when(m == 1, "replace").when(m == 2, "append")
            .when(m == 3, "insert_after").when(m == 4, "rewrite").otherwise("replace_body"))
    text = F.when(m == 5, "  \n ").otherwise("새 줄 하나\n 들여쓴 줄")
    return paras.where("para = 0").select("doc_id", F.lit("s9").alias("section_id"), mode.alias("mode"), text.alias("text"))


_EDITED = f"""
    select doc_id, cast(row_number() over (partition by doc_id order by place, n) - 1 as int) as para, text from (
      select doc_id, para as place, 0 as n, text from {_LINES} p where not (doc_id % 6 = 0 and para >= 10) and not (doc_id % 6 = 1 and para >= 9)
      union all select k, 20, 1, case when k % 6 in (0, 2) then '  새 줄 하나' else '새 줄 하나' end from {V} v where k % 6 <= 3
      union all select k, 20, 2, ' 들여쓴 줄' from {V} v where k % 6 <= 3)"""


@query("apply_edits", _EDITED)
def apply_edits(spark, sf):
    paras, sections = parts(spark, sf)
    return O.apply_edits(paras, sections, edits(paras))[0].select("doc_id", "para", "text")


@query("edit_log", f"""
    select k as doc_id, k % 6 < 4 as applied, case k % 6 when 4 then '알 수 없는 mode: rewrite' when 5 then '쓸 내용이 비어 있습니다' end as reason,
      case k % 6 when 0 then '  본문 한 줄' || chr(10) || '  본문 두 줄' when 1 then case when k % 5 = 0 then '3. 결론' else '2. 결론' end || chr(10) || '  본문 한 줄' || chr(10) || '  본문 두 줄'
        when 2 then '  본문 한 줄' || chr(10) || '  본문 두 줄' when 3 then '' end as before from {V} v""")
def edit_log(spark, sf):
    paras, sections = parts(spark, sf)
    return O.apply_edits(paras, sections, edits(paras))[1].select("doc_id", "applied", "reason", "before")


def several_edits(paras: DataFrame) -> DataFrame:
    """Two edits of every document, the first of which moves what the second one touches."""
    body = edits(paras).withColumn("mode", F.lit("replace_body")).withColumn("text", F.lit("새 줄 하나\n들여쓴 줄"))
    early = edits(paras).select("doc_id", F.lit("s4").alias("section_id"), F.when(F.col("doc_id") % 2 == 0, "append").otherwise("insert_after").alias("mode"), F.lit("덧붙인 줄\n둘째\n셋째").alias("text"))
    return body.unionByName(early)


def reverted(spark, sf):
    paras, sections = parts(spark, sf)
    changed, log = O.apply_edits(paras, sections, several_edits(paras))
    changed = staged(changed, "edited")
    # in every seventh document someone has written over the lines of the second edit
    written = (F.col("doc_id") % 7 == 0) & (F.col("text").isin("둘째", "  둘째"))
    return O.revert_edits(changed.withColumn("text", F.when(written, F.lit("고친 줄")).otherwise(F.col("text"))), log)


@query("revert_edits", f"""
    select doc_id, cast(para as int) as para, text from {_LINES} p where doc_id % 7 <> 0""")
def revert_edits(spark, sf):
    return reverted(spark, sf)[0].where("doc_id % 7 <> 0").select("doc_id", "para", "text")


@query("revert_states", f"""
    select k as doc_id, section_id, case when section_id = 's4' and k % 7 = 0 then 'no_target' else 'reverted' end as state
    from {V} v, (values ('s4'), ('s9')) t(section_id)""")
def revert_states(spark, sf):
    return reverted(spark, sf)[1].select("doc_id", "section_id", "state")


@query("common_indent", f"""
    select doc_id, case when doc_id % 2 = 0 then ' ' else '  ' end as indent from (select doc_id from documents)""")
def common_indent(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    extra = F.when(F.col("doc_id") % 2 == 0, " \t첫 줄").otherwise("  \t첫 줄")
    lines = docs.select("doc_id", F.explode(F.concat(F.transform(F.split("text", "\n"), lambda l: F.concat(F.lit("  "), F.ltrim(l))), F.array(extra, F.lit("")))).alias("text"))
    return O.common_indent(lines, ["doc_id"])
