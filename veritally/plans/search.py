"""Queries: sources and the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritally.functions import fixed as X
from veritally.operators import archive as A
from veritally.plans.registry import query
from veritally.plans.render import expected, frame, table
from veritally.sources import parts as S
from veritally.sources.stage import fresh_path, staged
from veritally.sources.stored import StoredTables

OLD, NEW = expected("archive_old"), expected("archive_new")

_PATH = "source || '/' || case doc_id % 5 when 0 then 'a.txt' when 1 then 'b.MD' when 2 then 'c.csv' when 3 then 'd.pdf' else 'e.docx' end"


@query("parts_scan", rf"""
    select doc_id, case doc_id % 5 when 3 then 'pdf' when 4 then null else 'text' end as kind,
      case when doc_id % 5 = 4 then '지원하지 않는 형식입니다(hwp/hwpx/xlsx/pdf/txt/md/csv만)' end as error,
      case when doc_id % 5 < 3 then trim(text, ' ' || chr(9) || chr(10) || chr(13)) end as text from documents""")
def parts_scan(spark, sf):
    files = table(spark, sf, "documents", ["doc_id", "source", "text"]).selectExpr("doc_id", f"{_PATH} as path", "text")
    docs, parts = S.parts(files)
    return docs.join(parts.select("doc_id", "text"), "doc_id", "left").select("doc_id", "kind", "error", "text")


@query("path_set", """
    select path, min(page_id) as first_no from (
      select page_id, '/archive/' || split_part(url, '/', 3) || '/' || (page_id % 17) || '.txt' as path from pages where page_id % 6 not in (1, 4, 5)) group by path""")
def path_set(spark, sf):
    host = "split_part(url, '/', 3)"
    arms = {0: "/{n}.txt", 1: "/~${n}.txt", 2: "//./{n}.txt", 3: "\\\\{n}.txt", 4: "/_test{n}.txt"}
    path = " ".join(
        f"when {i} then '/archive/' || {host} || " + " || ".join(
            f"'{part}'" if part != "{n}" else "(page_id % 17)" for part in _split(arms[i])) for i in arms)
    pages = table(spark, sf, "pages", ["page_id", "url"]).selectExpr(
        f"case page_id % 6 {path} else '/archive/' || {host} || '/' || (page_id % 17) || '.png' end as path", "page_id as ordinal")
    return S.path_set(pages)


def _split(pattern: str) -> list[str]:
    before, after = pattern.split("{n}")
    return [before, "{n}", after]


@query("ignore_upsert", """
    select raw, min(s) = 0 as was_stored, min(o) filter (where s = m) as ordinal from (
      select *, min(s) over (partition by raw) as m from (
        select cast(floor(c_acctbal) as bigint) % 500 || '원' as raw, 0 as s, c_custkey as o from customer
        union all select cast(floor(s_acctbal) as bigint) % 700 || '원', 1, s_suppkey from supplier)) group by raw""")
def ignore_upsert(spark, sf):
    stored = table(spark, sf, "customer").selectExpr(
        "cast(floor(c_acctbal) as bigint) % 500 || '원' as raw", "c_custkey as ordinal")
    added = table(spark, sf, "supplier").selectExpr(
        "cast(floor(s_acctbal) as bigint) % 700 || '원' as raw", "s_suppkey as ordinal")
    return S.upsert_ignored(stored, added)


@query("ignore_kept", """
    select raw, case when bool_or(s = 0) then 1 else 2 end as added, min(o) filter (where s = m) as ordinal from (
      select *, min(s) over (partition by raw) as m from (
        select cast(floor(c_acctbal) as bigint) % 500 || '원' as raw, 0 as s, c_custkey as o from customer
        union all select cast(floor(s_acctbal) as bigint) % 700 || '원', 1, s_suppkey from supplier)) group by raw""")
def ignore_kept(spark, sf):
    """The kept list after two updates; the second brings only what is new."""
    store = StoredTables(spark, fresh_path(spark, "ignored"), "raw")
    for name, value, key in (("customer", "c_acctbal) as bigint) % 500", "c_custkey"), ("supplier", "s_acctbal) as bigint) % 700", "s_suppkey")):
        S.keep_ignored(store, table(spark, sf, name).selectExpr(f"cast(floor({value} || '원' as raw", f"{key} as ordinal"))
    return store.read("ignored", S.IGNORED_ROW)


@query("template_merge", """
    select c_custkey, case c_custkey % 2 when 0 then c_name || ' (' || c_mktsegment || ') ' || c_name || ' 귀하 ' else '안내: ' || case when c_custkey % 3 = 0 then '' else c_mktsegment end || ' / {{없음}}' end as text from customer""")
def template_merge(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_custkey % 2 as template_id", "c_name as `이름`",
        "case when c_custkey % 2 = 1 and c_custkey % 3 = 0 then null else c_mktsegment end as `부문`", "cast(null as string) as `비고`")
    templates = spark.createDataFrame(
        [(0, "{{이름}} ({{부문}}) {{이름}} 귀하 {{비고}}"), (1, "안내: {{부문}} / {{없음}}")], "template_id bigint, template string")
    return S.merge_templates(rows, templates, ["이름", "부문", "비고"]).select("c_custkey", "text")


@query("retention_list", """
    select path from (select *, row_number() over (partition by source order by n_chars desc, doc_id desc) as r, source || '/' || lpad(cast(doc_id as string), 9, '0') || '.gif' as path from documents) where r > 5""")
def retention_list(spark, sf):
    files = table(spark, sf, "documents").selectExpr(
        "source", "n_chars as mtime", "source || '/' || lpad(cast(doc_id as string), 9, '0') || '.gif' as path")
    return S.outdated(files, ["source"]).select("path")


@query("guess_year", """
    select name, try_cast(nullif(regexp_extract(name, '20\\d{2}'), '') as integer) as year from (
      select case doc_id % 3 when 0 then '서류심사 결과_' || (1990 + doc_id % 40) || '년.txt' when 1 then doc_id || '_메모.md' else '보고 202' || doc_id || '.hwp' end as name from documents)""")
def guess_year(spark, sf):
    names = table(spark, sf, "documents").selectExpr(
        "case doc_id % 3 when 0 then '서류심사 결과_' || (1990 + doc_id % 40) || '년.txt' when 1 then doc_id || '_메모.md' else '보고 202' || doc_id || '.hwp' end as name")
    return names.select("name", A.guess_year(F.col("name")).alias("year"))


_TOKEN_LISTS = r"""
    (select {ids}, list_concat(
        flatten(list_transform(regexp_extract_all({text}, '[가-힣]+'), lambda r: case when length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) end)),
        list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9][A-Za-z0-9.,]*'), lambda w: lower(trim(w, '.,'))), lambda w: w <> '')) as tokens from {source})"""


def _tokens(ids: str, text: str, source: str) -> str:
    return _TOKEN_LISTS.format(ids=ids, text=text, source=source)


@query("tokenize", f"""
    select doc_id, cast(len(tokens) as int) as n_tokens, array_to_string(tokens, ' ') as tokens from {_tokens("doc_id", "text || ' 합동점검 결과 표 2026.1, x'", "documents")}""")
def tokenize(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    t = A.tokens(F.concat("text", F.lit(" 합동점검 결과 표 2026.1, x")))
    return docs.select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


# an independent statement of packing: recursion over paragraphs that carries the open chunk
_CHUNKS = r"""
    with recursive p as (
      select doc_id, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as ps from documents),
    step(doc_id, ps, i, cur, closed) as (
      select doc_id, ps, 0, '', []::varchar[] from p
      union all
      select doc_id, ps, i + 1,
        case when length(ps[i + 1]) > 700 then '' when cur <> '' and length(cur) + length(ps[i + 1]) + 1 <= 700 then cur || chr(10) || ps[i + 1] else ps[i + 1] end,
        list_concat(
          case when cur <> '' and not (length(ps[i + 1]) <= 700 and length(cur) + length(ps[i + 1]) + 1 <= 700) then [cur] else [] end,
          case when length(ps[i + 1]) > 700 then list_transform(range(0, length(ps[i + 1]), 580), lambda a: substring(ps[i + 1], a + 1, 700)) else [] end)
      from step where i < len(ps)),
    emitted as (
      select doc_id, i, unnest(closed) as text, unnest(range(len(closed))) as j from step
      union all select doc_id, i + 1, cur, 0 from step where i = len(ps) and cur <> ''),
    c as (select doc_id, cast(row_number() over (partition by doc_id order by i, j) - 1 as int) as chunk_no, text from emitted)"""


@query("chunks", _CHUNKS + " select doc_id, chunk_no, text from c")
def chunks(spark, sf):
    return A.chunks(table(spark, sf, "documents", ["doc_id", "text"]), ["doc_id"]).select("doc_id", "chunk_no", "text")


@query("archive_diff", f"""
    select coalesce(o.path, n.path) as path, case when n.path is null then 'removed' when o.path is not null and o.mtime = n.mtime and o.error is null then 'skipped' when n.error is not null then 'failed' else 'indexed' end as action
    from {OLD} o full outer join {NEW} n on o.path = n.path""")
def archive_diff(spark, sf):
    return A.archive_diff(frame(spark, sf, "archive_old"), frame(spark, sf, "archive_new"))


def stored_index(spark, sf) -> tuple[DataFrame, DataFrame]:
    old = frame(spark, sf, "archive_old").withColumn("year", A.guess_year(F.col("name")))
    rows = A.chunks(old.where("error is null"), ["path"]).withColumn("label", F.lit("본문"))
    return old, rows


@query("archive_reindex", _CHUNKS.replace("from documents)", f"""from (
      select path as doc_id, text from {NEW} n where error is null and not exists (select 1 from {OLD} o where o.path = n.path and o.mtime = n.mtime and o.error is null)
      union all select o.path, o.text from {OLD} o join {NEW} n on o.path = n.path and o.mtime = n.mtime and o.error is null))""") + " select doc_id as path, chunk_no, text from c")
def archive_reindex(spark, sf):
    """The stored index after two snapshots: the second update writes only the buckets it touches."""
    store = StoredTables(spark, fresh_path(spark, "archive"), "path")
    for snapshot in ("archive_old", "archive_new"):
        A.update_index(store, frame(spark, sf, snapshot))
    return store.read("chunks", A.CHUNK_ROW).select("path", "chunk_no", "text")


@query("archive_stats", _CHUNKS.replace("from documents)", f"from (select doc_id, text from {OLD} o where error is null))") + f"""
    select (select count(*) from {OLD} o where error is null) as docs, (select count(*) from {OLD} o where error is not null) as failed, (select count(*) from c) as chunks""")
def archive_stats(spark, sf):
    return A.archive_stats(*stored_index(spark, sf))


@query("term_df", _CHUNKS + f""", t as {_tokens("doc_id, chunk_no", "text", "c")}
    select term, count(*) as df from (select distinct doc_id, chunk_no, unnest(tokens) as term from t) group by term""")
def term_df(spark, sf):
    return A.term_df(A.chunks(table(spark, sf, "documents", ["doc_id", "text"]), ["doc_id"]))


def _bm25_sql(scope: str, queries: str) -> str:
    return _CHUNKS + f""", t as materialized (select *, len(tokens) as length from {_tokens("doc_id, chunk_no", "text", scope)}),
    q as (select item_id, unnest(list_distinct(tokens)) as term from {_tokens("item_id", "text", queries)}),
    s as (select count(*) as n, avg(length) as avgdl from t),
    tf as (select doc_id, chunk_no, length, term, count(*) as tf from (select doc_id, chunk_no, length, unnest(tokens) as term from t) where term in (select term from q) group by all),
    df as (select term, count(*) as df from tf group by term),
    sc as (select item_id, doc_id, chunk_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) as score
      from tf join df using (term) join q using (term), s group by all)
    select item_id, doc_id, chunk_no, round(score, 3) as score, cast(rank as int) as rank from (
      select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id, chunk_no) as rank from sc) where rank <= 5"""


def archive_chunks(spark, sf):
    """Chunks of the documents, with tokens, name and year."""
    files = table(spark, sf, "documents", ["doc_id", "text", "source", "lang"])
    rows = A.chunks(files, ["doc_id", "source", "lang"])
    year = (F.lit(2020) + F.pmod("doc_id", F.lit(5))).cast("int").alias("year")
    return rows.select("doc_id", "chunk_no", "text", "tokens", "length", F.concat_ws(" ", "source", "lang").alias("name"), year)


@query("bm25_topk", _bm25_sql("c", "benchmark"))
def bm25_topk(spark, sf):
    hits = A.bm25(archive_chunks(spark, sf), table(spark, sf, "benchmark"), ["doc_id", "chunk_no"], "item_id")
    return hits.select("item_id", "doc_id", "chunk_no", F.round("score", 3).alias("score"), "rank")


_SCOPE = "(select c.* from c join documents d using (doc_id) where d.doc_id % 5 = 3 and d.source || ' ' || d.lang ilike '%src%EN%')"


@query("bm25_filtered", _bm25_sql(_SCOPE, "benchmark"))
def bm25_filtered(spark, sf):
    """Ranked search among the files of one year whose name holds a word: statistics follow the filter."""
    scope = A.in_scope(A.in_scope(archive_chunks(spark, sf), 2023), name_contains="EN").where("name like '%src%'")
    hits = A.bm25(scope, table(spark, sf, "benchmark"), ["doc_id", "chunk_no"], "item_id")
    return hits.select("item_id", "doc_id", "chunk_no", F.round("score", 3).alias("score"), "rank")


@query("search_results", f"""
    select item_id, rank, '[' || d.source || ' ' || d.lang || ' · ' || doc_id || '#' || r.chunk_no || '] (점수 ' || cast(r.score as varchar) || ')' || chr(10) || c.text as result
    from ({_bm25_sql("c", "benchmark")}) r join documents d using (doc_id) join ({_CHUNKS} select * from c) c using (doc_id, chunk_no)""")
def search_results(spark, sf):
    """The text that a search shows for every hit."""
    rows = staged(archive_chunks(spark, sf), "chunks")
    hits = A.bm25(rows, table(spark, sf, "benchmark"), ["doc_id", "chunk_no"], "item_id")
    shown = hits.join(rows.select("doc_id", "chunk_no", "name", "text"), ["doc_id", "chunk_no"])
    shown = shown.withColumn("label", F.concat_ws("#", "doc_id", "chunk_no"))
    return shown.select("item_id", "rank", A.format_results(shown).alias("result"))


@query("cosine_topk", """
    with q as (select label as query_id, min_by(embedding, vec_id) as qv from embeddings group by label),
    s as (select query_id, vec_id, list_cosine_similarity(embedding::double[], qv::double[]) as score from embeddings, q)
    select query_id, vec_id, round(score, 6) as score, cast(rank as int) as rank from (
      select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s) where rank <= 5""")
def cosine_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    hits = A.cosine_topk(vectors, queries)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[가-힣A-Za-z0-9]{{2,}}'))"


@query("token_overlap", f"""
    select c.conv_id, c.turn, cast(len(list_intersect({_WORDS.format('c.text')}, {_WORDS.format('q.text')})) as int) as score
    from conversations c join conversations q on c.conv_id = q.conv_id and q.turn = 0""")
def token_overlap(spark, sf):
    conv = table(spark, sf, "conversations")
    first = conv.where("turn = 0").select("conv_id", F.col("text").alias("question"))
    overlap = F.size(F.array_intersect(A.word_set(F.col("text")), A.word_set(F.col("question"))))
    return conv.join(first, "conv_id").select("conv_id", "turn", overlap.alias("score"))


@query("context_pack", rf"""
    with recursive b as (
      select conv_id, cast(turn as int) as block_no, role || ' · ' || turn as label,
        case when length(text) > {X.PACK_PART_CHARS} then substring(text, 1, {X.PACK_PART_CHARS}) || '{X.PACK_CUT_NOTE}' else text end as text from conversations),
    r as (
      select b.conv_id, block_no, label, cast(length(b.text) + length(label) + {X.PACK_OVERHEAD} as int) as size,
        cast(len(list_intersect({_WORDS.format('q.text')}, {_WORDS.format('b.text')})) as int) as score
      from b join conversations q on b.conv_id = q.conv_id and q.turn = 0),
    g as (select conv_id, sum(size) as total, list(struct_pack(b := block_no, s := size) order by -score, block_no) as l from r group by conv_id),
    f(conv_id, l, i, used, taken) as (
      select conv_id, l, 0, 0, []::int[] from g
      union all
      select conv_id, l, i + 1, case when used + l[i + 1].s <= 600 then used + l[i + 1].s else used end,
        case when used + l[i + 1].s <= 600 then list_append(taken, l[i + 1].b) else taken end
      from f where i < len(l))
    select r.conv_id, block_no, label, size, score, total > 600 as over_budget
    from r join g using (conv_id) join (select conv_id, taken from f where i = len(l)) d using (conv_id)
    where total <= 600 or list_contains(taken, block_no)""")
def context_pack(spark, sf):
    conv = table(spark, sf, "conversations")
    blocks = conv.selectExpr("conv_id", "cast(turn as int) as block_no", "role || ' · ' || turn as label", "text")
    questions = conv.where("turn = 0").selectExpr("conv_id", "text as question")
    return A.context_pack(blocks, questions, "conv_id", budget=600)


@query("part_budget", """
    with b as (select conv_id, turn, '[' || conv_id || ' · ' || role || ']' || chr(10) || text as block from conversations),
    u as (select *, coalesce(sum(length(block) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as used from b),
    o as (select *, used + length(block) > 600 as over, 600 - used as remain from u),
    f as (select *, coalesce(bool_or(over) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), false) as stopped from o)
    select conv_id, cast(turn as int) as part_no, case when over then substring(block, 1, cast(remain as int)) || chr(10) || '…(잘림)' else block end as block, over as truncated
    from f where not stopped and (not over or remain > 200)""")
def part_budget(spark, sf):
    parts = table(spark, sf, "conversations").selectExpr(
        "conv_id", "cast(turn as int) as part_no", "'[' || conv_id || ' · ' || role || ']\\n' || text as block")
    return A.part_budget(parts, "conv_id", limit=600)
