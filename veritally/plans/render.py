"""Report-like inputs rendered from the given tables, as SQL text for two engines.

The given tables hold no report text, grids or archives, so queries read tables that are
derived from them here, always from every row.  The same text is used by the expected
answers; the differences between the engines are the few methods of `Dialect`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritally.sources.stage import fresh_path


class Dialect:
    """Where tables are and how the two engines differ.

    `tasks` > 0 spreads a scanned table over that many tasks before anything is computed on it:
    for single-file inputs, which are read by one task; with `key`, by that column. `ready` names
    folders that hold a rendering already, so that one which others read several times is made once.
    """

    def __init__(self, folder: str | None, tasks: int = 0, key: str | None = None, ready: dict[str, str] | None = None):
        self.folder, self.tasks, self.key, self.ready = folder, tasks, key, ready or {}

    @property
    def spark(self) -> bool:
        return self.folder is not None

    def t(self, table: str, dealt: bool = True) -> str:
        if not self.spark:
            return table
        scan = f"parquet.`{self.folder}/{table}.parquet`"
        by = f"{self.tasks}, {self.key}" if self.key else self.tasks
        return f"(select /*+ REPARTITION({by}) */ * from {scan})" if self.tasks and dealt else scan

    def money(self, x: str) -> str:
        return f"format_number({x}, 0)" if self.spark else f"format('{{:,}}', {x})"

    def weekday(self, d: str) -> str:
        return f"weekday({d})" if self.spark else f"(isodow({d}) - 1)"

    def str(self, x: str) -> str:
        return f"cast({x} as string)"

    def chr(self, x: str) -> str:
        return f"chr(cast({x} as int))"

    def epoch(self, x: str) -> str:
        return f"unix_seconds({x})" if self.spark else f"cast(epoch({x}) as bigint)"


DUCK = Dialect(None)


def code(x: str) -> str:
    return f"translate(lpad(cast({x} as string), 8, '0'), '0123456789', 'abcdefghij')"


def order_facts(d: Dialect) -> str:
    """One row per order: the true values a report should state."""
    return f"""
    select o_orderkey as k, o_custkey as case_id, {code('o_orderkey')} as code,
      cast(floor(o_totalprice) as bigint) as amount,
      make_date(year(o_orderdate) + 28, month(o_orderdate), day(o_orderdate)) as dt,
      '031-' || lpad({d.str('o_orderkey % 10000')}, 4, '0') || '-'
        || lpad({d.str('(o_orderkey * 7) % 10000')}, 4, '0') as phone,
      1 + o_orderkey % 21 as hour, o_orderpriority as priority
    from {d.t('orders')}"""


def report_values(d: Dialect) -> str:
    """Order facts plus what the report of the order writes, planted errors included."""
    return f"""
    select *, amount + case when k % 17 = 0 then 1 else 0 end as said_amount,
      {d.money('amount + case when k % 17 = 0 then 1 else 0 end')} || '원' as amount_raw,
      {d.str('dt')} as iso,
      substring('월화수목금토일', cast(({d.weekday('dt')} + case when k % 13 = 0 then 1 else 0 end) % 7 + 1 as int), 1) as said_weekday,
      case when k % 3 = 0 then {d.str('dt')}
           when k % 3 = 1 then {d.str('month(dt)')} || '월 ' || {d.str('day(dt)')} || '일'
           else '''' || substring({d.str('dt')}, 3, 2) || '.' || {d.str('month(dt)')} || '.' || {d.str('day(dt)')}
             || '(' || substring('월화수목금토일', cast(({d.weekday('dt')} + case when k % 13 = 0 then 1 else 0 end) % 7 + 1 as int), 1) || ')'
      end as date_raw,
      case when k % 3 = 1 then '2026' || substring({d.str('dt')}, 5, 6) else {d.str('dt')} end as said_date,
      {d.str('hour')} || '~' || {d.str('hour + 2')} || '시' as time_raw,
      lpad({d.str('hour')}, 2, '0') || ':00~' || lpad({d.str('hour + 2')}, 2, '0') || ':00' as said_time
    from ({order_facts(d)}) f"""


def reports(d: Dialect) -> str:
    return f"""
    select case_id, k as doc_id,
      '주문 ' || code || ' 금액 ' || amount_raw || ', 주문 ' || code || ' 접수일 ' || date_raw
      || ', 주문 ' || code || ' 연락처 ' || phone || ', 주문 ' || code || ' 시간 ' || time_raw as text
    from ({report_values(d)}) v"""


def facts(d: Dialect) -> str:
    """One fact per order and type, labelled with the order's code."""
    return f"""
    select case_id, k * 4 + n as cand_id, type, normalized, normalized as raw,
      '원본_' || {d.str('case_id')} || '.xlsx' as source_file,
      '주문!' || col || {d.str('k + 4')} as location, '주문 ' || code as label,
      '' as row_label, '' as column_header, false as from_text
    from (
      select case_id, k, code, 0 as n, 'amount' as type, {d.str('amount')} as normalized, 'B' as col from ({order_facts(d)}) a
      union all
      select case_id, k, code, 1, 'date', {d.str('dt')}, 'C' from ({order_facts(d)}) b
      union all
      select case_id, k, code, 2, 'phone', phone, 'D' from ({order_facts(d)}) c
      union all
      select case_id, k, code, 3, 'time', lpad({d.str('hour')}, 2, '0') || ':00~' || lpad({d.str('hour + 2')}, 2, '0') || ':00', 'E' from ({order_facts(d)}) e
    ) u"""


def year_grid(d: Dialect) -> str:
    """file (priority) x sheet (region) x nation x year totals: all orders, on three years in turn."""
    if "year_grid" in d.ready:
        return f"select * from parquet.`{d.ready['year_grid']}`"
    year = "2026 + (year(o_orderdate) - 1992) % 3"
    return f"""
    select o_orderpriority as priority, r_name as region, n_nationkey as nk, n_name as nation,
      {year} as y, cast(sum(floor(o_totalprice)) as bigint) as total
    from {d.t('orders')} o join {d.t('customer')} c on o_custkey = c_custkey
    join {d.t('nation')} n on c_nationkey = n_nationkey
    join {d.t('region')} r on n_regionkey = r_regionkey
    group by o_orderpriority, r_name, n_nationkey, n_name, {year}"""


def cells(d: Dialect) -> str:
    """Long cells: a list sheet per customer and year sheets per priority and region."""

    def cell(row: str, col: str, kind: str, n="null", dt="null", s="null") -> str:
        return (
            f"{{{{'row': cast({row} as int), 'col': cast({col} as int), 'kind': {kind}, "
            f"'v_num': cast({n} as decimal(38,10)), 'v_date': cast({dt} as date), 'v_str': cast({s} as string)}}}}"
        ).replace("{{", "{").replace("}}", "}")

    def unfold(select: str, source: str, some: list[str]) -> str:
        if d.spark:
            some = [c.replace("{", "named_struct(").replace("}", ")").replace("': ", "', ") for c in some]
            return f"select {select}, row, col, kind, v_num, v_date, v_str from {source} x lateral view inline(array({', '.join(some)})) y"
        return f"select {select}, unnest([{', '.join(some)}], recursive := true) from {source} x"

    list_sheet = f"'orders_' || {d.str('case_id')} || '.xlsx' as source_file, '주문' as sheet"
    year_sheet = "'years_' || priority || '.xlsx' as source_file, region as sheet"
    words = lambda texts: [cell("3", str(c), "'str'", s=quote(t)) for c, t in texts]
    list_heads = [cell("1", "1", "'str'", s="'주문 내역'"), *words(enumerate(("항목", "금액", "접수일", "수량"), 1))]
    year_heads = [
        cell("1", "1", "'str'", s="'연도별 실적'"), cell("3", "2", "'num'", n="2026"),
        *words([(1, "구분"), (3, "'27"), (4, "2028 목표")]),
    ]
    open_text = f"case when k % 40 = 0 then '미정 ' || {d.str('k % 90 + 10')} || '건' end"
    list_body = [
        cell("k + 4", "1", "'str'", s="'주문 ' || code"),
        cell("k + 4", "2", "case when k % 40 = 0 then 'str' else 'num' end",
             n="case when k % 40 <> 0 then amount end", s=open_text),
        cell("k + 4", "3", "'date'", dt="dt"),
        cell("k + 4", "4", "'num'", n="k % 100 + 0.5"),
    ]
    return "\nunion all\n".join([
        unfold(list_sheet, f"(select distinct o_custkey as case_id from {d.t('orders', dealt=False)})", list_heads),
        unfold(list_sheet, f"({order_facts(d)})", list_body),
        unfold(year_sheet, f"(select distinct priority, region from ({year_grid(d)}) g)", year_heads),
        unfold(year_sheet, f"(select distinct priority, region, nk, nation from ({year_grid(d)}) g)",
               [cell("nk + 4", "1", "'str'", s="nation")]),
        unfold(year_sheet, f"({year_grid(d)})", [cell("nk + 4", "y - 2024", "'num'", n="total")]),
    ])


def conflict_cells(d: Dialect) -> str:
    """The same addresses in two files; every seventh supplier differs."""
    one = lambda file, extra: f"""
      select s_nationkey as case_id, '{file}.xlsx' as source_file,
        'Sheet1!B' || {d.str('s_suppkey + 2')} as location, 'amount' as type,
        s_suppkey * 2 as ord, {d.str(f'cast(floor(s_acctbal) as bigint){extra}')} as normalized
      from {d.t('supplier')}"""
    return (
        one("초안", "") + " union all " + one("최종", " + case when s_suppkey % 7 = 0 then 1 else 0 end")
        + f""" union all
      select s_nationkey, '최종.xlsx', 'Sheet1!예산(합계)', 'amount', 1, {d.str('s_suppkey')} from {d.t('supplier')}"""
    )


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines(d: Dialect) -> str:
    """One document of numbered lines per order; numbers skipped if k % 11 = 0, totals off if k % 19 = 0."""
    return f"""
    select k as doc_id,
      '1. 개요' || chr(10) || '가. 주문 ' || code || chr(10) || '1) 접수 ' || iso || chr(10)
      || case when k % 11 = 0 then '3) 문의' else '2) 문의' end || chr(10)
      || case when k % 11 = 1 then '다. 내역' else '나. 내역' end || chr(10)
      || '예산 ' || {d.money('amount')} || '원' || chr(10) || '수량 ' || {d.str('k % 100')} || chr(10)
      || '연락 ' || phone || ' ' || {d.str('hour')} || ':30~' || {d.str('hour + 1')} || ':30' || chr(10)
      || '합계: ' || {d.money('amount + k % 100 + case when k % 19 = 0 then 1 else 0 end')} || chr(10)
      || case when k % 5 = 0 then '3. 결론' else '2. 결론' end || chr(10) || '  본문 한 줄' || chr(10) || '  본문 두 줄'
      as text
    from ({report_values(d)}) v"""


def months(d: Dialect) -> str:
    """Customers' month headers: whole runs, and runs that stop at 11 if c_custkey % 4 = 0."""
    run = " ".join(str(i) for i in range(1, 12))
    return f"""
    select c_custkey as doc_id,
      '월별 {run}' || case when c_custkey % 4 = 0 then '' else ' 12' end || ' 합 ' || {d.str('c_custkey + 100')} as text
    from {d.t('customer')}"""


def contents(d: Dialect) -> str:
    """Documents with a table of contents; the entry numbers must not become amounts."""
    return f"""
    select c_custkey as doc_id,
      '목   차' || chr(10) || chr(10) || 'Ⅰ. 개요' || chr(9) || ' 1' || chr(10)
      || case when c_custkey % 3 = 0 then '' else ' 붙 임 1. 실적' || chr(9) || ' 14' || chr(10) end
      || 'Ⅱ. 관리' || chr(9) || ' ' || {d.str('c_custkey % 90 + 1')} || chr(10) || chr(10)
      || 'Ⅰ. 개요' || chr(10) || '쪽' || chr(9) || ' 7' || chr(10) || '예산은 ' || {d.money('c_custkey + 1000')} || '원' as text
    from {d.t('customer')}"""


def personal(d: Dialect) -> str:
    n = lambda m, w: f"lpad({d.str(f'(c_custkey * 37 + 11) % {m}')}, {w}, '0')"
    return f"""
    select c_custkey as doc_id, c_mktsegment as source,
      case c_custkey % 5
        when 0 then '번호 900101-1' || {n(1000000, 6)}
        when 1 then '휴대폰 010-' || {n(10000, 4)} || '-5678'
        when 2 then '전화 031-' || {n(10000, 4)} || '-5678'
        when 3 then '계좌 110-22-' || {n(10000000, 7)}
        else '연락 없음' end as text
    from {d.t('customer')}"""


PHRASES = [
    "숫자 검증해줘", "공문서로 다듬어줘", "이 문단 줄여줘", "작년 서류심사 건수 알려줘", "첨부에서 찾아줘",
    "보고서 작성해", "표 만들어", "그래프 그려", "번호 매겨", "주간보고 취합", "쪽맞춤 부탁", "현장점검 안내",
    "3번째로 가줘", "12번째는 무시해", "안녕하세요", "작년 첨부 파일",
]


def messages(d: Dialect) -> str:
    pick = f"(conv_id * 7 + turn * 3) % {len(PHRASES)}"
    arms = " ".join(f"when {i} then {quote(p)}" for i, p in enumerate(PHRASES))
    return f"""
    select conv_id, turn, text || ' ' || case {pick} {arms} end as text,
      {pick} as phrase
    from {d.t('conversations')}"""


def archive_old(d: Dialect) -> str:
    return f"""
    select '/archive/' || source || '/' || {d.str('2019 + doc_id % 8')} || '년_' || {d.str('doc_id')} || '.txt' as path,
      {d.str('2019 + doc_id % 8')} || '년_' || {d.str('doc_id')} || '.txt' as name,
      cast(doc_id as double) as mtime,
      case when doc_id % 23 = 0 then '읽기 실패' end as error, doc_id, text
    from {d.t('documents')} where doc_id % 13 <> 5"""


def archive_new(d: Dialect) -> str:
    return f"""
    select '/archive/' || source || '/' || {d.str('2019 + doc_id % 8')} || '년_' || {d.str('doc_id')} || '.txt' as path,
      {d.str('2019 + doc_id % 8')} || '년_' || {d.str('doc_id')} || '.txt' as name,
      cast(doc_id as double) + case when doc_id % 10 = 0 then 60 else 0 end as mtime,
      case when doc_id % 10 = 2 then '읽기 실패' end as error, doc_id,
      case when doc_id % 10 = 0 then text || chr(10) || '수정 2026년' else text end as text
    from {d.t('documents')} where doc_id % 10 <> 1"""


def styled(d: Dialect) -> str:
    """Lines of weekly report cells: a third black, the rest shades of blue or unknown."""
    return f"""
    select 'user_' || {d.str('user_id')} || case user_id % 4 when 0 then '.hwp' when 1 then '.hwpx' when 2 then '.HWP' else '.xlsx' end as path,
      case when event_id % 2 = 0 then '이번주' else '다음주' end as header,
      event_id as line_no, event_type || ' ' || {d.str('event_id')} as text,
      case when event_id % 3 = 0 then 0 else 20 end as r, case when event_id % 3 = 0 then 0 else 30 end as g,
      case when event_id % 3 = 0 or user_id % 5 = 0 then 0 when event_id % 3 = 1 then 255 else 100 + event_id % 50 end as b
    from {d.t('events')}"""


def table_docs(d: Dialect) -> str:
    """One document per file and region holding the flat text of its year grid.

    A row is merged over two years if its nation key % 6 = 1; a value is the next year's if % 6 = 0.
    """
    return f"""
    select priority, region, nk, nation,
      max(case when y = 2026 then total end) as y26, max(case when y = 2027 then total end) as y27,
      max(case when y = 2028 then total end) as y28
    from ({year_grid(d)}) g group by priority, region, nk, nation"""


RENDERINGS = {
    "order_facts": order_facts, "report_values": report_values, "reports": reports, "facts": facts,
    "cells": cells, "conflict_cells": conflict_cells, "lines": lines, "months": months,
    "contents": contents, "personal": personal, "messages": messages, "archive_old": archive_old,
    "archive_new": archive_new, "styled": styled, "year_grid": year_grid, "table_docs": table_docs,
}


# renderings that only project one table
ONE_SCAN = {
    "order_facts": "orders", "report_values": "orders", "reports": "orders", "facts": "orders",
    "lines": "orders", "months": "customer", "contents": "customer", "personal": "customer",
    "messages": "conversations", "archive_old": "documents", "archive_new": "documents",
    "styled": "events",
}


# renderings that are shuffled once, as the table is spread: their text is the table's own, or nothing filters it
PLAIN = {"archive_old", "archive_new", "facts", "order_facts"}


def missing_tasks(df: DataFrame) -> int:
    """How many tasks to spread an input over: 0 if it has files enough for the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if len(df.inputFiles()) < cores // 2 else 0


#: Rows of a rendered table that a task gets where it has to sort their lines.
TASK_ROWS = 60_000


def keyed_frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table rendered from one scan, dealt by its document: what is done per document afterwards
    moves no text any more, and a task's share does not grow with the table, only the tasks do."""
    base = ONE_SCAN[name]
    key = {"orders": "o_orderkey", "customer": "c_custkey"}[base]
    return spark.sql(RENDERINGS[name](Dialect(folder, bounded_tasks(spark, folder, base), key)))


def bounded_tasks(spark: SparkSession, folder: str, base: str) -> int:
    """In how many tasks a table is dealt, so that a task gets `TASK_ROWS` rows at most."""
    rows = spark.read.parquet(f"{folder}/{base}.parquet").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A rendered table as a DataFrame over the parquet tables of `folder`."""
    if name == "cells":
        return cells_frame(spark, folder)
    tasks = 0
    if name in ONE_SCAN:
        tasks = missing_tasks(spark.read.parquet(f"{folder}/{ONE_SCAN[name]}.parquet"))
    df = spark.sql(RENDERINGS[name](Dialect(folder, tasks)))
    # the exchange also keeps filters on rendered text from rendering it a second time
    return df.repartition(tasks) if tasks and name not in PLAIN else df


def cells_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The cells; the year grid, of which they make heads, names and values, is put together once, and
    the orders are dealt in tasks whose share does not grow with the table."""
    path = fresh_path(spark, "year-grid")
    spark.sql(year_grid(Dialect(folder))).write.parquet(path)
    return spark.sql(cells(Dialect(folder, bounded_tasks(spark, folder, "orders"), "o_orderkey", {"year_grid": path})))


def expected(name: str) -> str:
    """The same rendering as a sub-query for the expected answers."""
    return f"({RENDERINGS[name](DUCK)})"


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A given table; with `columns`, for heavy per-row work, spread over the cores if need be."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if not columns:
        return df
    tasks = missing_tasks(df)
    return df.select(*columns).repartition(tasks) if tasks else df.select(*columns)
