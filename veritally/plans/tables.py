"""Queries: sheets, fact pools and derived values."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.operators import facts as P
from veritally.operators import identity as I
from veritally.plans.registry import query
from veritally.plans.render import code, expected, frame, table
from veritally.sources import cells as C

V = expected("order_facts")
G = expected("year_grid")
CELLS = expected("cells")


@query("cells_unpivot", """
    select 'part.csv' as source_file, 'part' as sheet, cast(p_partkey + 2 as int) as row, 1 as col, 'num' as kind, cast(p_partkey as string) as text from part
    union all select 'part.csv', 'part', cast(p_partkey + 2 as int), 2, 'str', p_name from part
    union all select 'part.csv', 'part', cast(p_partkey + 2 as int), 3, 'num', cast(p_size as string) from part
    union all select 'part.csv', 'part', cast(p_partkey + 2 as int), 4, 'num', rtrim(rtrim(cast(cast(p_retailprice as decimal(38,10)) as string), '0'), '.') from part
    union all select 'orders.csv', 'orders', cast(o_orderkey + 2 as int), 1, 'date', strftime(o_orderdate, '%Y-%m-%d') from orders
    union all select 'orders.csv', 'orders', cast(o_orderkey + 2 as int), 2, 'str', o_orderpriority from orders""")
def cells_unpivot(spark, sf):
    part = C.unpivot_cells(
        table(spark, sf, "part"), F.lit("part.csv"), F.lit("part"), F.col("p_partkey") + 2,
        ["p_partkey", "p_name", "p_size", "p_retailprice"],
    )
    orders = C.unpivot_cells(
        table(spark, sf, "orders"), F.lit("orders.csv"), F.lit("orders"), F.col("o_orderkey") + 2,
        ["o_orderdate", "o_orderpriority"],
    )
    both = part.unionByName(orders)
    return both.select("source_file", "sheet", "row", "col", "kind", C.cell_raw().alias("text"))


@query("sheet_text", f"""
    with c as (select source_file, sheet, row, col, case kind when 'num' then rtrim(rtrim(cast(v_num as string), '0'), '.') when 'date' then cast(v_date as string) else v_str end as t from {CELLS} x),
    l as (select source_file, sheet, row, string_agg(t, ' | ' order by col) as line from c where row <= 500 group by all),
    m as (select source_file, sheet, max(row) as last from c group by all)
    select source_file, sheet, string_agg(line, chr(10) order by row) || case when max(last) > 500 then chr(10) || '… (이하 ' || (max(last) - 500) || '행 생략)' else '' end as text
    from l join m using (source_file, sheet) group by source_file, sheet""")
def sheet_text(spark, sf):
    return C.sheet_text(frame(spark, sf, "cells"))


@query("preview_rows", f"""
    with c as (select source_file, sheet, row, col, case kind when 'num' then rtrim(rtrim(cast(v_num as string), '0'), '.') when 'date' then cast(v_date as string) else v_str end as t from {CELLS} x),
    m as (select source_file, sheet, max(row) as r, max(col) as c from c group by all)
    select source_file, sheet, row, col, case when length(t) > 18 then substring(t, 1, 17) || '…' else t end as text from c where row <= 15 and col <= 8
    union all select source_file, sheet, 16, 1, '... 더 있음 (전체 ' || r || '행 x ' || c || '열)' from m where r > 15 or c > 8""")
def preview_rows(spark, sf):
    return C.preview_rows(frame(spark, sf, "cells"))


@query("header_rows", f"""
    select source_file, sheet, coalesce(min(case when n >= 2 then row end), 1) as header_row
    from (select source_file, sheet, row, count(*) as n from {CELLS} c group by all) group by all""")
def header_rows(spark, sf):
    return P.header_rows(C.sheet_rows(frame(spark, sf, "cells")))


@query("wide_sheets", f"""
    select source_file, sheet, count(*) as n_filled, source_file like 'years%' as wide from {CELLS} c where row = 3 group by source_file, sheet""")
def wide_sheets(spark, sf):
    rows = C.sheet_rows(P.placed(frame(spark, sf, "cells")))
    return P.header_cells(rows, P.header_rows(rows)).select(
        "source_file", "sheet", F.col("n_filled").cast("bigint").alias("n_filled"), "wide"
    )


@query("row_labels", f"""
    select source_file, sheet, row, coalesce(string_agg(v_str, ' ' order by col) filter (where kind = 'str'), '') as label
    from {CELLS} c where row > 3 group by source_file, sheet, row""")
def row_labels(spark, sf):
    return P.row_labels(frame(spark, sf, "cells"))


_LIST_SUMS = f"""
    select 'orders_' || case_id || '.xlsx' as source_file, sum(amount) as amount, sum(k % 100 + 0.5) as quantity, count(*) as n,
      bool_or(k % 40 = 0) as broken from {V} f group by case_id"""
_SUMS = f"""
    select source_file, '주문!금액(합계)' as location, cast(amount as string) as normalized, '' as column_header from ({_LIST_SUMS}) where not broken
    union all
    select source_file, '주문!수량(합계)', rtrim(rtrim(cast(cast(quantity as decimal(38,2)) as string), '0'), '.'), '' from ({_LIST_SUMS})
    union all
    select 'years_' || priority || '.xlsx', region || '!' || h || '(합계)', cast(total as string), h from (
      select priority, region, case y when 2026 then '2026' when 2027 then '''27' else '2028 목표' end as h, y, sum(total) as total, count(*) as n,
        (select count(distinct nk) from {G} b where b.priority = g.priority and b.region = g.region) as n_rows
      from {G} g group by priority, region, y) where n = n_rows"""


@query("column_sums", _SUMS)
def column_sums(spark, sf):
    data = P.data_rows(frame(spark, sf, "cells"))
    return P.column_sums(data).select("source_file", "location", "normalized", "column_header")


@query("column_avg", f"""
    select source_file, '주문!수량(평균)' as location, rtrim(rtrim(cast(cast(round_even(cast(quantity as double) / n, 2) as decimal(38,2)) as string), '0'), '.') as normalized from ({_LIST_SUMS})""")
def column_avg(spark, sf):
    data = P.data_rows(frame(spark, sf, "cells"))
    return P.column_averages(data, "수량").select("source_file", "location", "normalized")


@query("growth_rate", f"""
    with s as (select source_file, max(case when location like '%!2026(%' then cast(normalized as double) end) as a, max(case when location like '%!''27(%' then cast(normalized as double) end) as b, split_part(location, '!', 1) as sheet
      from ({_SUMS}) x where source_file like 'years%' group by source_file, split_part(location, '!', 1))
    select source_file, sheet, rtrim(rtrim(cast(cast(round_even((b - a) / a * 100, 2) as decimal(38,2)) as string), '0'), '.') as normalized, '2026→''27 증감률' as raw from s where a <> 0 and b is not null""")
def growth_rate(spark, sf):
    data = P.data_rows(frame(spark, sf, "cells"))
    return P.growth_rates(data, "2026", "'27").select("source_file", "sheet", "normalized", "raw")


_POOL = f"""
    select 'orders_' || case_id || '.xlsx' as source_file, '주문!B' || (k + 4) as location, 'amount' as type, cast(amount as string) as normalized,
      '주문 ' || code as label, '' as row_label, '' as column_header, false as from_text from {V} f where k % 40 <> 0
    union all select 'orders_' || case_id || '.xlsx', '주문!B' || (k + 4), 'amount', cast(k % 90 + 10 as string), '주문 ' || code || ' 미정 ' || (k % 90 + 10) || '건', '', '', true from {V} f where k % 40 = 0
    union all select 'orders_' || case_id || '.xlsx', '주문!C' || (k + 4), 'date', cast(dt as string), '주문 ' || code || case when k % 40 = 0 then ' 미정 ' || (k % 90 + 10) || '건' else '' end, '', '', false from {V} f
    union all select 'orders_' || case_id || '.xlsx', '주문!D' || (k + 4), 'amount', (k % 100) || '.5', '주문 ' || code || case when k % 40 = 0 then ' 미정 ' || (k % 90 + 10) || '건' else '' end, '', '', false from {V} f
    union all select 'years_' || priority || '.xlsx', region || '!' || chr(cast(64 + y - 2024 as int)) || (nk + 4), 'amount', cast(total as string), nation, nation, case y when 2026 then '2026' when 2027 then '''27' else '2028 목표' end, false from {G} g
    union all select distinct 'years_' || priority || '.xlsx', region || '!A' || (nk + 4), 'amount', cast(nk as string), nation, nation, '구분', true from {G} g
    union all select source_file, location, 'amount', normalized, '', case when column_header <> '' then '합계' else '' end, column_header, false from ({_SUMS}) s"""


@query("fact_pool", _POOL)
def fact_pool(spark, sf):
    return P.fact_pool(frame(spark, sf, "cells")).drop("ord", "raw")


@query("source_conflicts", """
    select s_nationkey as case_id, 'Sheet1!B' || (s_suppkey + 2) as location, 'amount' as type, f as source_file,
      cast(cast(floor(s_acctbal) as bigint) + case when f = '최종.xlsx' then 1 else 0 end as string) as normalized
    from supplier, (values ('초안.xlsx'), ('최종.xlsx')) t(f) where s_suppkey % 7 = 0""")
def source_conflicts(spark, sf):
    return P.source_conflicts(frame(spark, sf, "conflict_cells"), ["case_id"])


_HEADER = """case c_custkey % 6 when 0 then '20' || lpad(cast(c_custkey % 100 as string), 2, '0') || '년도 목표'
    when 1 then '(''' || lpad(cast(c_custkey % 100 as string), 2, '0') || ')' when 2 then '２０２４년 ' || c_mktsegment
    when 3 then c_mktsegment || ' 실적' when 4 then '12' || cast(10000 + c_custkey as string) else '''' || lpad(cast(c_custkey % 100 as string), 2, '0') || '년 상반기 목표' end"""


@query("column_identity", f"""
    select distinct {_HEADER} as header,
      case c_custkey % 6 when 0 then '20' || lpad(cast(c_custkey % 100 as string), 2, '0') when 1 then '20' || lpad(cast(c_custkey % 100 as string), 2, '0') when 2 then '2024' when 5 then '20' || lpad(cast(c_custkey % 100 as string), 2, '0') end as year,
      case c_custkey % 6 when 0 then '목표' when 1 then '' when 2 then c_mktsegment when 3 then c_mktsegment || '실적' when 4 then '12' || cast(10000 + c_custkey as string) else '상반기목표' end as modifier
    from customer""")
def column_identity(spark, sf):
    headers = table(spark, sf, "customer").selectExpr(f"{_HEADER} as header")
    return I.column_identity(headers)
