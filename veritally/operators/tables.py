"""Tables inside reports: which cell of which grid a stretch of flat text came from."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

CONTEXT = "s int, e int, row_header string, column_header string, ord int"
_BREAK = r"\r\n|\r|\n"


def _shown(value: str | None) -> str:
    """What a cell shows; an empty cell may come as a missing number."""
    return "" if value is None or value.lower() == "nan" else value


def _pattern(values: list[str]) -> re.Pattern:
    """A grid as a pattern over lines: its cells in reading order, one group each.

    A value that stands earlier in the grid may be the copy of a merged cell and have no lines of its
    own, so its group is optional; it is possessive, as lines that are there are always taken.
    """
    seen, groups = set(), []
    for value in values:
        lines = "".join(re.escape(line.strip()) + "\n" for line in re.split(_BREAK, value))
        groups.append(f"({lines})" + ("?+" if value in seen else ""))
        seen.add(value)
    return re.compile("^" + "".join(groups), re.MULTILINE)


def _contexts_of(text: str, grids: list) -> list[tuple]:
    """Each grid is searched after the one before; the cells outside its first row and column come
    back with their lines' places in the text."""
    ends = [m.span() for m in re.finditer(_BREAK, text)]
    places = list(zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)]))
    lines = [text[s:e].strip() + "\n" for s, e in places]
    flat, starts = "".join(lines), [0, *itertools.accumulate(map(len, lines))]
    header = lambda v: " ".join(filter(None, map(str.strip, re.split(_BREAK, _shown(v)))))
    out, after = [], 0
    for grid in grids:
        cells = [(r, c, _shown(v)) for r, row in enumerate(grid) for c, v in enumerate(row)]
        found = _pattern([v for _, _, v in cells]).search(flat, after) if len(grid) > 1 and len(grid[0]) else None
        if not found:
            continue
        after = found.end()
        for group, (r, c, _) in enumerate(cells, 1):
            first, last = (bisect.bisect_left(starts, at) for at in found.span(group)) if found[group] is not None else (0, 0)
            if r and c:
                column = header(grid[0][c]) if c < len(grid[0]) else ""
                out += [(*places[i], header(grid[r][0]), column, len(out) + i - first) for i in range(first, last)]
    return out


def table_contexts(docs: DataFrame, grid_cells: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans of table cells with their headers: doc, s, e, row_header, column_header, ord.

    `docs`: doc, text.  `grid_cells`: doc, table_no, r, c, text.  The match consumes lines in
    order, which no built-in says, so it runs as a small Arrow step on one document at a time;
    Spark groups the cells and spreads the documents.
    """
    rows = grid_cells.groupBy(doc, "table_no", "r").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]).alias("cells"))
    grids = rows.groupBy(doc, "table_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda x: x["cells"]).alias("grid"))
    grids = grids.groupBy(doc).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("table_no", "grid"))), lambda x: x["grid"]).alias("grids"))
    joined = docs.select(doc, "text").join(grids, doc)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, tables in zip(batch[doc], batch["text"], batch["grids"]):
                out.extend((key, *row) for row in _contexts_of(text or "", tables))
            yield pd.DataFrame(out, columns=[doc, "s", "e", "row_header", "column_header", "ord"])

    kind = dict(docs.dtypes)[doc]
    return joined.mapInPandas(run, f"{doc} {kind}, {CONTEXT}")


def attach_contexts(mentions: DataFrame, contexts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds row_header and column_header of the first cell span that holds the mention.

    Cell spans of a document are lines and do not overlap, so the span that holds a mention is
    the last one that starts at or before it: one ordered pass per document, no range join.
    """
    marks = contexts.select(
        doc, "s", F.lit(0).alias("_kind"), F.struct(F.col("e").alias("e"), "row_header", "column_header").alias("_ctx"))
    names = [c for c in mentions.columns if c not in (doc, "s")]
    rows = mentions.select(doc, "s", F.lit(1).alias("_kind"), F.struct(*names).alias("_m"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(doc).orderBy("s", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_ctx", ignorenulls=True).over(order)
    placed = both.withColumn("_at", last).where("_kind = 1")
    inside = F.col("_at.e") >= F.col("_m.e")
    return placed.select(
        doc, "s", "_m.*", F.when(inside, F.col("_at.row_header")).alias("row_header"),
        F.when(inside, F.col("_at.column_header")).alias("column_header"),
    )
