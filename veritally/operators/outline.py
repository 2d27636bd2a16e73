"""Sections of documents: outlines, reading, editing.

Paragraph tables are long: doc_id, para (from 0), text, is_table.  Everything is ordered within
one document, so all windows are bounded by a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritally.functions import fixed as X
from veritally.functions.text import rx, strip, unix_lines
from veritally.operators.rules import heading_level
from veritally.sources.stage import staged

LEVELS = len(X.HEADING_LEVELS)


def sorted_side(rows: DataFrame) -> DataFrame:
    """For joins of tables that grow with the documents: sizes are guessed from narrow or well packed
    columns, and by such a guess a side of many gigabytes goes to the driver to be broadcast."""
    return rows.hint("merge")


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A document's lines as paragraphs without tables."""
    return docs.select(doc, F.posexplode(F.split(unix_lines(F.col(text)), "\n")).alias("para", "text")).withColumn(
        "is_table", F.lit(False))


def title_box(text: Column) -> Column:
    """The title of a table that only boxes a Roman-numeral chapter title, else NULL."""
    cells = F.filter(F.transform(F.split(unix_lines(text), "\n"), strip), lambda c: c != "")
    joined = F.array_join(cells, " ")
    title = F.concat(
        F.regexp_extract(joined, rx(X.ROMAN_TITLE), 1), F.lit(". "),
        strip(F.regexp_extract(joined, rx(X.ROMAN_TITLE), 2)),
    )
    return F.when((F.size(cells) <= X.TITLE_BOX_MAX_CELLS) & joined.rlike(rx(X.ROMAN_TITLE)), title)


def outline(paras: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per section: section_id, kind, level, para, title, body_start, body_end, table_index."""
    text = F.col("text")
    rows = paras.withColumn("_box", F.when(F.col("is_table"), title_box(text)))
    rows = rows.withColumn(
        "level", F.when(F.col("is_table"), F.when(F.col("_box").isNotNull(), F.lit(0))).otherwise(heading_level(text))
    )
    first_row = F.slice(F.filter(F.split(unix_lines(text), "\n"), lambda c: c != ""), 1, 4)
    title = (
        F.when(F.col("_box").isNotNull(), F.col("_box"))
        .when(F.col("is_table"), F.concat(F.lit("[표] "), F.array_join(first_row, " | ")))
        .otherwise(F.substring(strip(text), F.lit(1), F.lit(X.TITLE_CHARS)))
    )
    # the windows see titles, not whole texts, and all of them one order
    rows = rows.select(doc, "para", "is_table", "level", title.alias("title"))
    after = Window.partitionBy(doc).orderBy(F.desc("para")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(doc)
    # the next heading at or above each level, as running minima from the end of the document
    nearest = reduce(
        lambda acc, lv: F.when(
            F.col("level") == lv, F.min(F.when(F.col("level") <= lv, F.col("para"))).over(after)
        ).otherwise(acc),
        range(LEVELS), F.lit(None).cast("int"),
    )
    tables = F.col("is_table").cast("int")
    rows = rows.withColumn("_next", nearest).withColumn("_tables", F.coalesce(F.sum(tables).over(after), F.lit(0)))
    rows = rows.withColumn("_any", F.coalesce(F.max(F.col("level").isNotNull()).over(whole), F.lit(False)))
    rows = rows.withColumn("_last", F.max("para").over(whole)).withColumn(
        "table_index", F.when(F.col("is_table"), F.sum(tables).over(whole) - F.col("_tables") - 1))
    rows = rows.withColumn("_end", F.coalesce(F.col("_next") - 1, F.col("_last")))
    heading = F.col("level").isNotNull()
    plain_table = F.col("is_table") & ~heading
    fallback = ~F.col("_any") & ~F.col("is_table") & (F.col("title") != "")
    kept = rows.where(heading | plain_table | fallback)
    body = heading & (F.col("_end") > F.col("para"))
    return kept.select(
        doc, F.concat(F.lit("s"), F.col("para").cast("string")).alias("section_id"),
        F.when(plain_table, "table").when(F.col("_any"), "heading").otherwise("paragraph").alias("kind"),
        "level", "para", "title", F.when(body, F.col("para") + 1).alias("body_start"),
        F.when(body, F.col("_end")).alias("body_end"), "table_index",
    )


def outline_text(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The outline of each document as indented lines."""
    span = F.when(
        F.col("body_start").isNotNull(),
        F.format_string(" (본문 문단 %d~%d)", "body_start", "body_end"),
    ).otherwise("")
    line = F.concat(
        F.repeat(F.lit("  "), F.least(F.coalesce("level", F.lit(0)), F.lit(4))),
        F.lit("["), "section_id", F.lit("] "), "title", span,
    )
    lines = sections.select(doc, "para", line.alias("line"))
    return lines.groupBy(doc).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "line"))), lambda x: x["line"]), "\n").alias("text")
    )


def section_of_paragraph(paras: DataFrame, sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The section of each paragraph: its own, else the deepest one whose body holds it.

    Headings nest, so the last section that starts before a paragraph at each level is found by
    running maxima and the innermost whose body still reaches the paragraph is taken.
    """
    marks = sections.select(doc, "para", "section_id", "body_end", "level").where(F.col(doc).isNotNull())
    none = lambda c: F.lit(None).cast(marks.schema[c].dataType).alias(c)
    # sections and paragraphs in one order, so nothing is joined; a section comes before its own paragraph
    rows = paras.select(doc, "para", none("section_id"), none("body_end"), none("level"))
    rows = marks.withColumn("_is", F.lit(False)).unionByName(rows.withColumn("_is", F.lit(True)))
    before = Window.partitionBy(doc).orderBy("para", "_is").rowsBetween(Window.unboundedPreceding, -1)
    own = F.max(F.when(~F.col("_is"), F.struct("para", "section_id"))).over(before)
    open_at = [
        F.max(F.when((F.col("level") == lv) & F.col("body_end").isNotNull(),
                     F.struct("para", "body_end", "section_id"))).over(before).alias(f"_o{lv}")
        for lv in range(LEVELS)
    ]
    rows = rows.select("*", own.alias("_own"), *open_at).where("_is")
    holding = F.filter(F.array(*[f"_o{lv}" for lv in range(LEVELS)]), lambda o: o["body_end"] >= F.col("para"))
    itself = F.when(F.col("_own.para") == F.col("para"), F.col("_own.section_id"))
    return rows.select(doc, "para", F.coalesce(itself, F.array_max(holding).getField("section_id")).alias("section_id"))


def read_section(paras: DataFrame, sections: DataFrame, wanted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Title and body text of the wanted sections (doc, section_id); unknown ones have an error.

    `text` of a table paragraph is its grid text, so tables read inline.
    """
    asked = wanted.join(sorted_side(sections), [doc, "section_id"], "left")
    body = F.explode_outer(F.when(F.col("body_start").isNotNull(), F.sequence("body_start", "body_end")))
    spread = asked.select(doc, "section_id", F.col("para").alias("_head"), body.alias("_p"))
    texts = paras.select(doc, F.col("para").alias("_p"), "text")
    lines = spread.join(sorted_side(texts), [doc, "_p"], "left").groupBy(doc, "section_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "text")))), lambda x: x["text"]), "\n").alias("body"))
    heads = asked.join(sorted_side(paras.select(doc, "para", F.col("text").alias("_t"))), [doc, "para"], "left")
    error = F.when(F.col("para").isNull(), F.concat(F.lit("구간 "), "section_id", F.lit("이(가) 없습니다")))
    title = F.when(F.col("kind") == "table", F.col("title")).otherwise(strip(F.col("_t")))
    return heads.select(doc, "section_id", title.alias("title"), error.alias("error"),
                        F.when(F.col("kind") == "table", F.col("_t")).alias("_table")).join(
        sorted_side(lines), [doc, "section_id"]).withColumn("body", F.coalesce("_table", "body")).drop("_table")


def leading_blanks(text: Column) -> Column:
    return F.regexp_extract(text, f"^[{X.INDENT_CHARS}]*", 0)


def common_indent(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The longest blank prefix that all non-blank lines of a group share.

    The common prefix of a set of strings is that of its least and its greatest, so two partial
    aggregates are enough.
    """
    indent = F.when(strip(F.col(text)) != "", leading_blanks(F.col(text)))
    ends = lines.groupBy(*keys).agg(F.min(indent).alias("_a"), F.max(indent).alias("_b"))
    size = F.least(F.length("_a"), F.length("_b"))
    same = F.filter(F.sequence(F.lit(0), size), lambda n: F.startswith(F.col("_b"), F.substring(F.col("_a"), F.lit(1), n)))
    prefix = F.substring(F.col("_a"), F.lit(1), F.array_max(same))
    return ends.select(*keys, F.coalesce(prefix, F.lit("")).alias("indent"))


def apply_edits(paras: DataFrame, sections: DataFrame, edits: DataFrame,
                doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Applies edits(doc, section_id, mode, text), any number per document.

    The log also says where the edit stands in the result: its lines are the `n_new` paragraphs from
    `new_para` on, in place of `n_old` paragraphs. An edit whose paragraphs meet those of an earlier one of its document (by place, then section,
    mode and text) is refused (replacements go first). Returns (paragraphs renumbered, log with applied, reason, before, after).
    """
    lines = F.split(F.regexp_replace(unix_lines(F.col("new_text")), "\r+(?=\n|\\z)", ""), "\n")
    asked = edits.select(doc, "section_id", "mode", F.col("text").alias("new_text")).join(
        sorted_side(sections.drop("title", "table_index", "level")), [doc, "section_id"], "left")
    asked = asked.withColumn("_lines", lines).withColumn("_end", F.coalesce("body_end", "para"))
    asked = asked.withColumn(
        "_from", F.when(F.col("mode") == "replace", F.col("para")).when(F.col("mode") == "replace_body", F.col("body_start")))
    asked = asked.withColumn(
        "_b0", F.when(F.col("mode").isin("replace", "replace_body"), F.col("_from")).when(F.col("mode") == "append", F.col("body_start")))

    turn = Window.partitionBy(doc).orderBy(F.coalesce("_from", "_end"), F.col("_from").isNull(), "_end", "section_id", "mode", "new_text")
    asked = asked.withColumn("_edit", F.row_number().over(turn))
    before = Window.partitionBy(doc).orderBy("_edit").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("_overlap", F.coalesce(F.coalesce("_from", "_end") <= F.max("_end").over(before), F.lit(False)))

    # what each edit covers: its old text, its indent and whether a table is in the way
    keyed = paras.join(sorted_side(asked.select(doc, "_edit", "_b0", "_end", "mode")), doc)
    covered = keyed.where(F.col("para").between(F.col("_b0"), F.col("_end")))
    facts = covered.groupBy(doc, "_edit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n").alias("before"),
        F.max(F.col("is_table") & F.col("mode").isin("replace", "replace_body")).alias("_table"))
    asked = asked.join(sorted_side(facts), [doc, "_edit"], "left").join(sorted_side(common_indent(covered, [doc, "_edit"])), [doc, "_edit"], "left")
    reason = (
        F.when(~F.col("mode").isin(*X.EDIT_MODES), F.concat(F.lit("알 수 없는 mode: "), "mode"))
        .when(F.col("para").isNull(), F.concat(F.lit("구간 "), "section_id", F.lit("이(가) 없습니다")))
        .when(F.col("kind") == "table", "표 구간은 이 부품으로 쓸 수 없습니다(표 도구를 쓰세요)")
        .when(~F.exists("_lines", lambda l: strip(l) != ""), "쓸 내용이 비어 있습니다")
        .when(F.col("_table"), "교체 범위 안에 표가 있어 덮어쓰지 않았습니다")
        .when(F.col("_overlap"), "앞의 수정과 범위가 겹칩니다")
    )
    keep = F.coalesce(F.when(F.col("mode").isin("replace_body", "append"), F.col("indent")), F.lit(""))
    own = lambda l: (strip(l) == "") | F.substring(l, 1, 1).isin(*X.INDENT_CHARS)
    asked = asked.withColumn("reason", reason).withColumn(
        "_lines", F.transform("_lines", lambda l: F.when(own(l), l).otherwise(F.concat(keep, l))))
    # the log, the removed range and the new lines all read it
    asked = staged(asked.withColumn("applied", F.col("reason").isNull()), "edits")
    # new lines stand where the old ones were, or after the heading or the section's end
    at = F.when(F.col("_from").isNotNull(), F.col("_from")).when(F.col("mode") == "replace_body", F.col("para")).otherwise(F.col("_end"))
    n_new, n_old = F.size("_lines"), F.when(F.col("_from").isNotNull(), F.col("_end") - F.col("_from") + 1).otherwise(0)
    placed = asked.withColumns({"_at": at, "_n_new": n_new, "_n_old": n_old})
    earlier = Window.partitionBy(doc, "applied").orderBy("_at", "_edit").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("_n_new") - F.col("_n_old")).over(earlier), F.lit(0))
    placed = placed.withColumn("_new", (F.col("_at") + F.when(F.col("_from").isNull(), 1).otherwise(0) + moved).cast("int"))
    held = lambda c: F.when(F.col("applied"), F.col(c))
    log = placed.select(
        doc, "section_id", "mode", "applied", "reason",
        F.when(F.col("applied"), F.coalesce("before", F.lit(""))).alias("before"),
        F.when(F.col("applied"), F.array_join("_lines", "\n")).alias("after"),
        held("_new").alias("new_para"), held("_n_new").alias("n_new"), held("_n_old").cast("int").alias("n_old"),
    )

    good = asked.where("applied")
    gone = good.where("_from is not null").select(doc, F.col("_from"), F.col("_end"))
    kept = paras.alias("p").join(sorted_side(gone.alias("g")), (F.col(f"p.{doc}") == F.col(f"g.{doc}")) & F.col("p.para").between(F.col("g._from"), F.col("g._end")), "left_anti")
    kept = kept.select(doc, F.col("para").alias("_at"), F.lit(0).alias("_k"), "text", "is_table")
    new = good.select(doc, at.alias("_at"), F.posexplode("_lines").alias("_k", "text")).select(
        doc, "_at", (F.col("_k") + 1).alias("_k"), "text", F.lit(False).alias("is_table"))
    order = Window.partitionBy(doc).orderBy("_at", "_k")
    result = kept.unionByName(new).select(
        doc, (F.row_number().over(order) - 1).alias("para"), "text", "is_table")
    return result, log


def revert_edits(paras: DataFrame, log: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Takes applied edits of apply_edits() back: (paragraphs renumbered, proposals with state).

    The log's places are those of the version the edits made, so what one edit moved does not matter to
    the next. A proposal's state is `reverted`; `no_target` if the edit's lines are not there any more;
    `no_change` if they are what was there before. Edits that were refused give no proposal. Only the
    lines an edit wrote are touched; without an edit a document stays as it is.
    """
    undo = log.where("applied").select(doc, "section_id", "mode", "before", "after", "new_para", "n_new", "n_old")
    last = F.col("new_para") + F.col("n_new") - 1
    now = paras.join(sorted_side(undo.select(doc, "new_para", "n_new")), doc).where(F.col("para").between(F.col("new_para"), last))
    now = now.groupBy(doc, "new_para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n").alias("_now"), F.bool_or("is_table").alias("_table"))
    same = (F.col("n_old") == F.col("n_new")) & (F.col("before") == F.col("after"))
    state = F.when(F.col("_now").isNull() | (F.col("_now") != F.col("after")) | F.col("_table"), "no_target").when(same, "no_change").otherwise("reverted")
    proposals = staged(undo.join(sorted_side(now), [doc, "new_para"], "left").withColumn("state", state).drop("_now", "_table"), "reverts")
    good = proposals.where("state = 'reverted'")
    gone = good.select(F.col(doc).alias("_doc"), "new_para", last.alias("_last"))
    kept = paras.join(sorted_side(gone), (F.col(doc) == F.col("_doc")) & F.col("para").between(F.col("new_para"), F.col("_last")), "left_anti")
    old = good.where("n_old > 0").select(doc, F.col("new_para").alias("_at"), F.posexplode(F.split("before", "\n")).alias("_k", "text"))
    both = kept.select(doc, F.col("para").alias("_at"), F.lit(0).alias("_k"), "text", "is_table").unionByName(
        old.select(doc, "_at", (F.col("_k") + 1).alias("_k"), "text", F.lit(False).alias("is_table")))
    order = Window.partitionBy(doc).orderBy("_at", "_k")
    return both.select(doc, (F.row_number().over(order) - 1).alias("para"), "text", "is_table"), proposals
