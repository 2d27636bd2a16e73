"""Reported values against fact pools: verdicts with evidence.

Everything a verdict needs is first reduced to digests per case and type (and per header pair),
so a mention never meets the candidates of its case one by one: it meets one digest row, and
only where that is not decisive, the few labels that occur in its own context.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritally.functions import fixed as X
from veritally.functions.text import base_name, blank, no_spaces, rx, strip
from veritally.operators.contains import SMALL_GROUP, contained_pairs
from veritally.operators.identity import column_identity
from veritally.sources.stage import staged

CASE_TYPE = ["case_id", "type"]
ANY = "\u0001any"  # header key that stands for "whatever header"
DATED = "\u0001"  # begins and parts the header key of a year and a modifier
EVIDENCE = ["ord", "source_file", "location", "normalized", "raw", "label", "from_text"]


def _clean(col: str) -> Column:
    return F.when(blank(F.col(col)), F.lit("")).otherwise(strip(F.col(col)))


def pool_digest(pool: DataFrame) -> DataFrame:
    """Distinct facts with their first occurrence; the only thing verdicts read of a pool."""
    label = F.coalesce("label", F.lit(""))
    rows = pool.select(
        *CASE_TYPE, "normalized", label.alias("label"), _clean("row_label").alias("c_row"),
        _clean("column_header").alias("c_col"), F.coalesce("from_text", F.lit(False)).alias("from_text"),
        "ord", "source_file", "location", "raw",
    )
    keys = [*CASE_TYPE, "normalized", "label", "c_row", "c_col", "from_text"]
    first = F.min(F.struct("ord", "source_file", "location", "raw")).alias("_f")
    return rows.groupBy(*keys).agg(first).select(
        *keys, F.struct(
            F.col("_f.ord").alias("ord"), F.col("_f.source_file").alias("source_file"),
            F.col("_f.location").alias("location"), F.col("normalized"), F.col("_f.raw").alias("raw"),
            F.col("label"), F.col("from_text"),
        ).alias("ev"),
    )


def needles_of(labels: DataFrame) -> DataFrame:
    """(case_id, type, label, needle): what must occur in a context for the label to link.

    Any fragment of three or more characters is enough; a label without one must occur whole.
    """
    return labels.where("label <> ''").select(*CASE_TYPE, "label", F.explode(label_needles(F.col("label"))).alias("needle"))


def label_needles(label: Column) -> Column:
    # split() compiles a pattern anew for every text, but needs none for a single character
    spaced = F.regexp_replace(strip(label), rx(r"\s+"), " ")
    parts = F.filter(F.split(spaced, " "), lambda p: F.length(p) >= X.MIN_LABEL_FRAGMENT)
    return F.when(F.size(parts) > 0, F.array_distinct(parts)).otherwise(F.array(label))


def label_links(contexts: DataFrame, labels: DataFrame, small_group: int = SMALL_GROUP) -> DataFrame:
    """(case_id, type, context, label) pairs where the label links to the context.

    A context meets the list of its group's labels, with what they are found by, if these are few; contexts of
    larger groups look up their pieces.
    """
    named = labels.where("label <> ''").select(*CASE_TYPE, "label").distinct()
    turn = Window.partitionBy(*CASE_TYPE).orderBy("label")
    few = named.withColumn("_r", F.row_number().over(turn)).where(F.col("_r") <= small_group + 1)
    lists = few.groupBy(*CASE_TYPE).agg(F.collect_list("label").alias("labels"))
    with_needles = F.transform("labels", lambda l: F.struct(l.alias("label"), label_needles(l).alias("needles")))
    lists = staged(lists.withColumn("labels", F.when(F.size("labels") <= small_group, with_needles)), "labels")
    large = lists.where("labels is null").select(*CASE_TYPE)
    texts = contexts.select(*CASE_TYPE, F.col("context").alias("text")).where("text <> ''")
    some_large = not large.isEmpty()
    if some_large:  # read by both ways
        texts = staged(texts.distinct(), "contexts")
    hit = F.filter("labels", lambda f: F.exists(f["needles"], lambda n: F.contains(F.col("text"), n)))
    # the outer form keeps the optimizer from repeating the whole expression as a size filter
    found = texts.distinct().join(lists.where("labels is not null").hint("merge"), CASE_TYPE).select(
        *CASE_TYPE, "text", F.explode_outer(F.transform(hit, lambda f: f["label"])).alias("label")).where("label is not null")
    found = found.withColumnRenamed("text", "context")
    if not some_large:
        return found
    needles = needles_of(named.join(large, CASE_TYPE, "left_semi"))
    pairs = contained_pairs(texts.join(large, CASE_TYPE, "left_semi"), needles, CASE_TYPE)
    return found.unionByName(pairs.join(needles, [*CASE_TYPE, "needle"]).select(
        *CASE_TYPE, F.col("text").alias("context"), "label"
    ).distinct())


def loose_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): texts equal but for blanks, or one inside the other.  Blank texts are left out."""
    l = left.select(*keys, "a", no_spaces(F.col("a")).alias("_a")).where("_a <> ''").distinct()
    r = right.select(*keys, "b", no_spaces(F.col("b")).alias("_b")).where("_b <> ''").distinct()
    b_in_a = contained_pairs(l.withColumnRenamed("_a", "text"), r.withColumnRenamed("_b", "needle"), keys)
    a_in_b = contained_pairs(r.withColumnRenamed("_b", "text"), l.withColumnRenamed("_a", "needle"), keys)
    both = b_in_a.select(*keys, F.col("text").alias("_a"), F.col("needle").alias("_b")).unionByName(
        a_in_b.select(*keys, F.col("needle").alias("_a"), F.col("text").alias("_b"))
    ).distinct()
    return both.join(l, [*keys, "_a"]).join(r, [*keys, "_b"]).select(*keys, "a", "b")


def agreeing_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): column headers, neither blank, that name the same column."""
    heads = left.select(F.col("a").alias("header")).unionByName(right.select(F.col("b").alias("header")))
    ident = column_identity(heads)
    l = left.select(*keys, "a").distinct().join(
        ident.select(F.col("header").alias("a"), F.col("year").alias("_y"), F.col("modifier").alias("_m")), "a")
    r = right.select(*keys, "b").distinct().join(
        ident.select(F.col("header").alias("b"), F.col("year").alias("_y"), F.col("modifier").alias("_m")), "b")
    dated = l.where("_y is not null").join(r.where("_y is not null"), [*keys, "_y", "_m"]).select(*keys, "a", "b")
    undated = loose_pairs(
        l.where("_y is null").select(*keys, F.col("a")), r.where("_y is null").select(*keys, F.col("b")), keys
    )
    return dated.unionByName(undated)


def agreement_class(headers: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): what stands for all headers that agree with a header.

    Headers with a year agree if year and modifier are equal, so these two are their class; others agree
    by containment, which is no equivalence, and stand for themselves.  A blank header is its own class.
    """
    ident = column_identity(headers.where(F.col(column) != ""), column)
    dated = F.concat(F.lit(DATED), "year", F.lit(DATED), F.coalesce("modifier", F.lit("")))
    known = ident.select(F.col("header").alias(column), F.coalesce(dated, "header").alias(name))
    return known.unionByName(headers.sparkSession.range(1).select(F.lit("").alias(column), F.lit("").alias(name)))


def _header_keys(heads: DataFrame, digest: DataFrame) -> DataFrame:
    """For every (case, type, column header, row header) of mentions, the digest keys that apply.

    A blank header on either side never blocks.  When a mention knows its column and some
    candidate knows one too, candidates without a column are out.  A column with a year has one key,
    however many spellings the candidates have, and only keys that some candidate has are returned.
    """
    cands = staged(digest.select(*CASE_TYPE, "c_col", "c_row").distinct(), "candidates")
    present = staged(_keyed(cands, True).select(*CASE_TYPE, "k_col", "k_row").distinct(), "present")
    known = cands.where("c_col <> ''").select(*CASE_TYPE).distinct().withColumn("_known", F.lit(True))
    dated = F.startswith("k_col", F.lit(DATED)) & (F.col("k_col") != ANY)
    asked = heads.where("m_col <> ''").select(*CASE_TYPE, "m_col").distinct().join(
        agreement_class(heads, "m_col", "k_col"), "m_col").select(*CASE_TYPE, "m_col", "k_col")
    loose = loose_pairs(
        asked.where(~dated).select(*CASE_TYPE, F.col("m_col").alias("a")),
        present.where(~dated & (F.col("k_col") != ANY)).select(*CASE_TYPE, F.col("k_col").alias("b")), CASE_TYPE,
    ).select(*CASE_TYPE, F.col("a").alias("m_col"), F.col("b").alias("k_col"))
    cols = asked.where(dated).unionByName(loose)
    rows = loose_pairs(
        heads.where("m_row <> ''").select(*CASE_TYPE, F.col("m_row").alias("a")),
        cands.where("c_row <> ''").select(*CASE_TYPE, F.col("c_row").alias("b")), CASE_TYPE,
    ).select(*CASE_TYPE, F.col("a").alias("m_row"), F.col("b").alias("k_row"))
    rows = rows.unionByName(
        heads.where("m_row <> ''").select(*CASE_TYPE, "m_row").distinct().withColumn("k_row", F.lit(""))
    )
    flagged = heads.join(known, CASE_TYPE, "left").withColumn(
        "_by_col", (F.col("m_col") != "") & F.coalesce("_known", F.lit(False))
    ).drop("_known")
    with_col = flagged.where("_by_col").join(cols, [*CASE_TYPE, "m_col"]).unionByName(
        flagged.where("not _by_col").withColumn("k_col", F.lit(ANY))
    ).drop("_by_col")
    keys = with_col.where("m_row <> ''").join(rows, [*CASE_TYPE, "m_row"]).unionByName(
        with_col.where("m_row = ''").withColumn("k_row", F.lit(ANY))
    )
    return keys.join(present, [*CASE_TYPE, "k_col", "k_row"], "left_semi")


def _keyed(digest: DataFrame, tables: bool) -> DataFrame:
    """The digest under every header key it can be asked by."""
    if not tables:
        return digest.withColumn("k_col", F.lit(ANY)).withColumn("k_row", F.lit(ANY))
    classed = digest.join(agreement_class(digest, "c_col", "_class"), "c_col")
    return classed.withColumn("k_col", F.explode(F.array(F.lit(ANY), "_class"))).drop("_class").withColumn(
        "k_row", F.explode(F.array(F.lit(ANY), "c_row"))
    )


def with_headers(mentions: DataFrame) -> DataFrame:
    """Mentions with m_col, m_row ('' outside tables) and the text that labels are looked for in."""
    context = F.coalesce("context", F.lit(""))
    if not has_tables(mentions):
        return mentions.select("*", F.lit("").alias("m_col"), F.lit("").alias("m_row"), context.alias("link_text"))
    row = F.coalesce("row_header", F.lit(""))
    joined = F.array_join(F.filter(F.array(context, row), lambda p: p != ""), " ")
    return mentions.select(
        "*", _clean("column_header").alias("m_col"), _clean("row_header").alias("m_row"), joined.alias("link_text"))


def has_tables(rows: DataFrame) -> bool:
    return "row_header" in rows.columns


def staged_digest(pool: DataFrame) -> DataFrame:
    """A pool's digest, written once; pass it on wherever a pool is asked for."""
    return pool if is_digest(pool) else staged(pool_digest(pool), "digest")


def is_digest(pool: DataFrame) -> bool:
    return "ev" in pool.columns


def header_keys(rows: DataFrame, digest: DataFrame) -> DataFrame:
    """Digest keys per distinct header pair of the rows; without tables one key fits all."""
    heads = rows.select(*CASE_TYPE, "m_col", "m_row").distinct()
    if has_tables(rows):
        return staged(_header_keys(staged(heads, "heads"), digest), "keys")
    return heads.withColumn("k_col", F.lit(ANY)).withColumn("k_row", F.lit(ANY))


def fact_lists(digest: DataFrame, small_group: int = SMALL_GROUP, label: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(case_id, type, low, high, first, facts): all facts of a case and type, with what their labels
    (as `label` makes them) are found by; `facts` is NULL where there are more than `small_group`.

    The rank filter runs before the shuffle, so a large case sends a few rows per task and is never gathered.
    """
    turn = Window.partitionBy(*CASE_TYPE).orderBy("ev")
    few = digest.select(*CASE_TYPE, "ev", F.row_number().over(turn).alias("_r")).where(F.col("_r") <= small_group + 1)
    value = F.col("ev.normalized")
    lists = few.groupBy(*CASE_TYPE).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.min("ev").alias("first"), F.collect_list("ev").alias("facts"))

    def found_by(ev: Column) -> Column:
        text = label(ev["label"])
        return F.struct(ev.alias("ev"), F.when(text != "", label_needles(text)).alias("needles"))

    # what can be made from a fact is made after the shuffle
    return lists.withColumn("facts", F.when(F.size("facts") <= small_group, F.transform("facts", found_by)))


Lists = namedtuple("Lists", "lists of_large")


def staged_lists(pool: DataFrame, small_group: int = SMALL_GROUP) -> Lists:
    """A pool's fact lists, written once, and the digest of its large cases, None if there are none.

    A digest that is not there yet is not written: the lists hold all of it but for large cases.
    """
    digest = pool if is_digest(pool) else pool_digest(pool)
    lists = staged(fact_lists(digest, small_group), "lists")
    large = lists.where("facts is null").select(*CASE_TYPE)
    if large.isEmpty():
        return Lists(lists, None)
    of_large = digest.join(large, CASE_TYPE, "left_semi")
    return Lists(lists, of_large if is_digest(pool) else staged(of_large, "digest"))


def large_cases(digest: DataFrame, small_group: int = SMALL_GROUP) -> DataFrame:
    """(case_id, type) of more than `small_group` facts."""
    return digest.groupBy(*CASE_TYPE).agg(F.count("*").alias("_n")).where(F.col("_n") > small_group).select(*CASE_TYPE)


def _verdict(rows: DataFrame) -> DataFrame:
    """Verdict and evidence of rows with has_type, low, high, first, linked and equal."""
    one = F.col("low") == F.col("high")
    verdict = (
        F.when(F.col("has_type").isNull(), "unverifiable")
        .when(F.col("low").isNull(), "ambiguous")
        .when(one & (F.col("normalized") == F.col("low")), "match")
        .when(one, "mismatch")
        .when(F.col("equal").isNotNull(), "match")
        .when(F.col("linked").isNotNull(), "mismatch")
        .otherwise("ambiguous")
    )
    evidence = F.when(one, F.col("first")).otherwise(F.coalesce("equal", "linked"))
    return rows.withColumn("verdict", verdict).withColumn(
        "ev", F.when(evidence.getField("source_file").isNotNull(), evidence)
    ).drop("low", "high", "first", "has_type", "linked", "equal")


def categorize(mentions: DataFrame, pool: DataFrame, mention_ids: list[str], small_group: int = SMALL_GROUP) -> DataFrame:
    """Adds verdict (match, mismatch, ambiguous, unverifiable) and the evidence struct `ev`.

    `mentions`: mention_ids (holding case_id and type), normalized, raw, context and, for values
    in table cells, row_header and column_header.  `pool`: the columns of a fact pool + case_id,
    its staged digest or, outside tables, its staged lists.  Outside tables a mention meets the list of its case's facts if these are
    few, in one join by case and type; only cases with more go through digests per label.
    """
    if has_tables(mentions):
        return _categorize_keyed(staged(with_headers(mentions), "mentions"), staged_digest(pool), mention_ids, True)
    lists, of_large = pool if isinstance(pool, Lists) else staged_lists(pool, small_group)
    rows, some_large = with_headers(mentions), of_large is not None
    if some_large:  # read by both ways
        rows = staged(rows, "mentions")
    # the lists pack well, so their size is underrated: no broadcast by a guess
    met = rows.join(lists.withColumn("has_type", F.lit(True)).hint("merge"), CASE_TYPE, "left")
    if some_large:
        met = met.where("has_type is null or facts is not null")
    hit = F.filter("facts", lambda f: F.exists(f["needles"], lambda n: F.contains(F.col("link_text"), n)))
    met = met.withColumn("_hit", F.when(F.col("low") != F.col("high"), F.transform(hit, lambda f: f["ev"]))).drop("facts")
    met = met.withColumn("linked", F.array_min("_hit")).withColumn(
        "equal", F.array_min(F.filter("_hit", lambda e: e["normalized"] == F.col("normalized")))).drop("_hit")
    done = _verdict(met)
    if not some_large:
        return done
    large = lists.where("facts is null").select(*CASE_TYPE)
    rest = rows.join(large, CASE_TYPE, "left_semi")
    return done.unionByName(_categorize_keyed(rest, of_large, mention_ids, False))


def _categorize_keyed(rows: DataFrame, digest: DataFrame, mention_ids: list[str], tables: bool) -> DataFrame:
    """categorize() of rows with headers, by digests per header pair and label."""
    keyed = _keyed(digest, tables)
    group = [*CASE_TYPE, "k_col", "k_row"]

    # one row per distinct header pair of a case and type: the narrowed values and first fact
    spread = keyed.groupBy(*group).agg(
        F.min("normalized").alias("low"), F.max("normalized").alias("high"), F.min("ev").alias("first")
    )
    heads = rows.select(*CASE_TYPE, "m_col", "m_row").distinct()
    keys = header_keys(rows, digest)
    head = [*CASE_TYPE, "m_col", "m_row"]
    narrowed = keys.join(spread, group).groupBy(*head).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")
    )
    present = spread.where(F.col("k_col") == ANY).where(F.col("k_row") == ANY).select(
        *CASE_TYPE, F.lit(True).alias("has_type")
    )
    asked = heads.join(present, CASE_TYPE, "left").join(narrowed, head, "left")
    rows = rows.join(asked, head, "left")

    open_rows = rows.where(F.col("low") != F.col("high"))
    labels = digest.where("label <> ''").select(*CASE_TYPE, "label").distinct()
    needles = needles_of(labels)
    pairs = contained_pairs(
        open_rows.select(*CASE_TYPE, F.col("link_text").alias("text")), needles, CASE_TYPE
    ).withColumnRenamed("text", "link_text")
    named = keyed.where("label <> ''").join(needles, [*CASE_TYPE, "label"])
    by_needle = named.groupBy(*group, "needle").agg(F.min("ev").alias("linked"))
    by_value = named.groupBy(*group, "needle", "normalized").agg(F.min("ev").alias("equal"))
    hits = open_rows.select(*mention_ids, *[c for c in ("normalized", "link_text", "m_col", "m_row") if c not in mention_ids])
    hits = hits.join(pairs, [*CASE_TYPE, "link_text"])
    if tables:
        hits = hits.join(keys, head)
    else:
        hits = hits.withColumn("k_col", F.lit(ANY)).withColumn("k_row", F.lit(ANY))
    found = hits.join(by_needle, [*group, "needle"]).join(by_value, [*group, "needle", "normalized"], "left")
    found = found.groupBy(*mention_ids).agg(F.min("linked").alias("linked"), F.min("equal").alias("equal"))
    return _verdict(rows.join(found, mention_ids, "left"))


def drop_ignored(verdicts: DataFrame, ignored: DataFrame) -> DataFrame:
    """Mismatches whose raw text is on the ignore list are dropped; other verdicts stay."""
    flag = ignored.select("raw").distinct().withColumn("_ignored", F.lit(True))
    return verdicts.join(flag, "raw", "left").where(
        F.col("_ignored").isNull() | (F.col("verdict") != "mismatch")
    ).drop("_ignored")


def review_queue(verdicts: DataFrame, pool: DataFrame, mention_ids: list[str],
                 ignored: DataFrame | None = None, cap: int = X.REVIEW_CAP) -> DataFrame:
    """Mismatches and ambiguous values that some named data cell of equal value could explain,
    at most `cap` per report, mismatches first."""
    digest = staged_digest(pool)
    open_rows = verdicts.where(F.col("verdict").isin("mismatch", "ambiguous"))
    if ignored is not None:
        open_rows = open_rows.join(ignored.select("raw").distinct(), "raw", "left_anti")
    named = digest.where("not from_text and trim(label) <> ''")
    if has_tables(open_rows):
        open_rows = staged(open_rows, "open")
        value = [*CASE_TYPE, "normalized", "k_col", "k_row"]
        asked = open_rows.join(header_keys(open_rows, digest), [*CASE_TYPE, "m_col", "m_row"]).join(
            _keyed(named, True).select(*value), value, "left_semi").select(*mention_ids).distinct()
        eligible = open_rows.join(asked, mention_ids, "left_semi")
    else:  # one header key fits all
        value = [*CASE_TYPE, "normalized"]
        eligible = open_rows.join(named.select(*value).hint("merge"), value, "left_semi")
    order = Window.partitionBy("case_id", "doc_id").orderBy(F.desc("verdict"), "s", "type")
    return eligible.withColumn("queue_no", F.row_number().over(order)).where(F.col("queue_no") <= cap)


def shortlist(queue: DataFrame, pool: DataFrame, mention_ids: list[str], small_group: int = SMALL_GROUP) -> DataFrame:
    """Up to six named choices per queued value: two whose label links, then four of equal value.

    Outside tables a value chooses from the list of its case's facts, as in categorize(); values of
    cases with more facts, and of table cells, go through digests per header pair and label.
    """
    everything = staged_digest(pool)
    if has_tables(queue):
        return _shortlist_keyed(staged(queue, "queue"), everything, mention_ids)
    digest = everything.where(strip(F.col("label")) != "")
    large = large_cases(digest, small_group)
    if large.isEmpty():
        return _shortlist_of_lists(queue, fact_lists(digest, small_group, strip), mention_ids)
    large = staged(large, "large")
    few = _shortlist_of_lists(queue.join(large, CASE_TYPE, "left_anti"), fact_lists(digest, small_group, strip), mention_ids)
    rest = staged(queue.join(large, CASE_TYPE, "left_semi"), "queue")
    return few.unionByName(_shortlist_keyed(rest, everything.join(large, CASE_TYPE, "left_semi"), mention_ids))


def _shortlist_of_lists(queue: DataFrame, lists: DataFrame, mention_ids: list[str]) -> DataFrame:
    """shortlist() of rows outside tables, by the list of facts of their case and type."""
    asked = ["normalized", "link_text"]
    rows = queue.select(*mention_ids, *asked).repartition(*CASE_TYPE).distinct()
    facts = lists.where("facts is not null").select(*CASE_TYPE, F.array_sort("facts").alias("facts"))
    met = rows.join(facts.hint("merge"), CASE_TYPE)
    label = lambda f: strip(f["ev"]["label"])

    def first_of_labels(facts: Column) -> Column:
        names = F.transform(facts, label)
        return F.filter(facts, lambda f, i: F.array_position(names, label(f)) == i + 1)

    same = F.filter("facts", lambda f: ~f["ev"]["from_text"] & (f["ev"]["normalized"] == F.col("normalized")))
    met = met.withColumn("_same", same)
    linked = F.filter("facts", lambda f: F.exists(f["needles"], lambda n: F.contains(F.col("link_text"), n))
                      & ~F.array_contains(F.transform("_same", label), label(f)))
    met = met.withColumn("_linked", linked)
    some = F.slice(F.concat(
        F.slice(first_of_labels(F.col("_linked")), 1, X.SHORTLIST_LINKED), F.slice(first_of_labels(F.col("_same")), 1, X.SHORTLIST_EQUAL),
    ), 1, X.SHORTLIST_CAP)
    # the outer form keeps the optimizer from repeating the whole expression as a size filter
    found = met.select(*mention_ids, F.posexplode_outer(F.transform(some, lambda f: f["ev"])).alias("_i", "_ev")).where("_ev is not null")
    return found.select(*mention_ids, (F.col("_i") + 1).alias("choice"), strip(F.col("_ev.label")).alias("label"),
                        F.col("_ev.normalized").alias("choice_value"), F.col("_ev.location").alias("choice_location"))


def _shortlist_keyed(queue: DataFrame, everything: DataFrame, mention_ids: list[str]) -> DataFrame:
    """shortlist() by digests per header pair and label."""
    digest = everything.withColumn("label", strip(F.col("label"))).where("label <> ''")
    keyed, keys = _keyed(digest, has_tables(queue)), header_keys(queue, everything)
    group = [*CASE_TYPE, "k_col", "k_row"]
    rows = queue.select(*mention_ids, *[c for c in ("normalized", "link_text", "m_col", "m_row") if c not in mention_ids])
    asked = rows.join(keys, [*CASE_TYPE, "m_col", "m_row"])

    same = keyed.where("not from_text").groupBy(*group, "normalized", "label").agg(F.min("ev").alias("ev"))
    # the first few of a digest key are enough for the first few of a mention
    top = Window.partitionBy(*group, "normalized").orderBy("ev")
    first = same.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= X.SHORTLIST_EQUAL).drop("_r")
    equal = asked.join(first, [*group, "normalized"]).groupBy(*mention_ids, "label").agg(F.min("ev").alias("ev"))

    needles = needles_of(digest.select(*CASE_TYPE, "label").distinct())
    pairs = contained_pairs(
        rows.select(*CASE_TYPE, F.col("link_text").alias("text")), needles, CASE_TYPE
    ).withColumnRenamed("text", "link_text")
    by_label = keyed.groupBy(*group, "label").agg(F.min("ev").alias("ev"))
    linked = asked.join(pairs, [*CASE_TYPE, "link_text"]).join(needles, [*CASE_TYPE, "needle"])
    taken = same.select(*group, "normalized", "label").withColumn("_same", F.lit(True))
    linked = linked.join(by_label, [*group, "label"]).join(taken, [*group, "normalized", "label"], "left")
    linked = linked.groupBy(*mention_ids, "label").agg(
        F.min("ev").alias("ev"), F.max("_same").alias("_same")
    ).where("_same is null").drop("_same")

    part = linked.withColumn("part", F.lit(1)).unionByName(equal.withColumn("part", F.lit(2)))
    within = Window.partitionBy(*mention_ids, "part").orderBy("ev")
    part = part.withColumn("_r", F.row_number().over(within)).where(
        (F.col("part") == 1) & (F.col("_r") <= X.SHORTLIST_LINKED)
        | (F.col("part") == 2) & (F.col("_r") <= X.SHORTLIST_EQUAL)
    )
    whole = Window.partitionBy(*mention_ids).orderBy("part", "_r")
    return part.withColumn("choice", F.row_number().over(whole)).where(
        F.col("choice") <= X.SHORTLIST_CAP
    ).select(*mention_ids, "choice", "label", F.col("ev.normalized").alias("choice_value"),
             F.col("ev.location").alias("choice_location"))


def parse_pick(text: Column, options: Column) -> Column:
    """The first integer of an answer if it is within 0..options, else NULL."""
    number = F.regexp_extract(text, rx(r"\d+"), 0).try_cast("bigint")
    return F.when(number.between(0, options), number.cast("int"))


def parse_yes(text: Column) -> Column:
    """True, False or NULL (not understood)."""
    t = strip(text)
    return (
        F.when(t == "", F.lit(None).cast("boolean"))
        .when(F.startswith(t, F.lit("아니")), F.lit(False))
        .when(F.startswith(t, F.lit("예")) | F.startswith(t, F.lit("네")), F.lit(True))
        .when(F.contains(t, F.lit("아니오")) | F.contains(t, F.lit("아닙니다")), F.lit(False))
        .when(F.contains(F.substring(t, F.lit(1), F.lit(10)), F.lit("예")), F.lit(True))
    )


def apply_answers(verdicts: DataFrame, queue: DataFrame, choices: DataFrame, answers: DataFrame,
                  mention_ids: list[str]) -> DataFrame:
    """Verdicts after review.  `answers`: mention_ids, pick_text, confirm_text, from any source."""
    count = choices.groupBy(*mention_ids).agg(F.max("choice").alias("_options"))
    asked = queue.where("trim(link_text) <> ''").select(*mention_ids).join(count, mention_ids)
    asked = asked.join(answers, mention_ids, "left")
    picked = asked.withColumn("choice", parse_pick(F.col("pick_text"), F.col("_options"))).withColumn(
        "_yes", parse_yes(F.col("confirm_text"))
    )
    picked = picked.join(choices, [*mention_ids, "choice"], "left").select(
        *mention_ids, F.lit(True).alias("_asked"), "_yes", "label", "choice_value", "choice_location"
    )
    rows = verdicts.join(picked, mention_ids, "left")
    settled = F.coalesce(F.col("_yes"), F.lit(False)) & F.col("choice_value").isNotNull()
    verdict = (
        F.when(F.col("_asked").isNull(), F.col("verdict"))
        .when(~settled, "ambiguous")
        .when(F.col("choice_value") == F.col("normalized"), "match")
        .otherwise("mismatch")
    )
    return rows.withColumn("verdict", verdict).withColumn(
        "resolved_label", F.when(settled, F.col("label"))
    ).withColumn("resolved_location", F.when(settled, F.col("choice_location"))).drop(
        "_asked", "_yes", "label", "choice_value", "choice_location"
    )


def evidence_notes(verdicts: DataFrame) -> DataFrame:
    """The note that names the source of a value, never the value itself."""
    place = F.concat_ws(" ", base_name(F.col("ev.source_file")), F.col("ev.location"))
    note = F.when(
        F.col("verdict") == "mismatch", F.concat(F.lit("원본에는 이 값이 없음 - 원본 출처: "), place)
    ).otherwise(F.concat(F.lit("원본 출처: "), place))
    return verdicts.where(F.col("verdict").isin("match", "mismatch") & F.col("ev").isNotNull()).withColumn("note", note)


def issue_list(verdicts: DataFrame, weekday_issues: DataFrame, report: list[str]) -> DataFrame:
    """Values of each report in text order with their colour; a wrong weekday is always red."""
    # marks of wrong weekdays lie beside the values of their report, so values are shuffled once, by report
    wrong = weekday_issues.where("issue = 'mismatch'").dropna(subset=report).select(*report, "s", "e", F.lit(True).alias("_mark"))
    rows = verdicts.withColumn("_mark", F.lit(False)).unionByName(wrong, allowMissingColumns=True).repartition(*report)
    rows = rows.withColumn("_wd", F.max("_mark").over(Window.partitionBy(*report, "s", "e"))).where("not _mark").drop("_mark")
    colour = (
        F.when(F.col("_wd"), "red").when(F.col("verdict") == "mismatch", "red")
        .when(F.col("verdict") == "match", "blue").when(F.col("verdict") == "unverifiable", "green")
        .otherwise("gray")
    )
    bucket = F.array_position(F.array(*[F.lit(v) for v in ("mismatch", "match", "unverifiable", "ambiguous")]), F.col("verdict"))
    order = Window.partitionBy(*report).orderBy("s", bucket, "type")
    return rows.withColumn("colour", colour).withColumn("issue_no", F.row_number().over(order)).drop("_wd")


def red_values(issues: DataFrame, report: list[str]) -> DataFrame:
    """Distinct red raw texts of each report in order of first appearance."""
    first = issues.where("colour = 'red'").groupBy(*report, "raw").agg(F.min("issue_no").alias("first_no"))
    order = Window.partitionBy(*report).orderBy("first_no")
    return first.withColumn("item", F.row_number().over(order))


def verify_summary(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct raw texts per verdict; one that fell into two verdicts counts in both.

    The first step keeps one row per raw text and verdict, so the count that follows is an
    ordinary sum with map-side partials and a popular key is not gathered.
    """
    distinct = verdicts.groupBy(*keys, "verdict", "raw").agg(F.lit(1).alias("_one"))
    n = lambda v: F.count(F.when(F.col("verdict") == v, F.col("_one")))
    return distinct.groupBy(*keys).agg(
        n("match").alias("match_count"), n("mismatch").alias("mismatch_count"),
        n("unverifiable").alias("unverifiable_count"), n("ambiguous").alias("ambiguous_count"),
        F.count("*").alias("total_count"),
    )
