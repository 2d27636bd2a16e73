"""Messages: personal data, commands, intents, and pending clarifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritally.functions import fixed as X
from veritally.functions.text import ascii_digits, contains_any, rx
from veritally.operators import mentions as M


def intent(text: Column) -> Column:
    """The first rule that hits, after phrases that only look like keywords are removed."""
    t = reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit("")), X.NOT_KEYWORDS, text)
    hit = F.lit(None).cast("string")
    for name, words in reversed(X.INTENT_RULES):
        rule = contains_any(t, words)
        if name == "ask_archive":
            rule = rule & ~F.contains(t, F.lit(X.ATTACHMENT_WORD))
        hit = F.when(rule, name).otherwise(hit)
    return hit


def command(text: Column) -> tuple[Column, Column]:
    """(ignore, goto or NULL; item number): the ignore form is tried first."""
    number = lambda p: ascii_digits(F.nullif(F.regexp_extract(text, rx(p), 1), F.lit(""))).try_cast("bigint")
    drop, go = number(X.IGNORE_COMMAND), number(X.GOTO_COMMAND)
    return F.when(drop.isNotNull(), "ignore").when(go.isNotNull(), "goto"), F.coalesce(drop, go)


def pii_flags(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """One row per text with the kinds found, in fixed order, joined by commas; '' if none.

    Two kinds are plain tests.  An account number must not touch a phone number: only texts that
    hold one go through the span step, and their ids come back.
    """
    has_account = docs.where(F.col(text).rlike(rx(X.ACCOUNT)))
    spans = M.pattern_spans(
        has_account, ids, {"account": X.ACCOUNT, "mobile": X.MOBILE, "landline": X.LANDLINE}, text)
    touched = M.touched_by(spans, ids, F.col("name") != "account")
    free = touched.where("name = 'account' and not _hit").select(*ids).distinct().withColumn("_account", F.lit(True))
    kinds = F.array(
        F.when(F.col(text).rlike(rx(X.RESIDENT_NUMBER)), X.PII_RESIDENT),
        F.when(F.col(text).rlike(rx(X.MOBILE)), X.PII_MOBILE),
        F.when(F.col("_account"), X.PII_ACCOUNT),
    )
    return docs.join(free, ids, "left").withColumn("kinds", F.array_join(kinds, ","))


def clarify_fold(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """How each message is judged when an unroutable one waits for the next: judged, tool, pending.

    Whether message i leaves something pending depends on i-1 only through "was something
    pending", so a message either fixes the state, keeps it or flips it.  The state is therefore
    the last fixed one plus the flips since, two running aggregates in place of a fold over a
    gathered conversation.
    """
    order = Window.partitionBy(conv).orderBy(turn)
    rows = messages.withColumn("_pair", F.concat_ws(" ", F.lag("text").over(order), "text"))
    rows = rows.withColumn("_alone_tool", intent(F.col("text"))).withColumn("_pair_tool", intent(F.col("_pair")))
    fresh, joined = F.col("_alone_tool").isNull(), F.col("_pair_tool").isNull()
    flips = (fresh & ~joined).cast("int")
    rows = rows.withColumn("_flips", F.sum(flips).over(order))
    fixed = F.when(fresh == joined, F.struct(fresh.cast("int").alias("state"), F.col("_flips").alias("at")))
    rows = rows.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(order))
    state = F.coalesce(F.col("_fixed.state"), F.lit(0)) + F.col("_flips") - F.coalesce(F.col("_fixed.at"), F.lit(0))
    rows = rows.withColumn("pending", F.pmod(state, F.lit(2)) == 1)
    rows = rows.withColumn("_was", F.coalesce(F.lag("pending").over(order), F.lit(False)))
    return rows.select(
        conv, turn, F.when(F.col("_was"), F.col("_pair")).otherwise(F.col("text")).alias("judged"),
        F.when(F.col("_was"), F.col("_pair_tool")).otherwise(F.col("_alone_tool")).alias("tool"), "pending")
