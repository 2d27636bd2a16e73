"""Which needles occur inside which texts, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SMALL_GROUP = 64  # up to this many needles of a group travel with each text as an array
WHOLE = 16  # needles up to this length are looked up whole


def _grams(text: Column, n: Column) -> Column:
    count = F.length(text) - (n - 1)
    return F.when(
        count > 0,
        F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, n))),
    ).otherwise(F.array().cast("array<string>"))


def _place(gram: Column) -> Column:
    """The bit of a gram in the bitmap of its group."""
    return F.bitmap_bit_position(F.shiftrightunsigned(F.xxhash64(gram), 1))


def _in_bitmap(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, place % 8) == 1


def contained_pairs(texts: DataFrame, needles: DataFrame, keys: list[str],
                    small_group: int = SMALL_GROUP) -> DataFrame:
    """(keys, text, needle) for every needle that is a substring of a text with the same keys.

    `texts` has keys + text, `needles` has keys + needle; both are made distinct here.
    Groups with few needles carry them as an array.  In larger groups a needle of up to `WHOLE`
    characters is looked up whole, a longer one through the rarest of its grams of that length, so
    the join makes hardly a row that is no pair however large the group is and however alike its
    needles are.  A bitmap of a group's grams drops the pieces of a text that none has before
    they are shuffled; the substring test confirms the pair.
    """
    texts = texts.select(*keys, "text").where("text <> ''").distinct()
    needles = needles.select(*keys, "needle").where("needle <> ''").distinct()
    sizes = needles.groupBy(*keys).agg(F.count("*").alias("_n"))

    few = needles.join(sizes.where(F.col("_n") <= small_group).select(*keys), keys, "left_semi")
    few = few.groupBy(*keys).agg(F.collect_list("needle").alias("_needles"))
    # the outer forms keep the optimizer from repeating the whole expression as a size filter
    direct = texts.join(few, keys).select(
        *keys, "text", F.explode_outer(F.filter("_needles", lambda n: F.contains(F.col("text"), n))).alias("needle")
    ).where("needle is not null")

    big = sizes.where(F.col("_n") > small_group).select(*keys)
    many = needles.join(big, keys, "left_semi")
    whole = F.length("needle") <= WHOLE
    long = many.where(~whole).select(*keys, "needle", F.explode(_grams(F.col("needle"), F.lit(WHOLE))).alias("_gram"))
    common = long.groupBy(*keys, "_gram").agg(F.count("*").alias("_df"))
    rarest = long.join(common, [*keys, "_gram"]).groupBy(*keys, "needle").agg(
        F.min(F.struct("_df", "_gram")).getField("_gram").alias("_gram")
    )
    anchor = many.where(whole).select(*keys, "needle", F.col("needle").alias("_gram")).unionByName(rarest)
    known = anchor.groupBy(*keys).agg(
        F.collect_set(F.length("_gram")).alias("_widths"), F.bitmap_construct_agg(_place(F.col("_gram"))).alias("_bits")
    )
    pieces = F.flatten(F.transform("_widths", lambda w: _grams(F.col("text"), w)))
    grams = texts.join(known, keys).select(
        *keys, "text", F.explode_outer(F.filter(pieces, lambda g: _in_bitmap(F.col("_bits"), _place(g)))).alias("_gram")
    ).where("_gram is not null")
    through = grams.join(anchor, [*keys, "_gram"]).where(F.contains(F.col("text"), F.col("needle"))).select(
        *keys, "text", "needle"
    )
    return direct.unionByName(through)
