"""Small string expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from veritally.functions import fixed as X

FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def rx(pattern: str) -> str:
    """A pattern whose \\d, \\s and \\w see Unicode."""
    return "(?U)" + pattern


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(X.STRIP_CHARS))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(X.STRIP_CHARS))


def strip_chars(col: Column, chars: str) -> Column:
    return F.btrim(col, F.lit(chars))


def rstrip_chars(col: Column, chars: str) -> Column:
    return F.rtrim(col, F.lit(chars))


def blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def no_spaces(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), rx(r"\s+"), "")


def ascii_digits(col: Column) -> Column:
    wide = F.translate(col, FULL_WIDTH_DIGITS, "0123456789")
    return F.when(col.rlike("[０-９]"), wide).otherwise(col)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """One alternation instead of one scan per word; the words are literals."""
    return col.rlike("|".join("\\Q" + w + "\\E" for w in words))


def unix_lines(col: Column) -> Column:
    return F.replace(col, F.lit("\r\n"), F.lit("\n"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]*)$", 1))


def document_kind(path: Column) -> Column:
    ext = extension(path)
    kind = F.lit(None).cast("string")
    for name, exts in X.KIND_BY_EXTENSION.items():
        kind = F.when(ext.isin(*exts), name).otherwise(kind)
    return kind


def canonical_decimal(digits: Column, power: Column) -> Column:
    """Digits with an optional point, times 10**power, as an exact canonical string.

    Every unit is a power of ten, so the point is moved in the text: no float, no
    38-digit limit, never scientific notation.
    """
    whole = F.substring_index(digits, ".", 1)
    part = F.when(F.instr(digits, ".") > 0, F.substring_index(digits, ".", -1)).otherwise("")
    part = F.when(F.length(part) < power, F.rpad(part, power, F.lit("0"))).otherwise(part)
    whole = F.concat(whole, F.substring(part, F.lit(1), power))
    part = F.rtrim(F.substring(part, power + 1, F.length(part)), F.lit("0"))
    whole = F.regexp_replace(whole, r"^0+(?=[0-9])", "")
    return F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))


def canonical_number(number: Column) -> Column:
    """A DECIMAL column as the canonical string (no trailing zeros)."""
    text = number.cast("string")
    text = F.when(F.instr(text, ".") > 0, F.rtrim(text, F.lit("0"))).otherwise(text)
    return F.rtrim(text, F.lit("."))


def plain_digits(number: Column) -> Column:
    """A number written as text, also with an exponent, in canonical form with all its digits.

    The point is moved in the text; names of no number (NaN, Infinity) stay as they are.
    """
    shape = r"^-?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"

    # the lambdas name what is used more than once, so it is neither computed nor generated again
    def moved(x: Column) -> Column:
        digits, point = x["digits"], x["point"]  # the point stands after so many digits
        left = F.when(point > 0, F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0"))).otherwise("0")
        right = F.when(point >= 0, F.substring(digits, point + 1, F.length(digits))).otherwise(
            F.concat(F.repeat(F.lit("0"), -point), digits))
        both = F.concat(F.regexp_replace(left, r"^0+(?=[0-9])", ""), F.lit("."), F.rtrim(right, F.lit("0")))
        return F.rtrim(both, F.lit("."))

    def signed(x: Column) -> Column:
        return F.when(x["minus"] & (x["size"] != "0"), F.concat(F.lit("-"), x["size"])).otherwise(x["size"])

    def parts(n: Column) -> Column:
        part = lambda i: F.regexp_extract(n, shape, i)
        point = F.length(part(1)) + F.coalesce(part(3).try_cast("int"), F.lit(0))
        size = F.transform(F.array(F.struct(F.concat(part(1), part(2)).alias("digits"), point.alias("point"))), moved)[0]
        value = F.transform(F.array(F.struct(F.startswith(n, F.lit("-")).alias("minus"), size.alias("size"))), signed)[0]
        return F.when(n.rlike(shape) & n.rlike("[0-9]"), value).otherwise(n)

    return F.transform(F.array(number), parts)[0]


def column_letters(col: Column) -> Column:
    """1 -> A, 27 -> AA, 703 -> AAA (three letters is the most a sheet has)."""
    zero = col - 1
    letter = lambda n: F.chr((F.lit(65) + F.pmod(n, F.lit(26))).cast("int"))
    one = letter(zero)
    two = F.concat(letter(F.floor(zero / 26) - 1), letter(zero))
    three = F.concat(
        letter(F.floor((zero - 702) / 676)), letter(F.floor((zero - 26) / 26)), letter(zero)
    )
    return F.when(col <= 26, one).when(col <= 702, two).otherwise(three)
