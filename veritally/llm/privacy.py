"""Personal data in whole texts: base forms, and further spans that labelers vote for.

Native: DataFrame functions only. A text is scanned per form; places come from the lengths of the hits
and of the text between them. Base forms (email, ip, card, phone) that pass their check always count.
Candidates for more are written-out addresses, numbers without a plus, shorter cards, identity and
account numbers, IPv6 and names. Eight labelers - form, checksum, edges, gazetteer, cue words, words
that speak against it, other data in the same text, placeholders - vote -1, 0 or 1 on every candidate,
base hits and failed base hits among them. Votes are counted per kind and combination; expectation-
maximisation over that table, 3^8 rows per kind at most, estimates how reliable each labeler is. Its
posteriors are the soft labels of a naive Bayes classifier of span features, which decides. The models
have a fixed size, and are all that the driver sees.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from veritally.llm.common import staged

KINDS = ("email", "ip", "card", "phone", "id", "name")
EMAIL, IP, CARD, PHONE, ID, NAME = range(len(KINDS))
#: Characters of context that labelers see on the left.
CONTEXT = 40

# Forms. Loops are possessive and starts are looked up from behind, so that no text takes
# more than linear time or deep recursion; the matches are those of the plain forms.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    EMAIL: r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\((?:at|@)\)|\[(?:at|@)\]|\{(?:at|@)\}) ?[a-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[a-z0-9-]++)++",
    IP: r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?:(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:.])",
    CARD: r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    PHONE: r"(?<![0-9+(])(?<![0-9][\x20.-])(?:\([0-9]{2,5}\)[\x20]?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])(?![\x20.-][0-9])",
    ID: r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
    NAME: r"(?<!\p{L})\p{Lu}\p{Ll}{1,30}+ \p{Lu}\p{Ll}{1,30}+(?!\p{L})",
}
# A text that has none of these cannot have the form.
GATE = {EMAIL: r"@", IP: r"[0-9]\.[0-9]", CARD: r"[0-9]", PHONE: r"\+[0-9]"}
GATE_MORE = {EMAIL: r"(?i)[(\[{](?:at|@)[)\]}]", IP: r"[0-9A-Fa-f]:[0-9A-Fa-f:]", CARD: r"[0-9]", PHONE: r"[0-9]", ID: r"[0-9]{2}", NAME: MORE[NAME]}

# Gazetteers and context words.
DOMAINS = "com org net edu gov info io co de fr es it nl uk us eu at ch be pt se no dk fi pl cz ie ca au nz jp cn kr in br mx ar cl biz dev app".split()
PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6)"
CALLING = r"^\+?(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|35|37|38|42|67|85|88|96|97|99)"
NAMES = ("Adam Alex Alice Ana Andrea Andrew Anna Anne Antonio Barbara Ben Brian Carlos Carmen Charles Chris Christine Claire Daniel David "
         "Elena Elizabeth Emily Emma Eva Frank George Hannah Hans Helen Henry Isabel Jack James Jan Jane Jean Jennifer Jessica Jim Joan John "
         "Jorge Jose Joseph Juan Julia Karen Karl Kate Kevin Laura Linda Lisa Louis Lucas Lucy Luis Manuel Marc Marco Maria Marie Mark Martha "
         "Martin Mary Michael Miguel Monika Nancy Nicolas Nina Olivia Oscar Pablo Patricia Paul Pedro Peter Pierre Rachel Richard Robert Rosa "
         "Ruth Samuel Sandra Sara Sarah Sofia Stefan Steven Susan Thomas Tom Ursula Victor Walter William").split()
CUES = {
    EMAIL: "e-?mail|mail|contact|write|address|courriel|correo|kontakt", IP: "ip|ipv4|ipv6|host|server|address|login|client|adresse",
    CARD: "card|credit|debit|visa|mastercard|amex|payment|karte|carte|tarjeta", PHONE: "tel|telephone|phone|call|mobile|cell|fax|contact|telefon|t[ée]l[ée]phone|tel[ée]fono",
    ID: "ssn|social security|identity|id|passport|iban|account|konto|compte|cuenta", NAME: "mr|mrs|ms|miss|dr|prof|herr|frau|mme|monsieur|madame|sr|sra|se[ñn]or|name|dear|signed",
}
AGAINST = "version|order|invoice|isbn|issn|sku|ref|reference|page|chapter|section|figure|table|article|model|serial|token|hash|sha|md5|uuid"

LABELERS = 8
VOTES = (-1, 0, 1)
#: Where the estimates start, and what they are drawn to with the weight of `STRENGTH` candidates: the
#: chances of the votes -1, 0, 1 on a true span; on a false one they are reversed. The check is trusted most.
START = [[0.1, 0.3, 0.6], [0.01, 0.29, 0.7]] + [[0.1, 0.3, 0.6]] * 2 + [[0.05, 0.55, 0.4], [0.05, 0.85, 0.1], [0.05, 0.65, 0.3], [0.03, 0.92, 0.05]]
AGAINST_START = [s[::-1] for s in START[:4]] + [[0.05, 0.9, 0.05], [0.3, 0.65, 0.05], [0.05, 0.9, 0.05], [0.3, 0.67, 0.03]]
STRENGTH, ROUNDS, SMOOTH = 20.0, 30, 10.0

_FOUND = "array<struct<hit:string,s:int,e:int,left:string,right:string>>"


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)


def before(df: DataFrame, names: list[str]) -> DataFrame:
    """Turns each list of lengths `names` into lists of the sums of those before each entry.

    Lists may be long, so the sums go by blocks of the root of their number.
    """
    block = lambda c: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(c))).cast("int"))
    others = [c for c in df.columns if c not in names]
    blocked = df.select(*others, *[F.struct(F.col(c).alias("x"), block(c).alias("b")).alias(c) for c in names])
    last = lambda c: F.floor((F.size(c["x"]) - 1) / c["b"]).cast("int")
    totals = lambda c: F.transform(F.sequence(F.lit(0), last(c)), lambda k: _sum(F.slice(c["x"], k * c["b"] + 1, c["b"])))
    none = F.array().cast("array<int>")
    summed = blocked.select(*others, *[F.struct(F.col(c)["x"].alias("x"), F.col(c)["b"].alias("b"), F.when(F.size(F.col(c)["x"]) > 0, totals(F.col(c))).otherwise(none).alias("t")).alias(c) for c in names])
    whole = lambda c, i: F.floor(i / c["b"]).cast("int")
    place = lambda c: F.transform(c["x"], lambda _, i: _sum(F.slice(c["t"], F.lit(1), whole(c, i))) + _sum(F.slice(c["x"], whole(c, i) * c["b"] + 1, i % c["b"])))
    return summed.select(*others, *[place(F.col(c)).alias(c) for c in names])


def found(rows: DataFrame, forms: dict[str, tuple[str, str]]) -> DataFrame:
    """doc_id and, per form (pattern, gate), all leftmost matches of the text that do not overlap: hit,
    place in code points, and the text between it and its neighbours."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    cut = rows.select("doc_id", *[x for n, (p, gate) in forms.items() for x in (
        F.when(text.rlike(gate), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"{n}_hits"),
        F.when(text.rlike(gate), F.split(text, p, -1)).otherwise(none).alias(f"{n}_gaps"))])
    size = lambda n: F.transform(f"{n}_hits", lambda x, i: F.char_length(x) + F.char_length(F.get(f"{n}_gaps", i)))
    placed = before(cut.withColumns({f"{n}_at": size(n) for n in forms}), [f"{n}_at" for n in forms])

    def spans(n):
        gap = lambda i: F.get(f"{n}_gaps", i)
        start = lambda i: F.get(f"{n}_at", i) + F.char_length(gap(i))
        return F.transform(f"{n}_hits", lambda x, i: F.struct(
            x.alias("hit"), start(i).alias("s"), (start(i) + F.char_length(x)).alias("e"), F.right(gap(i), F.lit(CONTEXT)).alias("left"), F.left(gap(i + 1), F.lit(8)).alias("right")))

    return placed.select("doc_id", *[spans(n).cast(_FOUND).alias(n) for n in forms])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n + 1 - i, F.lit(1)).cast("int"))
    return _sum(F.transform(at, lambda d, i: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d))) % 10 == 0


def _iban(hit: Column) -> Column:
    """The remainder of an account number by 97 is 1."""
    bare = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4))
    signs = F.transform(F.sequence(F.lit(1), F.char_length(turned)), lambda i: F.substring(turned, i, F.lit(1)))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(signs, F.lit(0), step) == 1


def _check(kind: int, base: bool, hit: Column) -> Column:
    """1, 0 or -1: whether a hit passes what its kind can be checked for."""
    n = F.char_length(_digits(hit))
    fits = {
        EMAIL: F.lower(hit).rlike(r"[a-z]{2,}$"),
        IP: hit.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$") if base else hit.rlike(r"::|^(?:[^:]+:){7}[^:]+$"),
        CARD: _bind(_digits(hit), luhn), PHONE: n.between(8, 15) if base else n.between(9, 12),
        ID: F.when(hit.rlike("^[0-9]"), ~hit.rlike("^(?:000|666|9)|-00-|-0000$")).otherwise(_iban(hit)),
    }.get(kind)
    return F.lit(0) if fits is None else F.when(fits, 1).otherwise(-1)


def _votes(kind: int, base: bool, c: Column, check: Column, others: Column) -> Column:
    digits = _digits(c["hit"])
    known = {
        EMAIL: F.lower(F.regexp_extract(c["hit"], r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS), IP: ~c["hit"].rlike(r"^(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-4])\.|^::"),
        CARD: digits.rlike(PREFIXES), PHONE: c["hit"].rlike(CALLING if base else r"^\(?0?[1-9]"),
        ID: c["hit"].rlike("^(?:[0-9]|AD|AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"), NAME: F.split(c["hit"], " ")[0].isin(NAMES),
    }[kind]
    form = F.lit(1) if base or kind in (EMAIL, ID) else F.lit(0)
    glued = c["left"].rlike(r"[\p{L}\p{N}_/=#\"'-]$") | c["right"].rlike(r"^(?:[\p{L}\p{N}_/=#\"'-]|\.[\p{L}\p{N}])")
    cue = c["left"].rlike(rf"(?i)(?<!\p{{L}})(?:{CUES[kind]})(?!\p{{L}})[^\p{{L}}]{{0,12}}(?:\p{{L}}{{1,12}}[^\p{{L}}]{{1,4}})?$")
    against = c["left"].rlike(rf"(?i)(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})[^\p{{L}}]{{0,12}}$")
    mock = (F.char_length(digits) > 6) & digits.rlike(r"^([0-9])\1*$|^0?123456|^(?:0000|1111)")
    return F.array(form, check, F.when(glued, -1).otherwise(1), F.when(known, 1).otherwise(-1), F.when(cue, 1).otherwise(0),
                   F.when(against, -1).otherwise(0), F.when(others, 1).otherwise(0), F.when(mock, -1).otherwise(0))


def _class(char: Column) -> Column:
    return F.when(char.isNull() | (char == ""), "end").when(char.rlike(r"\s"), "space").when(char.rlike(r"\p{L}"), "letter").when(char.rlike(r"\p{N}"), "digit").when(char.rlike(r"[\"'`]"), "quote").when(char.rlike(r"[(\[{<)\]}>]"), "bracket").otherwise("sign")


def _features(kind: int, c: Column, check: Column) -> Column:
    """A bounded number of values of each of seven features of the span itself and its edges."""
    signs = [F.when(c["hit"].rlike(p), F.lit(s)).otherwise("") for s, p in (("s", r"\s"), ("d", "-"), ("p", r"\."), ("b", r"[(\[{]"), ("a", "@"), ("l", r"\p{L}"))]
    return F.array(F.concat(F.lit("n"), F.least(F.char_length(_digits(c["hit"])), F.lit(24)).cast("string")), F.concat(F.lit("<"), _class(F.right(c["left"], F.lit(1)))),
                   F.concat(F.lit(">"), _class(F.left(c["right"], F.lit(1)))), F.concat(F.lit("="), *signs), F.concat(F.lit("c"), check.cast("string")),
                   F.concat(F.lit("w"), F.least(F.floor(F.log2(F.char_length(c["hit"]) + F.lit(0.0))).cast("int"), F.lit(12)).cast("string")),
                   F.concat(F.lit("|"), F.regexp_extract(F.lower(c["left"]), rf"(?<!\p{{L}})({CUES[kind]})(?!\p{{L}})[^\p{{L}}]{{0,12}}$", 1)))


_SPANS = "array<struct<kind:int,s:int,e:int>>"
_CANDIDATES = "array<struct<kind:int,s:int,e:int,state:string,votes:array<int>,features:array<string>>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base spans, and all candidates with state (base, failed, more), votes and features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    hits = found(rows, {f"b{k}": (BASE[k], GATE[k]) for k in BASE} | {f"m{k}": (MORE[k], GATE_MORE[k]) for k in MORE})
    # names: only those that a title or a first name speaks for are candidates at all
    title = rf"(?i)(?<!\p{{L}})(?:{CUES[NAME]})(?!\p{{L}})[^\p{{L}}\n]{{0,4}}$"
    hits = hits.withColumn(f"m{NAME}", F.filter(f"m{NAME}", lambda c: c["left"].rlike(title) | F.split(c["hit"], " ")[0].isin(NAMES)))

    def passed(kind: int):
        whole = F.col(f"b{kind}") if kind == EMAIL else F.filter(f"b{kind}", lambda c: _check(kind, True, c["hit"]) == 1)
        return F.transform(whole, lambda c: F.struct(F.lit(kind).alias("kind"), c["s"].alias("s"), c["e"].alias("e")))

    spans = hits.withColumn("base", F.concat(*[passed(k) for k in BASE]).cast(_SPANS)).withColumn("kinds", F.array_distinct(F.transform("base", lambda b: b["kind"])))

    def judged(kind: int, is_base: bool):
        def one(c):
            others = F.size(F.array_except("kinds", F.array(F.lit(kind)))) > 0

            def full(check):
                kept = F.lit("base" if is_base else "more")
                if kind in ((IP, CARD, PHONE) if is_base else (CARD, ID)):
                    kept = F.when(check == 1, kept).otherwise("failed")
                return F.struct(F.lit(kind).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), kept.alias("state"), _votes(kind, is_base, c, check, others).alias("votes"), _features(kind, c, check).alias("features"))

            return _bind(_check(kind, is_base, c["hit"]), full)

        return F.transform(f"{'b' if is_base else 'm'}{kind}", one).cast(_CANDIDATES)

    return spans.select("doc_id", "base", F.concat(*[judged(k, True) for k in BASE], *[judged(k, False) for k in MORE]).alias("candidates"))


class Model(NamedTuple):
    """Per kind: chance of a true span, chances of the votes on true and on false spans, classifier weights."""

    prior: dict[int, float]
    true: dict[int, list[list[float]]]
    false: dict[int, list[list[float]]]
    bias: dict[int, float]
    weight: dict[tuple[int, str], float]


def _table(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def _log_odds(votes: Column, prior: Column, true: Column, false: Column) -> Column:
    parts = F.transform(votes, lambda v, l: F.log(true[l][v + 1] / false[l][v + 1]))
    return F.aggregate(parts, F.log(prior / (1 - prior)), lambda acc, x: acc + x)


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def reliabilities(votes: DataFrame) -> DataFrame:
    """kind, prior, true and false of (kind, state, votes) rows: expectation-maximisation over the counted
    vote combinations. What failed a check that disproves it is known to be false."""
    counted = votes.groupBy("kind", (F.col("state") == "failed").alias("no"), "votes").agg(F.count("*").cast("double").alias("n"))
    counted = counted.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "no", "n"))).alias("p"))

    def step(acc, _):
        def soft(x):
            chance = F.when(x["no"], 0.0).otherwise(_chance(_log_odds(x["votes"], acc["prior"], acc["true"], acc["false"])))
            return _bind(chance, lambda r: F.struct(x["votes"].alias("votes"), (x["n"] * r).alias("t"), (x["n"] * (1 - r)).alias("f")))

        def share(r, field, start):
            total = lambda keep: F.aggregate(r, F.lit(0.0), lambda a, x: a + F.when(keep(x), x[field]).otherwise(0.0))
            return F.transform(F.sequence(F.lit(0), F.lit(LABELERS - 1)), lambda l: F.transform(F.array(*map(F.lit, VOTES)), lambda v: (
                total(lambda x: x["votes"][l] == v) + STRENGTH * _table(start)[l][v + 1]) / (total(lambda x: F.lit(True)) + STRENGTH)))

        def fresh(r):
            t, f = F.aggregate(r, F.lit(0.0), lambda a, x: a + x["t"]), F.aggregate(r, F.lit(0.0), lambda a, x: a + x["f"])
            return F.struct(((t + STRENGTH / 2) / (t + f + STRENGTH)).alias("prior"), share(r, "t", START).alias("true"), share(r, "f", AGAINST_START).alias("false"))

        return _bind(F.transform("p", soft), fresh)

    start = F.struct(F.lit(0.5).alias("prior"), _table(START).alias("true"), _table(AGAINST_START).alias("false"))
    return counted.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("m")).select("kind", "m.*")


def _weight(t: float, u: float, true: float, false: float) -> float:
    """Log odds of a feature that t of the true and u of the false spans have; few spans say little:
    `SMOOTH` more of either are taken to have it as often as all together."""
    usual = SMOOTH * (t + u) / (true + false)
    return math.log((t + usual) / (true + SMOOTH)) - math.log((u + usual) / (false + SMOOTH))


def fit(found_in: DataFrame) -> Model:
    """The model of the rows of candidates(); a few hundred numbers whatever their number."""
    each = found_in.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.kind", "c.state", "c.votes", "c.features")
    rows = reliabilities(each).collect()
    prior, true, false = ({r["kind"]: r[c] for r in rows} for c in ("prior", "true", "false"))
    if not rows:
        return Model({}, {}, {}, {}, {})
    odds = functools.reduce(lambda out, k: out.when(F.col("kind") == k, _log_odds(F.col("votes"), F.lit(prior[k]), _table(true[k]), _table(false[k]))), prior, F.when(F.lit(False), F.lit(0.0)))
    soft = each.withColumn("r", F.when(F.col("state") == "failed", 0.0).otherwise(_chance(odds)))
    sums = soft.select("kind", "r", F.explode("features").alias("f")).groupBy("kind", "f").agg(F.sum("r").alias("t"), F.sum(1 - F.col("r")).alias("u")).collect()
    whole = {r["kind"]: (r["t"], r["u"]) for r in soft.groupBy("kind").agg(F.sum("r").alias("t"), F.sum(1 - F.col("r")).alias("u")).collect()}
    bias = {k: math.log((t + 1) / (u + 1)) for k, (t, u) in whole.items()}
    return Model(prior, true, false, bias, {(r["kind"], r["f"]): _weight(r["t"], r["u"], *whole[r["kind"]]) for r in sums})


def _score(c: Column, model: Model) -> Column:
    bias = F.create_map(*[F.lit(x) for kv in model.bias.items() for x in kv])
    weight = F.create_map(*[F.lit(x) for (k, f), w in model.weight.items() for x in (f"{k}{f}", w)])
    return F.aggregate(c["features"], bias[c["kind"]], lambda acc, f: acc + F.coalesce(weight[F.concat(c["kind"].cast("string"), f)], F.lit(0.0)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["s"].cast("string"), s["e"].cast("string"))), ",")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, n_email, n_ip, n_card, n_phone, base_spans and spans.

    base_spans are the base hits that pass, as kind:start:end in code points, in the order of the kinds
    and then of the places; spans has those that the classifier adds too, none of which overlaps a
    base span. A hit that its check disproves - of a base form, a checksum, an impossible number - is
    never a span, but a candidate to learn from.
    Null or empty text: no spans. Each row is judged, whatever its id. No candidates, or an empty table:
    nothing to learn and nothing added. Extra columns are not read. Texts are read once and never
    shuffled; the candidates are written once to the shared folder.
    """
    rows = staged(candidates(docs, id_col, text_col), "private-candidates")
    model = fit(rows)
    added = F.array().cast(_SPANS)
    if model.bias:
        clear = lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        added = F.filter("candidates", lambda c: (c["state"] == "more") & (_score(c, model) > 0) & clear(c))
        added = F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))).cast(_SPANS)
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in BASE], _joined(F.col("base")).alias("base_spans"), _joined(F.array_distinct(F.concat("base", added))).alias("spans"))
