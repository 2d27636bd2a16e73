"""Quality rules with risk-controlled thresholds, in DataFrame functions throughout.

Features of whole texts are counted in the row. A rule rejects a document whose feature is beyond a
cutoff. In each stratum the pairs of rule and cutoff (a fixed grid) are put into an order that is fixed
before any good label is read: by how much more often bad labelled documents are beyond the cutoff
than unlabelled ones, and only where they are at all. Step j rejects what any of the first j pairs
rejects. The good documents that a step would reject are counted, and the exact binomial tail
P(X <= k), X ~ Bin(n, risk), is the p-value of "this step rejects more than `risk` of the good
documents". Steps are tested in sequence at level alpha / strata until one fails; as every step rejects
what the one before does, the p-values rise and this is the last step at most that level. A fixed sequence
needs no correction for its length, and what is tested is the joint verdict of all rules: with probability
1 - alpha it exceeds the risk in no stratum. Of the allowed steps the one that catches most bad
documents is used, of equals the one with the fewest false rejections, and with it the steps after it
that reject no further labelled document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritally.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"
#: What is tested: a feature, and whether low or high values are suspicious.
RULES = {"word_length": "both", "symbol_share": "high", "dup_line_share": "high", "repeat_share": "high", "log_words": "both"}


#: Unlabelled documents that the share of all documents beyond a cutoff counts for.
PRIOR = 100


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside a `window`-word run that the text has twice or more."""
    def runs(h: Column) -> Column:
        """Hashes of all runs of `window` (a power of two) hashes, by doubling the length."""
        def doubled(x: Column, size: int) -> Column:
            return _bind(x, lambda y: F.zip_with(y, F.slice(y, size + 1, F.size(y)), lambda a, b: F.xxhash64(a, b)))

        size, out = 1, h
        while size < window:
            size, out = 2 * size, doubled(out, size)
        return F.slice(out, 1, F.size(h) - (window - 1))

    def covered(pairs: Column) -> Column:
        # sorted (hash, place): a neighbour with the same hash makes a repeat
        at = F.filter(pairs, lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | ((i < F.size(pairs) - 1) & (F.get(pairs, i + 1)["h"] == p["h"])))
        return _bind(F.sort_array(F.transform(at, lambda p: p["i"])), lambda s: F.aggregate(
            F.transform(s, lambda x, i: F.when(i < F.size(s) - 1, F.least(F.lit(window), F.get(s, i + 1) - x)).otherwise(F.lit(window))),
            F.lit(0).cast("long"), lambda acc, x: acc + x))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_bind(pairs, covered))

    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(_bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _bind(runs(h), counted)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, a hash and the counted features of each whole text; null text: no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    base = base.select("doc_id", "stratum", "text", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id", "stratum", F.xxhash64("text").alias("text_key"), F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.char_length(F.regexp_replace("text", "[^\n]+", "")).cast("long").alias("n_breaks"),
        _repeat_words(F.col("words"), 8).alias("n_repeat_words"),
    )


def _scores(f: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return f.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "word_length": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / (F.col("n_breaks") + 1), "repeat_share": F.col("n_repeat_words") / n, "log_words": F.log1p("n_words"),
    })


def _tests(directions: dict[str, str]) -> Column:
    """One struct per rule and side; the value is turned so that high is suspicious."""
    out = []
    for rule, side in directions.items():
        if side in ("high", "both"):
            out.append(F.struct(F.lit(f"{rule}+").alias("rule"), F.col(rule).alias("value")))
        if side in ("low", "both"):
            out.append(F.struct(F.lit(f"{rule}-").alias("rule"), (-F.col(rule)).alias("value")))
    return F.array(*out)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed term by term in logarithms; 1 if k >= n."""
    step = float(_log(p / (1 - p)))
    start = F.struct((n * F.lit(float(_log(1 - p)))).alias("t"), (n * F.lit(float(_log(1 - p)))).alias("s"))

    def add(acc, i):
        t = acc["t"] + F.log((n - i + 1) / i) + step
        top = F.greatest(t, acc["s"])
        return F.struct(t.alias("t"), (top + F.log(F.exp(t - top) + F.exp(acc["s"] - top))).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.least(k, n - 1))).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, start, add, lambda acc: acc["s"])))


def _log(x: float) -> float:
    import math

    return math.log(x)


def thresholds(scored: DataFrame, labels: DataFrame, risk: float = 0.05, alpha: float = 0.05, cutoffs: int = 64) -> DataFrame:
    """stratum, rule, cutoff of the chosen step, and its n_good, n_false, n_bad, n_caught, p_value.

    The grid of a rule is `cutoffs` quantiles of the feature over all documents, none of which looks
    at a label; the order of the steps looks at bad labels and at documents without one, so the tests
    stay valid. Labels that disagree about a document count as bad. With zero false rejections a
    stratum needs log(alpha / strata) / log(1 - risk) good documents: 59 for one stratum, 86 for four.
    """
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    grid = scored.select(F.explode(_tests(RULES)).alias("t")).select("t.*").where("value is not null")
    tails = [0.5 - 0.5 * (i + 0.5) / cutoffs for i in range(cutoffs)]
    grid = grid.groupBy("rule").agg(F.percentile_approx("value", F.array(*[F.lit(1 - t) for t in tails]), F.lit(10_000)).alias("g"))
    pairs = F.zip_with("g", F.array(*map(F.lit, tails)), lambda g, t: F.struct(g.alias("cutoff"), t.alias("tail")))
    # of equal quantiles the last has the share beyond it
    pairs = _bind(pairs, lambda x: F.filter(x, lambda g, i: (i == F.size(x) - 1) | (F.get(x, i + 1)["cutoff"] > g["cutoff"])))
    grid = staged(grid.select("rule", pairs.alias("g")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "g"))).alias("grid")), "quality-grid")
    above = F.transform(_tests(RULES), lambda t: F.struct(t["rule"].alias("rule"), F.size(F.filter(F.col("grid")[t["rule"]], lambda g: t["value"] > g["cutoff"])).alias("above")))
    seen = scored.where("not base_failed").join(label, "doc_id", "left").crossJoin(F.broadcast(grid)).select(
        "stratum", "doc_id", "text_key", F.when(F.col("quality").isNull(), "free").when(F.col("quality") > 0, "good").otherwise("bad").alias("kind"), above.alias("t"))
    # the bound is about independent draws: copies of a labelled text count once, and so do rows of one document
    labelled = seen.where("kind != 'free'").groupBy("text_key").agg(F.min(F.struct("kind", "doc_id", "stratum", "t")).alias("x")).select("text_key", "x.*")
    labelled = labelled.groupBy("doc_id").agg(F.min(F.struct("kind", "text_key", "stratum", "t")).alias("x")).select("x.stratum", "x.kind", "x.t")
    labelled = staged(labelled, "quality-labelled")
    # a document counts for every cutoff below its value: histogram first, then the sums over cutoffs
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    others = seen.where("kind = 'free'").select("stratum", "kind", "t").unionByName(labelled.where("kind = 'bad'"))
    counts = others.select("stratum", "kind", F.explode("t").alias("t")).groupBy("stratum", "t.rule", "t.above").agg(count("bad").alias("bad"), count("free").alias("free"))
    counts = counts.groupBy("stratum", "rule").agg(F.sum("bad").alias("n_bad"), F.sum("free").alias("n_free"), F.collect_list(F.struct("above", "bad", "free")).alias("h"))
    total = lambda name, i: F.aggregate(F.filter("h", lambda x: x["above"] > i), F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    tried = counts.where("n_bad > 0").crossJoin(F.broadcast(grid)).select(
        "stratum", "rule", "n_bad", "n_free", F.explode(F.transform(F.col("grid")[F.col("rule")], lambda g, i: F.struct(
            i.alias("place"), g["cutoff"].alias("cutoff"), g["tail"].alias("tail"), total("bad", i).alias("bad"), total("free", i).alias("free")))).alias("c")).select("stratum", "rule", "n_bad", "n_free", "c.*")
    lift = F.col("bad") / F.col("n_bad") / ((F.col("free") + PRIOR * F.col("tail")) / (F.col("n_free") + PRIOR))
    order = Window.partitionBy("stratum").orderBy(F.desc("lift"), F.desc("cutoff"), "rule")
    steps = staged(tried.select("stratum", "rule", "place", "cutoff", lift.alias("lift")).where("lift > 1").withColumn("step", F.row_number().over(order)), "quality-steps")
    path = steps.groupBy("stratum").agg(F.collect_list(F.struct("rule", "place", "step")).alias("path"))
    # the first step that rejects a document
    known = labelled.select("stratum", "kind", F.map_from_entries("t").alias("t")).join(F.broadcast(path), "stratum", "left")
    first = F.array_min(F.transform(F.filter("path", lambda p: F.col("t")[p["rule"]] > p["place"]), lambda p: p["step"]))
    counts = known.select("stratum", "kind", first.alias("step")).groupBy("stratum", "step").agg(count("good").alias("good"), count("bad").alias("bad"))
    counts = counts.groupBy("stratum").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("step", "good", "bad")).alias("h"))
    until = lambda name, j: F.aggregate(F.filter("h", lambda x: x["step"] <= j), F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    at = F.filter("h", lambda x: x["step"].isNotNull())
    tried = counts.select("stratum", "n_good", "n_bad", F.explode(F.transform(at, lambda x: F.struct(
        x["step"].alias("step"), F.array_min(F.transform(F.filter("h", lambda y: y["step"] > x["step"]), lambda y: y["step"])).alias("next"), until("good", x["step"]).alias("n_false"), until("bad", x["step"]).alias("n_caught")))).alias("c")).select("stratum", "n_good", "n_bad", "c.*")
    level = counts.agg((F.lit(alpha) / F.greatest(F.count("stratum"), F.lit(1))).alias("level"))
    # the tail is summed only where it can be small: k below its mean
    tested = tried.where(F.col("n_false") < F.col("n_good") * F.lit(risk)).withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), risk))
    allowed = tested.crossJoin(F.broadcast(level)).where(
        (F.col("p_value") <= F.col("level")) & (F.col("n_caught") * F.col("n_good") > F.col("n_false") * F.col("n_bad")))
    best = allowed.groupBy("stratum").agg(F.max(F.struct("n_caught", (-F.col("n_false")).alias("spared"), "step", "next", "n_good", "n_false", "n_bad", "p_value")).alias("best")).select("stratum", "best.*").drop("step")
    used = steps.join(F.broadcast(best), "stratum").where("next is null or step < next")
    return used.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), *[F.first(c).alias(c) for c in ("n_good", "n_false", "n_bad", "n_caught", "p_value")])


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, alpha: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Base counts and the verdict of the controlled rules.

    Returns per document doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 20 words, or more than 30 % of the words in repeated 8-word windows) and
    kept. Null text: no words, so base_failed. Null stratum: a stratum of its own. A stratum with too
    few labels for any bound rejects by the base rule only, as does an empty label table. Repeated
    rows each get their verdict. Empty table: empty result. Extra columns are not read. Features are
    written once to the shared folder; texts are read once and never shuffled.
    """
    scored = _scores(staged(features(docs, id_col, text_col, stratum_col), "quality-features"))
    cut = staged(thresholds(scored, labels, risk, alpha), "quality-thresholds")
    cut = cut.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    out = scored.join(cut, "stratum", "left")
    rejected = F.exists(_tests(RULES), lambda t: F.coalesce(t["value"] > F.col("cut")[t["rule"]], F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
