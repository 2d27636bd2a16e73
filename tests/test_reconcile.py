import itertools
import random

from veritally.operators import contains, reconcile as R, tables as T

IDS = ["case_id", "doc_id", "type", "s", "raw"]
POOL = "case_id long, ord long, type string, normalized string, raw string, source_file string, location string, label string, row_label string, column_header string, from_text boolean"


def pool(spark, rows):
    out = []
    for i, r in enumerate(rows):
        r = dict(type="amount", label="", row_label="", column_header="", from_text=False) | r
        out.append((1, i, r["type"], r["normalized"], r["normalized"], "f.xlsx", f"S!B{i}", r["label"], r["row_label"], r["column_header"], r["from_text"]))
    return spark.createDataFrame(out, POOL)


def mentions(spark, rows, tables=False):
    schema = "case_id long, doc_id long, type string, s int, raw string, normalized string, context string"
    out = [(1, 1, t, i, n, n, c) for i, (t, n, c, *_) in enumerate(rows)]
    if tables:
        schema += ", row_header string, column_header string"
        out = [o + (r[3], r[4]) for o, r in zip(out, rows)]
    return spark.createDataFrame(out, schema)


def verdicts(spark, m, p):
    return [(r.verdict, r.ev.location if r.ev else None) for r in R.categorize(m, p, IDS).orderBy("s").collect()]


def test_the_five_steps(spark):
    p = pool(spark, [
        dict(normalized="21", label="참여 인원"), dict(normalized="30", label="지원 인원"),
        dict(normalized="1694", label="정기점검 실적 개소"), dict(normalized="09:00~10:00", type="time", label="회의"),
    ])
    m = mentions(spark, [
        ("amount", "21", "올해 참여 인원"), ("amount", "22", "참여 인원"), ("amount", "21", "회의 횟수도"),
        ("amount", "1694", "정기점검 실적 : ('24)"), ("time", "09:00~10:00", ""), ("time", "09:00~11:00", ""), ("phone", "1", "x")])
    assert verdicts(spark, m, p) == [
        ("match", "S!B0"), ("mismatch", "S!B0"), ("ambiguous", None), ("match", "S!B2"), ("match", "S!B3"),
        ("mismatch", "S!B3"), ("unverifiable", None)]


def test_table_context_narrows(spark):
    p = pool(spark, [
        dict(normalized="1694", label="점검", row_label="점검", column_header="2024"),
        dict(normalized="1827", label="점검", row_label="점검", column_header="2025"),
        dict(normalized="1827")])
    m = mentions(spark, [
        ("amount", "1694", "", "점검", "'24년"), ("amount", "1827", "", "점검", "'24년"), ("amount", "5", "", "점검", "2026년"),
        ("amount", "1827", "", "예산", "2025년"), ("amount", "1827", "", "정기 점검", "2025년")], tables=True)
    assert [v for v, _ in verdicts(spark, m, p)] == ["match", "mismatch", "ambiguous", "ambiguous", "match"]


SPELLINGS = ["2024", "2024년", "'24년", "２０２４년도", "(2024)", " 2024 년 ", "2024년 목표", "'24 목표", "목표", "목표 금액", "집행률", "", None]
ROW_NAMES = ["점검", "정기 점검", "점 검", "예산", "", None]


def random_case(spark, seed, n_facts, n_mentions):
    rng = random.Random(seed)
    value = lambda: str(rng.randint(1, 4))
    p = pool(spark, [dict(normalized=value(), label=rng.choice(["점검 실적", "예산 현황", ""]), row_label=rng.choice(ROW_NAMES), column_header=rng.choice(SPELLINGS)) for _ in range(n_facts)])
    m = mentions(spark, [("amount", value(), rng.choice(["점검 실적", "x"]), rng.choice(ROW_NAMES), rng.choice(SPELLINGS)) for _ in range(n_mentions)], tables=True)
    return m, p


def test_header_keys_of_tables_equal_the_agreement_of_single_headers(spark):
    """Facts that a mention's keys lead to are those whose column and row agree, compared one by one."""
    m, p = random_case(spark, 3, 40, 120)
    facts, asked = p.collect(), m.collect()
    clean = lambda x: (x or "").strip()
    heads = sorted({clean(x) for x in SPELLINGS if clean(x)})
    every = spark.createDataFrame([(1, a) for a in heads], "k int, a string")
    agree = {(r.a, r.b) for r in R.agreeing_columns(every, every.withColumnRenamed("a", "b"), ["k"]).collect()}
    bare = lambda x: "".join(clean(x).split())

    def row_ok(a, b):
        return not bare(a) or not bare(b) or bare(a) in bare(b) or bare(b) in bare(a)

    known = any(clean(f.column_header) for f in facts)

    def column_ok(a, b):
        return not (clean(a) and known) or (clean(a), clean(b)) in agree

    done = {r.s: r for r in R.categorize(m, p, IDS).collect()}
    for x in asked:
        left = {f.normalized for f in facts if column_ok(x.column_header, f.column_header) and row_ok(x.row_header, f.row_label)}
        verdict = done[x.s].verdict
        if not left:
            assert verdict == "ambiguous"
        elif len(left) == 1:
            assert verdict == ("match" if x.normalized in left else "mismatch")
        else:
            assert verdict != "match" or x.normalized in left


def test_spellings_of_a_dated_column_make_one_key(spark):
    """Rows of keys follow the headers asked, not the spellings or the product with the rows."""
    years = [f"{q}2024{w}" for q in ("", "(", "[", "<") for w in ("", "년", "년도", " ", ")", "]")]
    p = pool(spark, [dict(normalized="1", label="a", row_label=f"점검 {i}", column_header=y) for i, y in enumerate(years)])
    m = mentions(spark, [("amount", "1", "", f"점검 {i}", "'24년") for i in range(len(years))] + [("amount", "1", "", "", "2024")], tables=True)
    rows, digest = R.with_headers(m), R.pool_digest(p)
    keys = R.header_keys(rows, digest).collect()
    columns = {k.k_col for k in keys}
    assert len(columns) == 1 and len({(k.m_col, k.m_row) for k in keys}) == len(years) + 1
    pairs = {(i, j) for i in range(len(years)) for j in range(len(years)) if f"점검{i}" in f"점검{j}" or f"점검{j}" in f"점검{i}"}
    assert len(keys) == len(pairs) + 1  # row names that agree; no key for a pair that no fact has


def test_column_agreement_truth_table(spark):
    cases = [("2024년", "2024년도", True), ("2024년 목표", "2024년 실적", False), ("2024년 목표", "2024년", False),
             ("2024년 목표", "2024년 상반기 목표", False), ("2024년", "2025년", False), ("집행률", "예산 집행률", True),
             ("목표", "실적", False), ("2025년", "값", False), ("'24년", "2024", True), ("２０２４년", "2024년", True), ("'25년", "2024", False)]
    left = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(cases)], "k int, a string")
    right = spark.createDataFrame([(i, b) for i, (_, b, _) in enumerate(cases)], "k int, b string")
    got = {r.k for r in R.agreeing_columns(left, right, ["k"]).collect()}
    assert got == {i for i, (_, _, ok) in enumerate(cases) if ok}


def test_contained_pairs_equal_brute_force_both_ways(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("가나다ab ") for _ in range(n))
    texts = [(k, word(rng.randint(1, 25))) for k in (1, 2) for _ in range(60)]
    needles = [(k, word(rng.randint(1, 5))) for k in (1, 2) for _ in range(40)]
    t = spark.createDataFrame(texts, "k int, text string")
    n = spark.createDataFrame(needles, "k int, needle string")
    want = {(a, x, y) for (a, x), (b, y) in itertools.product(texts, needles) if a == b and y in x}
    for small in (0, 1000):
        got = [tuple(r) for r in contains.contained_pairs(t, n, ["k"], small).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_contained_pairs_of_needles_that_share_their_grams(spark, monkeypatch):
    # every three characters of a needle are in dozens of others, so such grams tell none apart
    needles = ["".join(p) + tail for p in itertools.product("ab", repeat=7) for tail in ("", "cdefghijklmnop")]
    texts = [f"앞 {n} 뒤" for n in needles]
    t = spark.createDataFrame([(1, x) for x in texts], "k int, text string")
    n = spark.createDataFrame([(1, x) for x in needles], "k int, needle string")
    want = {(x, y) for x in texts for y in needles if y in x}
    assert {(r.text, r.needle) for r in contains.contained_pairs(t, n, ["k"]).collect()} == want
    monkeypatch.setattr(contains.F, "contains", lambda text, needle: contains.F.lit(True))  # all that the test would see
    assert contains.contained_pairs(t, n, ["k"]).count() < 2 * len(want)


def test_ignored_only_leaves_mismatches(spark):
    v = spark.createDataFrame([("5", "match"), ("5", "mismatch"), ("6", "mismatch")], "raw string, verdict string")
    ignored = spark.createDataFrame([("5",), ("5",)], "raw string")
    assert sorted(map(tuple, R.drop_ignored(v, ignored).collect())) == [("5", "match"), ("6", "mismatch")]


def test_review_and_answers(spark):
    p = pool(spark, [dict(normalized="10", label="제재업체 수"), dict(normalized="20", label="위반업체 수"), dict(normalized="10", label="메모칸", from_text=True)])
    m = mentions(spark, [("amount", "10", "조치한 곳"), ("amount", "10", "위반업체 제재"), ("amount", "7", "위반업체 제재")])
    done = R.categorize(m, p, IDS)
    queue = R.review_queue(done, p, IDS)
    assert sorted((r.s, r.verdict, r.queue_no) for r in queue.collect()) == [(0, "ambiguous", 2), (1, "mismatch", 1)]
    choices = R.shortlist(queue, p, IDS)
    assert sorted((r.s, r.choice, r.label) for r in choices.collect()) == [
        (0, 1, "제재업체 수"), (1, 1, "위반업체 수"), (1, 2, "제재업체 수")]
    answers = m.selectExpr(*IDS, "case s when 0 then '1' else '2번' end as pick_text", "'예' as confirm_text")
    out = R.apply_answers(done, queue, choices, answers, IDS)
    assert [(r.s, r.verdict) for r in out.orderBy("s").collect()] == [(0, "match"), (1, "match"), (2, "mismatch")]


def test_summary_counts_distinct_raw_per_verdict(spark):
    v = spark.createDataFrame([(1, "5", "match"), (1, "5", "match"), (1, "5", "mismatch"), (1, "6", "ambiguous")], "case_id int, raw string, verdict string")
    r = R.verify_summary(v, ["case_id"]).collect()[0]
    assert (r.match_count, r.mismatch_count, r.unverifiable_count, r.ambiguous_count, r.total_count) == (1, 1, 0, 1, 3)


def test_table_alignment_with_merged_and_missing_tables(spark):
    text = "앞\n구분\n2024년\n2025년\n점검\n10\n20\n합\n7\n끝"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lost = [["없는", "표"], ["a", "b"]]
    grid = [["구분", "2024년", "2025년"], ["점검", "10", "20"], ["합", "7", "7"]]
    cells = [(1, t, r, c, v) for t, g in enumerate([lost, grid]) for r, row in enumerate(g) for c, v in enumerate(row)]
    g = spark.createDataFrame(cells, "doc_id long, table_no int, r int, c int, text string")
    got = sorted((text[r.s:r.e], r.row_header, r.column_header) for r in T.table_contexts(docs, g).collect())
    assert got == [("10", "점검", "2024년"), ("20", "점검", "2025년"), ("7", "합", "2024년")]


def test_fact_lists_and_label_digests_give_the_same_verdicts(spark):
    rng = random.Random(7)
    words = ["점검 실적", "예산", "참여 인원", "정기점검 실적 개소", "", " "]
    p = pool(spark, [dict(normalized=str(rng.randint(1, 6)), type=rng.choice(["amount", "date"]), label=rng.choice(words)) for _ in range(40)])
    m = mentions(spark, [(rng.choice(["amount", "date", "year"]), str(rng.randint(1, 7)), rng.choice(words) + rng.choice(["", " 올해 점검"])) for _ in range(60)])
    assert len({v for v, _ in verdicts(spark, m, p)}) == 4
    for size in (0, 18):  # no list; a list for one type only
        other = [(r.verdict, r.ev.location if r.ev else None) for r in R.categorize(m, p, IDS, small_group=size).orderBy("s").collect()]
        assert other == verdicts(spark, m, p)


def random_queue(spark, seed):
    rng = random.Random(seed)
    words = ["점검 실적", " 점검 실적", "예산", "참여 인원", "정기점검 실적 개소", "", " "]
    p = pool(spark, [dict(normalized=str(rng.randint(1, 6)), type=rng.choice(["amount", "date"]), label=rng.choice(words) + rng.choice(["", "", str(rng.randint(1, 3))]),
                          from_text=rng.random() < 0.2) for _ in range(50)])
    rows = [(rng.choice(["amount", "date", "year"]), str(rng.randint(1, 7)), rng.choice(words) + rng.choice(["", " 올해 점검", " 예산2"])) for _ in range(60)]
    m = mentions(spark, rows + rows[-1:])
    return R.with_headers(m.unionByName(m.where("s > 55"))), p  # some come twice


def test_choices_from_lists_and_from_label_digests_are_the_same(spark):
    queue, p = random_queue(spark, 11)
    digest = R.staged_digest(p)
    choices = lambda size: sorted(map(tuple, R.shortlist(queue, digest, IDS, small_group=size).collect()))
    some = choices(64)
    assert len(some) > 100 and max(r[5] for r in some) >= 4
    assert choices(0) == some and choices(20) == some  # no list; a list for one type only


def test_choices_shuffle_a_value_and_a_fact_once(spark):
    queue, p = random_queue(spark, 12)
    plan = R.shortlist(queue, R.staged_digest(p), IDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


def test_links_from_lists_and_from_pieces_are_the_same(spark):
    rng = random.Random(13)
    words = ["점검\u3000실적", " 예산 \t현황", "참여 인원", "가 나", "정기점검", "x", "", " ", None]
    labels = spark.createDataFrame([(rng.choice([1, 2, None]), rng.choice(["amount", "date"]), rng.choice(words)) for _ in range(60)], "case_id long, type string, label string")
    texts = ["", None, "올해 실적 예산", "현황 참여함", "가 나", "가나", "정기점검 x 인원", "  "]
    contexts = spark.createDataFrame([(rng.choice([1, 2, None]), rng.choice(["amount", "date"]), rng.choice(texts)) for _ in range(80)], "case_id long, type string, context string")

    def links(label, text):
        parts = [p for p in label.split() if len(p) >= 3] or [label]
        return any(p in text for p in parts)

    pairs = itertools.product(contexts.collect(), labels.collect())
    want = {(c.case_id, c.type, c.context, l.label) for c, l in pairs
            if None not in (c.case_id, c.context, l.label) and (c.case_id, c.type) == (l.case_id, l.type) and c.context and l.label and links(l.label, c.context)}
    for size in (64, 5, 0):
        got = [tuple(r) for r in R.label_links(contexts, labels, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_links_of_small_groups_look_up_no_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "contained_pairs", None)
    p, m = pool(spark, [dict(normalized="21", label="참여 인원")]), mentions(spark, [("amount", "21", "참여 인원")])
    links = R.label_links(m.select("case_id", "type", "context"), p)
    assert links._jdf.queryExecution().executedPlan().toString().count("Exchange") == 3  # contexts twice, lists
    assert [tuple(r) for r in links.collect()] == [(1, "amount", "참여 인원", "참여 인원")]


def test_issues_shuffle_values_by_report_only(spark):
    rows = [(1, 0, 3, "amount", "match", "5"), (1, 4, 9, "date", "match", "'26.3.4(월)"), (2, 4, 9, "date", "unverifiable", "y"), (None, 4, 9, "date", "ambiguous", "z"), (2, 4, 9, "amount", "mismatch", "w")]
    v = spark.createDataFrame(rows, "doc_id long, s int, e int, type string, verdict string, raw string")
    wrong = spark.createDataFrame([(1, 4, 9, "mismatch"), (1, 4, 9, "mismatch"), (1, 0, 3, "invalid_date"), (None, 4, 9, "mismatch"), (3, 1, 2, "mismatch")], "doc_id long, s int, e int, issue string")
    issues = R.issue_list(v, wrong, ["doc_id"])
    assert set(issues.columns) == {*v.columns, "colour", "issue_no"}
    assert sorted(tuple(r) for r in issues.where("doc_id is not null").select("doc_id", "raw", "colour", "issue_no").collect()) == [
        (1, "'26.3.4(월)", "red", 2), (1, "5", "blue", 1), (2, "w", "red", 1), (2, "y", "green", 2)]
    assert [r.colour for r in issues.where("doc_id is null").collect()] == ["gray"]
    plan = R.red_values(issues, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_mentions_outside_tables_are_shuffled_once(spark):
    p, m = pool(spark, [dict(normalized="21", label="참여 인원"), dict(normalized="30")]), mentions(spark, [("amount", "21", "참여 인원")])
    plan = R.categorize(m, p, IDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Broadcast" not in plan


def test_another_order_of_the_same_amount_is_no_choice_of_a_report(spark, tmp_path):
    from veritally.plans import verification as V

    rows = [(1, 7, 100.0), (2, 7, 100.0), (3, 7, 900.0)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").selectExpr(
        "*", "date'1995-03-04' as o_orderdate", "'1-URGENT' as o_orderpriority")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    code = {k: "주문 " + "a" * 7 + "abcd"[k] for k in (1, 2, 3)}
    want = [(k, 0, 1, code[k]) for k in (1, 2, 3)] + [(k, 1, c, l) for k in (1, 2) for c, l in ((1, code[k]), (2, code[3]))]
    assert sorted(map(tuple, V.shortlist(spark, str(tmp_path)).collect())) == sorted(want)
    done = {(r.doc_id, r.place): r.verdict for r in V.apply_answers(spark, str(tmp_path)).collect()}
    assert done == {(1, 0): "ambiguous", (1, 1): "match", (2, 0): "ambiguous", (2, 1): "ambiguous", (3, 0): "ambiguous", (3, 1): "match"}
