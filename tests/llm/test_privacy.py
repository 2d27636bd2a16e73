"""Personal data: base spans against plain patterns, estimates against a plain loop, and what is added."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veritally.llm import privacy as P
from veritally.llm.common import staged

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == P.IP:
        return all(int(x.lstrip("0")[:5] or 0) <= 255 for x in hit.split("."))
    if kind == P.CARD:
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind != P.PHONE or 8 <= len(digits) <= 15


def plain(text):
    """Counts of the base kinds, and their spans as text."""
    spans = [[(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m.group())] for k, p in enumerate(PLAIN)]
    return (*map(len, spans), ",".join(f"{P.KINDS[k]}:{s}:{e}" for k in range(4) for s, e in spans[k]))


def base(docs):
    return [tuple(r)[:6] for r in P.personal_spans(docs).collect()]


def test_base_spans_are_the_plain_patterns(corpus, odd, make):
    """The given texts, odd rows, random ones, and long ones that would be slow or deep to match naively."""
    rng = random.Random(2)
    signs = list("019@.+-() ab%_é\U0001f600\n\x01") + ["1.2.3.4", "a@b.c", "4111 1111 1111 1111", "+1 234-567-89", "255", "999."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += ["1 " * 20_000, "a" * 60_000, "a." * 30_000 + "@x.y", "1.1.1.1." * 3_000, "a@b.c_" * 3_000, "+1" + "(" * 50_000, "4111111111111111 " * 2_000, "@" * 5_000, "0" * 50_000 + ".1.1.1", "A" * 50_000, "1:" * 20_000, "Aa " * 20_000]
    docs = corpus.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(make([(10_000 + i, t) for i, t in enumerate(texts)], 4).select("doc_id", "text"))
    docs = docs.withColumns({"kind": F.lit("x"), "candidates": F.lit(1), "base": F.lit(2)})
    want = [(r["doc_id"], *plain(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert sorted(base(docs), key=repr) == sorted(want, key=repr)


def test_prefix_sums(spark):
    for n in (0, 1, 2, 3, 10, 1000):
        got = P.before(spark.range(1).select("id", F.transform(F.array_repeat(F.lit(2), n), lambda x, i: x + i).alias("x")), ["x"]).first()["x"]
        assert got == [sum(2 + j for j in range(i)) for i in range(n)]


def by_loop(rows):
    """Expectation-maximisation of (votes, failed) rows, candidate by candidate."""
    prior, true, false = 0.5, [list(x) for x in P.START], [list(x) for x in P.AGAINST_START]
    for _ in range(P.ROUNDS):
        r = []
        for v, no in rows:
            odds = prior / (1 - prior) * math.prod(true[i][x + 1] / false[i][x + 1] for i, x in enumerate(v))
            r.append(0.0 if no else odds / (1 + odds))
        t, f = sum(r), sum(1 - x for x in r)
        prior = (t + P.STRENGTH / 2) / (t + f + P.STRENGTH)
        for i in range(P.LABELERS):
            for x in P.VOTES:
                true[i][x + 1] = (sum(c for c, (v, _) in zip(r, rows, strict=True) if v[i] == x) + P.STRENGTH * P.START[i][x + 1]) / (t + P.STRENGTH)
                false[i][x + 1] = (sum(1 - c for c, (v, _) in zip(r, rows, strict=True) if v[i] == x) + P.STRENGTH * P.AGAINST_START[i][x + 1]) / (f + P.STRENGTH)
    return prior, true, false


def test_reliabilities_are_those_of_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(0, rng.random() < 0.2, [rng.choice((-1, 0, 1, 1) if rng.random() < 0.6 else (-1, -1, 0)) for _ in range(P.LABELERS)]) for _ in range(300)]
    df = spark.createDataFrame([(k, "failed" if no else "more", v) for k, no, v in rows], "kind int, state string, votes array<int>")
    got = P.reliabilities(df).first()
    prior, true, false = by_loop([(v, no) for _, no, v in rows])
    assert got["prior"] == pytest.approx(prior)
    for a, b in ((got["true"], true), (got["false"], false)):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y)


def test_classifier_weights_are_soft_counts(make):
    rows = staged(P.candidates(make([(i, f"mail me: a{i}@mail.com or 4111 1111 1111 111{i % 10} ssn 123-45-6{i:03d}") for i in range(40)])), "candidates")
    model = P.fit(rows)
    soft, held = defaultdict(Counter), defaultdict(lambda: [0.0, 0.0])
    for c in (c for r in rows.collect() for c in r["candidates"]):
        odds = math.log(model.prior[c["kind"]] / (1 - model.prior[c["kind"]])) + sum(math.log(model.true[c["kind"]][i][v + 1] / model.false[c["kind"]][i][v + 1]) for i, v in enumerate(c["votes"]))
        r = 0.0 if c["state"] == "failed" else 1 / (1 + math.exp(-odds))
        held[c["kind"]][0] += r
        held[c["kind"]][1] += 1 - r
        for f in c["features"]:
            soft[c["kind"], f].update({"t": r, "u": 1 - r})
    weight = lambda t, u, a, b: math.log((t + 10 * (t + u) / (a + b)) / (a + 10) * (b + 10) / (u + 10 * (t + u) / (a + b)))
    assert model.bias == pytest.approx({k: math.log((t + 1) / (u + 1)) for k, (t, u) in held.items()})
    assert model.weight == pytest.approx({(k, f): weight(s["t"], s["u"], *held[k]) for (k, f), s in soft.items()})


FOUND = {
    "Please e-mail jane.doe (at) mail.example.org today": "email:14:44", "write to max[at]post[dot]de now": "email:9:27",
    "Tel: 030 1234 5678 office": "phone:5:18", "call (743) 555-3824 tomorrow": "phone:5:19",
    "her ssn 219-09-9999 is on file": "id:8:19", "IBAN DE89 3704 0044 0532 0130 00 at the bank": "id:5:32",
    "card 378282246310005 was charged": "card:5:20", "server 2001:db8:85a3:0:0:8a2e:370:7334 answered": "ip:7:38",
    "signed, Dr. Maria Keller from Bonn": "name:12:24",
}
CLEAN = ["order 123-45-678 shipped", "version 1.2.3", "token = 4f:3a:22", "part 030-1234-5678-9 in stock", "The Quick fox in New Places", "a 12 b 345 c", "sku=000-12-3456", "Aa:bb: cc", "ratio 1:2:3", "at 12:30:45 sharp",
         "IBAN DE00 3704 0044 0532 0130 00", "serial 123456789012345"]


def test_further_spans_are_added_and_clean_texts_left_alone(make):
    rows = [(i, t) for i, t in enumerate(FOUND)] + [(100 + i, t) for i, t in enumerate(CLEAN)]
    both = "card 4111 1111 1111 1111 and +1 (743) 555-3824, jane (at) mail.com"
    rows += [(300 + i, both) for i in range(5)] + [(200 + i, f"words and mail{i}@mail.com, 10.0.0.{i}, +1 (743) 555-{3000 + i} and more") for i in range(20)]
    out = {r["doc_id"]: r for r in P.personal_spans(make(rows)).collect()}
    assert {t: out[i]["spans"] for i, t in enumerate(FOUND)} == FOUND
    assert {t: out[100 + i]["spans"] for i, t in enumerate(CLEAN)} == {t: "" for t in CLEAN}
    assert all(r["spans"] == r["base_spans"] for i, r in out.items() if 200 <= i < 300)
    # what is added never overlaps a base span
    assert {(r["base_spans"], r["spans"]) for i, r in out.items() if i >= 300} == {("card:5:24,phone:29:46", "email:48:66,card:5:24,phone:29:46")}


def test_nothing_to_learn(make, empty):
    assert P.personal_spans(empty).collect() == []
    assert [tuple(r) for r in P.personal_spans(make([(1, None), (None, "plain words")])).orderBy("doc_id").collect()] == [(None, 0, 0, 0, 0, "", ""), (1, 0, 0, 0, 0, "", "")]


def test_no_python_in_the_plan(corpus):
    spans = P.candidates(corpus)
    for df in (spans, P.reliabilities(spans.select(F.explode("candidates").alias("c")).select("c.*"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
