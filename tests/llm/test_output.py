import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from tests.llm import plain
from tests.llm.conftest import ODD
from veritally.llm import ordering as O, packing as P
from veritally.llm.alignment import byte_values
from veritally.llm.mainhtml import blocks, main_content, main_text, minimum_cut
from veritally.llm.tokens import ChunkTokenizer, WordMerges, vocabulary


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB'sé1 \n\t\u3000\u0301ΣİÅ<|>!", max_size=30), max_size=5))
def test_chunks_give_the_ids_of_whole_texts(whole, texts):
    import pyarrow as pa

    texts = [*texts, "x<|endoftext|>y <|startoftext|> it's", None]
    for most in (3, 1000):
        ids, n = ChunkTokenizer(vocabulary(), most).ids(pa.array(texts, pa.string()))
        assert n.tolist() == [len(whole(t)) for t in texts]
        assert ids.tolist() == [x for t in texts for x in whole(t)]


def test_the_fast_way_gives_the_ids_of_the_tokenizer():
    with open(vocabulary()) as f:
        values, pieces = byte_values(), json.load(f)["model"]["vocab"]
    words = [bytes(values[c] for c in p.removesuffix("</w>")).decode(errors="ignore") for p in pieces]
    r = random.Random(5)
    signs = "aAbBzZ'sStTdDmMlLreRvV019.,!-'\"éÉßñÑçøÆİıſµªº²½×÷ŁłǅǄȀ\x00\x1f\x7f\x85\xa0ΣÅ中$<>|_"
    words += ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(30_000)] + ["ab'S" * 64, "ab'S" * 65, "<|endoftext|>"]
    words = [w for text in words for w in text.split(" ") if w and not any(c in "\t\n\x0b\x0c\r" for c in w)]
    t = ChunkTokenizer(vocabulary())
    assert sum(map(t.fast.knows, words)) > 50_000
    ids, n = t.encode(words)
    want = t._encode(words)
    assert n.tolist() == [len(x) for x in want] and np.array_equal(ids, np.concatenate(want))
    assert t.encode([])[1].tolist() == []
    assert WordMerges.of(vocabulary("byte_bpe_50k.json")) is None  # another form: the tokenizer's own library only


def check_packing(rows, docs, whole, capacity):
    want = Counter((i, tuple(whole(t) + [1])) for i, t in docs)
    parts, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["start"] == r["piece"] * capacity
        parts[r["doc_id"]].append((r["piece"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = defaultdict(list)
    for (i, ids), n in want.items():
        for k in range(0, len(ids), capacity):
            expected[i] += [(k // capacity, len(ids[k:k + capacity]), crc(ids[k:k + capacity]))] * n
    assert {i: sorted(x) for i, x in parts.items()} == {i: sorted(x) for i, x in expected.items()}
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("which,capacity", [("corpus", 4096), ("odd", 4096), ("corpus", 100)])
def test_packing_is_complete(request, which, capacity, whole):
    docs = request.getfixturevalue(which)
    rows = P.best_fit_pack(docs, vocabulary(), capacity).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], whole, capacity)
    assert n <= 1.03 * -(-sum(r["length"] for r in rows) // capacity) + 1


def test_empty_tables(empty, spark):
    assert P.best_fit_pack(empty, vocabulary()).collect() == []
    assert O.training_order(empty, vocabulary()).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars int")
    assert main_content(pages).collect() == []


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        for r in sorted(set(room)):
            if r >= items[i]:
                k = room.index(r)
                room[k] -= items[i]
                go(i + 1, room)
                room[k] += items[i]
        go(i + 1, [*room, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimal_packing():
    r = random.Random(4)
    for _ in range(250):
        capacity = r.choice((10, 15, 30))
        counts = Counter(r.randint(1, capacity) for _ in range(r.randint(2, 8)))
        fixed, left = P.reduce_by_dominance(dict(counts), capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(list(counts.elements()), capacity)


def test_plans_hold_every_piece_once():
    r = random.Random(5)
    for capacity in (7, 64, 4096):
        for _ in range(60):
            counts = {r.randint(1, capacity): r.choice((1, 2, 3, 50, 100_000)) for _ in range(r.randint(1, 40))}
            patterns, _ = P.plan(dict(counts), capacity)
            got = Counter()
            for pattern, n in patterns:
                assert n > 0 and 0 < sum(pattern) <= capacity
                for x in pattern:
                    got[x] += n
            assert got == counts


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 4096, 5000):
        f = O.Feistel(n, 9)
        slots = f.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (f.numbers(slots) == np.arange(n)).all()
    assert (O.Feistel(5000, 9).slots(np.arange(50)) != O.Feistel(5000, 10).slots(np.arange(50))).any()


def test_ids_beyond_a_record_are_an_error(monkeypatch):
    import pyarrow as pa

    class Wide:
        def ids(self, column):
            return np.array([65_536], np.uint32), np.array([1])

    monkeypatch.setattr(O, "tokenizer", lambda path: Wide())
    with pytest.raises(ValueError, match="65536"):
        list(O._pieces("", [pa.record_batch({"doc_id": [1], "text": ["x"]})]))


@pytest.mark.parametrize("which", ["corpus", "odd"])
def test_training_order_round_trip(request, which, spark, tmp_path, whole):
    docs = request.getfixturevalue(which)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = str(tmp_path / "order")
    rows = O.training_order(docs, vocabulary(), length=64, per_shard=100, folder=folder).collect()
    back = list(O.read_from(folder))
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and len(back) == len(rows)
    got = defaultdict(list)
    for r in rows:
        assert (r["shard"], r["record"]) == divmod(r["slot"], 100)
        assert crc(back[r["slot"]]) == r["ids_crc32"] and len(back[r["slot"]]) == r["length"]
        got[r["doc_id"]].append((r["piece"], tuple(back[r["slot"]].tolist())))
    want = defaultdict(list)
    for r in docs.collect():
        ids = whole(r["text"]) + [1]
        want[r["doc_id"]] += [(k // 64, tuple(ids[k:k + 64])) for k in range(0, len(ids), 64)]
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    for slot in (0, 99, 100, len(rows) - 1, len(rows)):
        assert [x.tolist() for x in O.read_from(folder, slot)] == [x.tolist() for x in back[slot:]]
    again = O.training_order(docs, vocabulary(), length=64, per_shard=100, folder=str(tmp_path / "again")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows)) if which == "corpus" else len(again) == len(rows)


# ---- pages

def test_minimum_cut_is_brute_force():
    r = random.Random(6)
    for _ in range(120):
        n = r.randint(1, 7)
        source, sink = ([r.choice((0, 0.5, 1, 2, 5.25)) for _ in range(n)] for _ in range(2))
        edges = [(a, b, r.choice((0.25, 1, 3))) for a in range(n) for b in range(a) if r.random() < 0.5]

        def cost(keep):
            return sum(sink[i] if k else source[i] for i, k in enumerate(keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(source, sink, edges)) == pytest.approx(best)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="page menu-open">
<header><h1>The Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work for you.</p></div>
<article class="post"><header><h1>Head &amp; title</h1></header><p>First paragraph with <b>bold</b>&nbsp;words,
 and a <a href="/x">link</a> in it.<p>Second <br>paragraph &eacute;&#233;&#x1F600; is here.
<div class="ad-box">Buy this thing now, it is cheap.</div><script>var a = "<p>no</p>";</script><ul><li>one item<li>two items</ul>
<form><p>Your mail address please.</p></form><blockquote>A quotation of some length ends it.</blockquote></article>
<section id="comments"><p>Ann: I liked this article very much, thank you.</p></section>
<aside><p>Some other thing that is at the side.</p></aside><footer><p>&copy; 2020 The Site, all rights.</p></footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE).split("\n") == [
        "Head & title", "First paragraph with bold words, and a link in it.", "Second paragraph éé\U0001f600 is here.",
        "one item", "two items", "A quotation of some length ends it."]


def test_main_text_without_article_element():
    page = PAGE.replace("article", "div")
    assert "Second paragraph" in main_text(page) and "quotation" in main_text(page)
    for x in ("Home", "cookies", "Buy", "Ann", "side", "2020", "mail", "<p>no"):
        assert x not in main_text(page)


def test_broken_pages():
    for page in (None, "", " ", "<", "<p", "<!--", "<script>x", "a < b & c", "<div class='", "</p></p>", "<p>" * 300, "x" * 50_000, "<a>" * 2000 + "t"):
        assert isinstance(main_text(page), str)
    assert [b.text for b in blocks("<p>a<p>b</div>c<td>d")] == ["a", "bc", "d"] or blocks("<p>a<p>b")


def test_main_content_rows(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, None), (2, "u", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_content(pages).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter((i, main_text(h)) for i, _, h, _ in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_article_text_of_the_given_pages(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1].replace("<br>", " ")
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert main_text(r["html"]) == "\n".join(x for x in want if x)


# ---- pipeline

def test_pipeline_against_plain_python(spark, whole, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    steps, names = [], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        steps.append(docs.collect())
        assert i == 4 or docs.columns == names
    left = {r["doc_id"] for r in steps[0]}
    assert all(any(c.isalpha() for c in rows[i]["text"] or "") for i in left) and len(left) > 0.97 * len(rows)
    groups = plain.components([(i, rows[i]["text"]) for i in left], 5, 80)
    assert {r["doc_id"] for r in steps[1]} == {i for i, _, c in groups if i == c}
    cut = {i: k for i, n, gone, k in plain.repeated([(r["doc_id"], r["text"]) for r in steps[1]], 13) if gone < n or not n}
    assert {r["doc_id"]: " ".join(plain.words(r["text"])) for r in steps[2]} == cut
    changed = [r for r in steps[2] if r["text"] != rows[r["doc_id"]]["text"]]
    assert all(r["n_chars"] == len(r["text"]) for r in changed)
    items = [" " + " ".join(plain.alnum_words(r["text"])) + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in steps[2] if any(x in " " + " ".join(plain.alnum_words(r["text"])) + " " for x in items)}
    clean = {r["doc_id"] for r in steps[3]}
    assert clean <= set(cut) and not clean & leaks and len(set(cut) - clean - leaks) <= 1
    check_packing(steps[4], [(r["doc_id"], r["text"]) for r in steps[3]], whole, 4096)


def test_pipeline_odd_rows(make, empty, spark):
    docs = make([(i, t, "aa" if (i or 0) % 2 else "bb") for i, t in ODD]).drop("item_id", "grp", "bucket")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() > 0
    docs = empty.drop("item_id", "grp", "bucket")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
