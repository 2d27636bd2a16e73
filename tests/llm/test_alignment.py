"""Token alignment against a plain version on each text's bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD
from veritally.llm import alignment as A
from veritally.llm.tokens import vocabulary

A_PATH, B_PATH = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    values = A.byte_values()
    a_bytes = {i: bytes(values[c] for c in p) for p, i in a.get_vocab().items() if not p.startswith("<|end")}
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, a_bytes, b_bytes


def plain(rows, tokenizers):
    """Every pair of tokens is looked at by their byte ranges; no windows."""
    ta, tb, a_bytes, b_bytes = tokenizers
    docs, counts = [], Counter()
    for i, text in rows:
        want = (" " + (text or "")).encode()
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        if b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
            a = b = []
        spans = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(table[x])))
                at += len(table[x])
            spans.append(out)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        links, j0 = [], 0
        parts = [[[] for _ in both], [[] for _ in both]]
        for side, ids in ((0, a), (1, b)):
            for x, g in zip(ids, group_of(spans[side], both), strict=True):
                parts[side][g].append(str(x))
        groups = [",".join(p) + "|" + ",".join(q) for p, q in zip(*parts, strict=True)]
        for x, (s, e) in zip(a, spans[0], strict=True):
            while j0 < len(b) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links.append((x, b[j]))
                j += 1
        counts.update(set(links))
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, na, nb, ng, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), h) for i, na, nb, ng, links, h in docs]


def by_row(rows):
    return sorted(rows, key=repr)


def group_of(spans, both):
    out, k = [], 0
    for _, end in spans:
        while both[k] < end:
            k += 1
        out.append(k)
    return out


@pytest.mark.parametrize(("which", "head"), [("corpus", A.HEAD), ("corpus", 50), ("odd", A.HEAD), ("odd", 0)])
def test_alignment_is_brute_force(request, tokenizers, which, head):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = A.alignment(docs, A_PATH, B_PATH, head=head).select(*COLUMNS).collect()
    assert by_row(map(tuple, got)) == by_row(plain(rows, tokenizers))


def test_strange_texts(spark, make, tokenizers, monkeypatch):
    rng = random.Random(5)
    letters = list("abAB01 \n\t'sé中　 😀²½▁<|>") + ["<|endoftext|>", "</s>", "<0x41>", "  ", "\r\n", "é", "ﬁ"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(500, " " * 5_000), (501, "x" * 20_000), (502, "\n" * 3_000 + "a"), (503, "▁"), (504, " "), (505, "a b " * 3_000)]
    monkeypatch.setattr(A, "SLICE", 500)
    got = A.alignment(make(rows, 2), A_PATH, B_PATH).select(*COLUMNS).collect()
    want = plain(rows, tokenizers)
    assert by_row(map(tuple, got)) == by_row(want)
    assert any(w[1] == 0 and t for w, (_, t) in zip(want, rows, strict=True)) and any(w[1] for w in want)


def test_windows_forget_without_change(tokenizers, corpus, monkeypatch):
    texts = [r["text"] or "" for r in corpus.select("text").collect()][:40]
    work = A.Aligner(A_PATH, B_PATH)
    once = [work.texts([t])[4] for t in texts]
    monkeypatch.setattr(A, "MOST_WINDOWS", 10)
    assert [work.texts([t])[4] for t in texts] == once and len(work.text) < 20_000


def test_windows_by_hand():
    length = np.array([0, 2, 3, 4, 1, 0, 0, 2, 7])
    texts, n_groups, n_links, pairs = A.align_windows(np.array([1, 2, 3, 4]), np.array([3, 1]), np.array([7, 8, 4]), np.array([2, 1]), length, length)
    assert texts == ["1|7;2,3|8", "4|4"] and n_groups.tolist() == [2, 1] and n_links.tolist() == [3, 1]
    assert [(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()] == [(1, 7), (2, 8), (3, 8), (4, 4)]


def test_empty_table(empty):
    out = A.alignment(empty, A_PATH, B_PATH)
    assert out.columns == [*COLUMNS[:5], "groups_sha256", "a", "b", "times", "count_sum", "n_best"] and out.collect() == []


def test_odd_rows_keep_their_number(odd):
    assert A.alignment(odd, A_PATH, B_PATH).count() == len(ODD)
