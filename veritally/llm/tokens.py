"""Token ids of whole texts with a public tokenizer that splits at white space.

A tokenizer whose pre-tokenizer never joins characters across white space gives a text the ids of
its white-space-separated chunks in a row. Each distinct chunk is therefore encoded once per worker
and kept in a table of sorted chunk hashes; the ids of a batch are gathered from it with array
operations. The table is emptied when it reaches `most` chunks, so memory is bounded; results do not
depend on it.

Chunks that are new go through the tokenizer's own library, or, where the vocabulary is one of words
with an end sign whose ids are in the order of the merges, through a byte-pair library that is several
times as fast: pieces are cut by the tokenizer's own pattern and get a byte for the end sign. That
way is taken for short chunks of letters below U+0250, which normal form and case folding treat alike
everywhere; the ids are the same (tested).
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import regex

from veritally.llm import words as W
from veritally.llm.alignment import byte_values

U = np.uint64
_MARK = "<|endoftext|>"
_END, _NEXT = "\x1f", "\n"  # end of a piece, end of a chunk
#: Chunks that the fast way leaves to the tokenizer: with a letter from U+0250 on, a special token, a sign
#: for an end, a space that is not ASCII, or long ones, whose merging would take the square of their length.
_OTHER = regex.compile(r"[^\x00-\u024f]|<\||[\x1c-\x1f\x85\xa0]|.{257}", regex.S)


class WordMerges:
    """Ids of chunks by a vocabulary of lower-case words with an end sign."""

    def __init__(self, model, pattern: str, ranks: dict[bytes, int]):
        self.model, self.next = model, ranks[_NEXT.encode()]
        self.piece = regex.compile(pattern)

    @classmethod
    def of(cls, path: str) -> WordMerges | None:
        """None if the file is not of the form that this way is right for."""
        with open(path) as f:
            file = json.load(f)
        model, plain = file["model"], file.get("normalizer") or {}
        first = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("content")) for x in plain.get("normalizers", [])]
        if first != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]:
            return None
        cut = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in cut] != ["Split", "ByteLevel"] or (cut[0]["behavior"], cut[0]["invert"]) != ("Removed", True):
            return None
        end, vocab = model.get("end_of_word_suffix"), model["vocab"]
        if cut[1].get("add_prefix_space") or cut[1].get("use_regex") or not end or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab[a + b] for a, b in merges]
        values, special, ranks = byte_values(), {t["id"] for t in file.get("added_tokens", [])}, {}
        for piece, i in vocab.items():
            if i not in special:
                ends = piece.endswith(end)
                ranks[bytes(values[c] for c in (piece[:-len(end)] if ends else piece)) + (_END.encode() if ends else b"")] = i
        made = set(order)
        single = [i for i in ranks.values() if i not in made]
        if order != sorted(order) or len(single) != 512 or max(single) > min(order) or len(ranks) != len(set(vocab.values()) - special):
            return None
        import tiktoken

        return cls(tiktoken.Encoding(os.path.basename(path), pat_str=rf"[^{_END}{_NEXT}]+{_END}|{_NEXT}", mergeable_ranks=ranks, special_tokens={}), cut[0]["pattern"]["Regex"], ranks)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and their number per chunk."""
        text = _NEXT.join(chunks).lower() + _NEXT
        ids = np.array(self.model.encode_ordinary(self.piece.sub(rf"\g<0>{_END}", text)), np.uint32)
        edge = np.flatnonzero(ids == self.next)
        return ids[ids != self.next], np.diff(edge, prepend=-1) - 1

    @staticmethod
    def knows(chunk: str) -> bool:
        if chunk.isascii() and chunk.isprintable():
            return len(chunk) <= 256 and "<|" not in chunk
        return _OTHER.search(chunk) is None


class ChunkTokenizer:
    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.most, self.fast = Tokenizer.from_file(path), most, WordMerges.of(path)
        self.mark = self.model.token_to_id(_MARK)
        self._empty()

    def _empty(self):
        self.keys, self.slot = np.zeros(0, U), np.zeros(0, np.int64)
        self.at, self.length, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk; many plain chunks go through the tokenizer as one text with marks between."""
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if "<|" not in c]
        for lo in range(0, len(plain), 4096):
            part = plain[lo:lo + 4096]
            ids = np.array(self.model.encode(_MARK.join(chunks[i] for i in part), add_special_tokens=False).ids, np.uint32)
            for i, x in zip(part, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True):
                out[i] = x[1:] if len(x) and x[0] == self.mark else x
        for i, c in enumerate(chunks):
            if out[i] is None:
                out[i] = np.array(self.model.encode(c, add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks without white space in a row, and their number per chunk."""
        slow = np.array([self.fast is None or not self.fast.knows(c) for c in chunks], bool)
        length = np.zeros(len(chunks), np.int64)
        parts = {True: np.zeros(0, np.uint32), False: np.zeros(0, np.uint32)}
        if not slow.all():
            parts[False], length[~slow] = self.fast.encode([c for c, other in zip(chunks, slow.tolist(), strict=True) if not other])
        if slow.any():
            ids = self._encode([c for c, other in zip(chunks, slow.tolist(), strict=True) if other])
            parts[True], length[slow] = np.concatenate(ids), [len(x) for x in ids]
        out, of = np.empty(int(length.sum()), np.uint32), np.repeat(slow, length)
        out[of], out[~of] = parts[True], parts[False]
        return out, length

    def _learn(self, keys: np.ndarray, chunks: list[str]):
        new, length = self.encode(chunks)
        if self.used + len(new) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(new)), np.uint32)
            grown[:self.used] = self.pool[:self.used]
            self.pool = grown
        self.pool[self.used:self.used + len(new)] = new
        at = self.used + np.cumsum(length) - length
        self.used += len(new)
        keys, slot = np.concatenate([self.keys, keys]), np.arange(len(self.at) + len(keys))
        slot[:len(self.slot)] = self.slot
        self.at, self.length = np.concatenate([self.at, at]), np.concatenate([self.length, length])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in a row, and the number of ids of each text."""
        data, places = W.buffers(column)
        parts, counts, lo, count = [], [], 0, len(places) - 1
        while lo < count:
            hi = max(lo + 1, int(np.searchsorted(places, places[lo] + (1 << 21), "right")) - 1)
            w = W._part(data, places[lo:hi + 1], W.PLAIN, True)
            base = np.repeat(places[lo:hi], w.n)
            keys, first, each = np.unique(w.h, return_index=True, return_inverse=True)
            if len(self.keys) + len(keys) > self.most:
                self._empty()
            new = np.flatnonzero(~W.member(keys, self.keys))
            if len(new):
                f = first[new]
                self._learn(keys[new], [data[a:b].tobytes().decode() for a, b in zip(base[f] + w.start[f], base[f] + w.end[f], strict=True)])
            slot = self.slot[np.searchsorted(self.keys, keys)][each]
            length = self.length[slot]
            stop = np.cumsum(length)
            if len(stop):
                parts.append(self.pool[np.repeat(self.at[slot] - (stop - length), length) + np.arange(stop[-1])])
            stop = np.r_[0, stop]
            edge = np.r_[0, np.cumsum(w.n)]
            counts.append(np.diff(stop[edge]))
            lo = hi
        none = np.zeros(0, np.uint32)
        return np.concatenate([none, *parts]), np.concatenate([np.zeros(0, np.int64), *counts])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process."""
    return ChunkTokenizer(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
