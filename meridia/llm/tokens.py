"""Ids of a public word tokenizer for whole columns of texts.

The tokenizer's words never cross white space and each is encoded by itself, so
a column is lower-cased, cut into words and reduced to its distinct words in
Arrow; only words that the cache lacks go to the tokenizer, and the
ids of all texts are then gathered in numpy. Texts with characters outside the
ones below, for which case and word classes are plain, go to it whole, and so do
texts that hold an added token (``<|endoftext|>``), which it takes for one id.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER = "a-zß-öø-ÿ"
_MARKS = "“”„‘’–—…•"
_OTHER = rf"[^\x00-\x7fÀ-ÖØ-öø-ÿß{_MARKS}]"
_WORD = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\x09-\x0d\x20{_LETTER}0-9]+)"


def gather(codes: np.ndarray, bounds: np.ndarray, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds of each text in them): text i holds items codes[bounds[i]:bounds[i+1]]."""
    sizes = np.fromiter((len(x) for x in items), np.int64, len(items)) // 4
    flat = np.frombuffer(b"".join(items), "<u4")
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    first = np.cumsum(sizes) - sizes
    ids = flat[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])] if len(codes) else flat[:0]
    return ids, ends[bounds]


def distinct(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, bounds, distinct strings) of a column of string lists."""
    enc = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return enc.indices.to_numpy(zero_copy_only=False), bounds - bounds[0], enc.dictionary.to_pylist()


class Kept:
    """What words were found to be, in two generations of at most ``limit`` entries (or those of one slice): when the young one is full it becomes the old one, and what is met again comes back."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: list[str]) -> list[str]:
        """Which of some different words are not known; the others are young from now on."""
        if len(self.young) + sum(w not in self.young for w in words) > self.limit:
            self.old, self.young = self.young, {}
        out = []
        for w in words:
            if w not in self.young:
                known = self.old.get(w)
                if known is None:
                    out.append(w)
                else:
                    self.young[w] = known
        return out


class WordTokenizer:
    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = "|".join([_OTHER, *(f"(?i:{t})" for t in added)])
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # pieces that end a word
        self.last[[i for p, i in vocab.items() if p.endswith("</w>")]] = True
        self.words = Kept(limit)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in self.words.missing(words) if w]
        self.words.young[""] = b""
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()):
                self.words.young[w] = raw[at:end]
                at = end

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; null is the empty text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.whole)
        plain = texts.filter(pc.invert(odd))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _WORD, r"\1 "))
        codes, bounds, words = distinct(split)
        self._learn(words)
        ids, bounds = gather(codes, bounds, [self.words.young[w] for w in words])
        found = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        out = []
        for is_odd, text in zip(odd.to_pylist(), texts if pc.any(odd).as_py() else [None] * len(texts)):
            if is_odd:
                out.append(np.array(self.tok.encode(text.as_py(), add_special_tokens=False).ids, "<u4"))
            else:
                a, b = next(found)
                out.append(ids[a:b])
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
