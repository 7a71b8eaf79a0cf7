"""Whole texts to ids of a byte-level BPE vocabulary file, by the tokenizers library, each distinct stretch once per worker.

The vocabulary's pre-tokeniser cuts a text by the pattern  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\s L N]+|\\s+(?!\\S)|\\s+
and merges never cross a cut. So these places are cuts whatever stands around them, and a text may be encoded in parts there:
  * between a visible character and white space: no alternative has white space after a visible character;
  * in white space before a visible character, in front of the last one: `\\s+(?!\\S)` takes all but that one;
  * after that one, unless it is a plain space, which the next alternative takes along;
  * between a letter, ASCII or Latin up to U+024F, and an ASCII sign that is no letter, digit or apostrophe: a run of letters
    ends there, and only an apostrophe starts a contraction.
White space at the end of a text is one part. The library encodes each part; parts of letters alone, which are one
piece each, go to it as pre-tokenised input, their bytes written in the vocabulary's letters. A worker keeps the ids of parts that it has met.
Texts that hold a special token's name or one of U+001C to U+001F, which count as white space here but not there, and
vocabularies with another pre-tokeniser are encoded as they are.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

#: Parts in each of the two generations that a worker keeps; what is used again moves to the younger.
KEEP = 450_000
_PARTS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[!-&(-/:-@\[-`{-~\s]|\Z)| ?\S+|\s+\Z|\s+(?=\s)|\s")
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_ODD = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Store:
    """What has been worked out, in two generations."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, wanted: set[str], work) -> None:
        """Have all wanted in the younger generation; work(parts) gives those that neither has."""
        if len(self.young) > KEEP:
            self.old, self.young = self.young, {}
        lacking = wanted.difference(self.young)
        old, new = self.old, []
        for p in lacking:  # one look-up each: an intersection would walk through all that is old
            if p in old:
                self.young[p] = old[p]
            else:
                new.append(p)
        if new:
            self.young.update(work(new))


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = None
        # visible Latin-1 characters stand for their bytes; the other bytes have the characters from U+0100 up
        self.letters = {}
        for b in range(256):
            if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174):
                self.letters[b] = 256 + len(self.letters)
        self.ids, self.offsets = Store(), Store()

    def _whole(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _parts(self, text: str) -> list[str] | None:
        """The parts of a text that may be encoded alone; None if it can't be cut."""
        if not self.cuts or _ODD.search(text) or any(a in text for a in self.added):
            return None
        return _PARTS.findall(text)

    def _ids(self, parts: list[str]) -> dict[str, bytes]:
        words, rest = [], []
        for p in parts:
            (words if _WORD.fullmatch(p) else rest).append(p)
        out = dict(zip(rest, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        if words:
            written = "\n".join(words).encode().decode("latin-1").translate(self.letters).split(chr(self.letters[10]))
            e = self.words.encode(written, is_pretokenized=True, add_special_tokens=False)
            word, raw = np.array(e.word_ids, np.int64), np.array(e.ids, "<u4").tobytes()
            ends = (np.append(np.flatnonzero(np.diff(word)) + 1, len(word)) * 4).tolist()
            out.update(zip(words, (raw[i:j] for i, j in zip([0, *ends], ends)), strict=True))
        return out

    def _spans(self, parts: list[str]) -> dict[str, bytes]:
        return {p: np.array(e.offsets, np.int32).tobytes() for p, e in zip(parts, self.tokenizer.encode_batch(parts, add_special_tokens=False))}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = list(map(self._parts, texts))
        self.ids.learn(set().union(*[p for p in cut if p is not None]), self._ids)
        known = self.ids.young.__getitem__
        return [array("I", self._whole(t).ids).tobytes() if p is None else b"".join(map(known, p)) for t, p in zip(texts, cut)]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """Character offsets (start, end) of each text's tokens, as the library gives them."""
        cut = list(map(self._parts, texts))
        self.offsets.learn(set().union(*[p for p in cut if p is not None]), self._spans)
        known, out = self.offsets.young.__getitem__, []
        for text, parts in zip(texts, cut):
            if parts is None:
                out.append(np.array(self._whole(text).offsets, np.int64).reshape(-1, 2))
                continue
            found = list(map(known, parts))
            at = np.cumsum([0, *map(len, parts)])[:-1]
            out.append(np.frombuffer(b"".join(found), np.int32).reshape(-1, 2) + np.repeat(at, [len(f) // 8 for f in found])[:, None])
        return out


def encoder(path: str) -> Encoder:
    """One per worker process."""
    store = sys.__dict__.setdefault("_tessellar_encoders", {})
    if path not in store:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store[path] = Encoder(path)
    return store[path]
