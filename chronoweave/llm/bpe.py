"""Byte-level BPE ids and the characters that tokens cover."""

from __future__ import annotations

import json
import re

import numpy as np


def tokenizer_path() -> str:
    """The default vocabulary; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: White space as the vocabulary's pattern means it. Longer runs would overflow the stack of tiktoken's regular expressions.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


class Encoder:
    """encode(text): the ids that the tokenizer file gives with add_special_tokens=False; a special token's string in a text
    is that token, as there. The vocabulary is run by tiktoken, which needs a third of the time of the library of the file;
    the tests hold both against each other. dtype: the little-endian unsigned type that holds every id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        of, self.special = _byte_of_char(), {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        self._coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.sizes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.sizes[i] = len(t)
        self.dtype = "<u2" if len(self.sizes) <= 1 << 16 else "<u4"

    def encode(self, text: str) -> list[int]:
        if self._marks and any(t in text for t in self.special):
            out = []
            for k, part in enumerate(self._marks.split(text)):
                out += [self.special[part]] if k % 2 else self._ordinary(part)
            return out
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG_RUN.finditer(text) if len(text) >= 10_000 else ():
            # the run is one word for the merges, but for its last character where more text follows
            cut = m.end() if m.end() == len(text) else m.end() - 1
            out += self._coder.encode_ordinary(text[at : m.start()])
            out += self._coder._encode_single_piece(text[m.start() : cut])
            at = cut
        return out + self._coder.encode_ordinary(text[at:])

    def packed(self, text: str) -> bytes:
        """The ids as integers of dtype."""
        return np.array(self.encode(text), self.dtype).tobytes()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end character (code points, end exclusive) of each token: the characters any of whose bytes it holds."""
        sizes = self.sizes[self.encode(text)] if text else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(raw) == len(text):
            return starts, ends
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1
