"""Byte-level BPE ids of whole texts, by way of a table of the words already seen."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Distinct words that one worker keeps; the table starts anew beyond that.
CACHE_WORDS = 400_000


class Encoder:
    """ids of ``path`` (ranks of the byte-level BPE vocabulary); ``specials`` are the tokens that stand for one id wherever they occur.

    The pattern that cuts a text into words always cuts before a space that a
    non-space follows, so the stretches between such spaces are encoded one by one.
    """

    def __init__(self, path: str, pattern: str, specials: dict[str, int]):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.seen: dict[str, bytes] = {}
        self.specials = {k: np.array([v], "<u4").tobytes() for k, v in specials.items()}
        longest = sorted(map(re.escape, specials), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(longest)})") if specials else None

    def _packed(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian 32-bit words."""
        if self.special and self.special.search(text):
            return b"".join(self.specials[x] if x in self.specials else self._plain(x) for x in self.special.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        found = list(map(self.seen.get, rest))
        if None in found:
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            for i, x in enumerate(found):
                if x is None:
                    word = rest[i]
                    if not word or word[0].isspace():
                        return self._packed(text)  # the space before it belongs to a longer run
                    x = self._packed(" " + word)
                    if len(word) < 64:
                        self.seen[word] = x
                    found[i] = x
        return self._packed(first) + b"".join(found)
