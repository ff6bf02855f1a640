"""Byte-level BPE vocabulary and the cutting of texts into units that can be encoded one by one."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

#: The pre-token pattern of byte-level BPE.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: The characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next white space. No pre-token crosses the end of a unit.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def pretokens(unit: str) -> list[str]:
    word = unit[1:] if unit[:1] == " " else unit
    return [unit] if word.isalpha() else PRETOKEN.findall(unit)


def byte_letters() -> dict[str, int]:
    """Vocabulary letter to byte: visible Latin-1 stands for itself, the rest for 256, 257, ... in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteVocabulary:
    """Tokens as bytes, merges by rank, and special strings of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.product = np.array([ids[a + b] for a, b in pairs], np.int64)
        longest_first = sorted(self.special, key=lambda s: (-len(s), s))
        self._special_cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def units(self, text: str) -> list[str]:
        """Consecutive pieces of the text whose encodings, joined, are the text's; specials stand alone."""
        if self._special_cut is None or not any(s in text for s in self.special):
            return UNIT.findall(text)
        out: list[str] = []
        for k, piece in enumerate(self._special_cut.split(text)):
            out += [piece] if k % 2 else UNIT.findall(piece)
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteVocabulary:
    """Loaded once in each Python process."""
    return ByteVocabulary(path)
