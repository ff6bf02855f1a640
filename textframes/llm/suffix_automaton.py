"""Generalised suffix automaton over sequences of small integers."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Recognises every substring of the added sequences. A state stands for the substrings that end
    at the same places; they are suffixes of the longest, whose length is `length`."""

    def __init__(self, bits: int) -> None:
        self.bits = bits  # of a symbol
        self.go: dict[int, int] = {}  # state << bits | symbol -> state
        self.out: list[list[int]] = [[]]  # symbols that leave a state
        self.length, self.link = [0], [-1]

    def add(self, symbols: Iterable[int]) -> list[int]:
        """Adds a sequence; the states of its prefixes (a later addition may split them)."""
        last, path = 0, []
        for x in symbols:
            last = self._extend(last, x)
            path.append(last)
        return path

    def _extend(self, last: int, x: int) -> int:
        go, length, link, bits = self.go, self.length, self.link, self.bits
        q = go.get(last << bits | x)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, x, q)
        new = self._state(length[last] + 1, 0)
        p = last
        while p >= 0 and (p << bits | x) not in go:
            go[p << bits | x] = new
            self.out[p].append(x)
            p = link[p]
        if p >= 0:
            q = go[p << bits | x]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
        return new

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.length) - 1

    def _clone(self, p: int, x: int, q: int) -> int:
        go, bits = self.go, self.bits
        copy = self._state(self.length[p] + 1, self.link[q])
        self.out[copy] = self.out[q].copy()
        for y in self.out[q]:
            go[copy << bits | y] = go[q << bits | y]
        self.link[q] = copy
        while p >= 0 and go.get(p << bits | x) == q:
            go[p << bits | x] = copy
            p = self.link[p]
        return copy

    def by_length(self) -> list[int]:
        """All states but the first, shorter ones before longer ones."""
        return sorted(range(1, len(self.length)), key=self.length.__getitem__)
