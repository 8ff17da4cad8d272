"""A trie laid over a sorted list of words: a node is a slice of the list and a depth, so nothing but the words is stored."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator


class Trie:
    """Prefix tree over distinct words."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = sorted(set(words))

    def root(self) -> tuple[int, int, int]:
        return 0, len(self.words), 0

    def is_word(self, node: tuple[int, int, int]) -> bool:
        """True if the node's path is itself a word (the shortest of a slice comes first)."""
        low, high, depth = node
        return low < high and len(self.words[low]) == depth

    def children(self, node: tuple[int, int, int]) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """(character, child) for each branch, jumping from branch to branch by bisection."""
        low, high, depth = node
        at = low + self.is_word(node)
        while at < high:
            char = self.words[at][depth]
            end = self._end(at, high, self.words[at][: depth + 1])
            yield char, (at, end, depth + 1)
            at = end

    def descend(self, node: tuple[int, int, int], char: str) -> tuple[int, int, int] | None:
        """The child along ``char``, or None."""
        low, high, depth = node
        if low >= high:
            return None
        path = self.words[low][:depth] + char
        at = bisect_left(self.words, path, low, high)
        end = self._end(at, high, path)
        return (at, end, depth + 1) if at < end else None

    def _end(self, low: int, high: int, path: str) -> int:
        """First place from ``low`` on whose word doesn't start with ``path``."""
        return bisect_left(self.words, True, low, high, key=lambda w: w[: len(path)] > path)

    def find(self, path: str) -> tuple[int, int, int] | None:
        node: tuple[int, int, int] | None = self.root()
        for char in path:
            node = self.descend(node, char)
            if node is None:
                return None
        return node

    def __contains__(self, word: str) -> bool:
        node = self.find(word)
        return node is not None and self.is_word(node)

    def is_proper_prefix(self, path: str) -> bool:
        """True if ``path`` is no word but begins one."""
        node = self.find(path)
        return node is not None and not self.is_word(node)
