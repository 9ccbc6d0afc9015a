"""Minimal acyclic automata with perfect-hash word numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def common_prefix(a: str, b: str) -> int:
    """Number of characters that two strings share from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while low < n and a[low] == b[low]:
        low += 1
    return low


class Automaton:
    """The smallest deterministic automaton of a sorted list of distinct words.

    A word's number is its place in that list.  Each transition carries how
    many words come before those behind it, so a walk sums up the number.
    """

    def __init__(self, words: Iterable[str]):
        #: of each state: labels, targets, words before each target; and words from here
        self.edges: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple[bool, str, tuple[int, ...]], int] = {}
        path: list[tuple[list[bool], list[str], list[int]]] = [([False], [], [])]

        def settled(final: bool, labels: str, targets: tuple[int, ...]) -> int:
            state = known.get((final, labels, targets))
            if state is None:
                state = known[final, labels, targets] = len(self.edges)
                before, n = [], int(final)
                for t in targets:
                    before.append(n)
                    n += self.size[t]
                self.edges.append((labels, targets, tuple(before)))
                self.final.append(final)
                self.size.append(n)
            return state

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                final, labels, targets = path.pop()
                path[-1][2].append(settled(final[0], "".join(labels), tuple(targets)))

        last = ""
        for word in words:
            shared = common_prefix(last, word)
            settle(shared)
            for c in word[shared:]:
                path[-1][1].append(c)
                path.append(([False], [], []))
            path[-1][0][0] = True
            last = word
        settle(0)
        final, labels, targets = path.pop()
        self.root = settled(final[0], "".join(labels), tuple(targets))

    def follow(self, state: int, number: int, rest: str) -> tuple[int, int] | None:
        """State and word number after reading rest exactly, or None."""
        edges = self.edges
        for c in rest:
            labels, targets, before = edges[state]
            i = labels.find(c)
            if i < 0:
                return None
            number += before[i]
            state = targets[i]
        return state, number

    def accepted(self, state: int, number: int, rest: str) -> int | None:
        """Number of the word that ends after reading rest exactly, or None."""
        end = self.follow(state, number, rest)
        return end[1] if end is not None and self.final[end[0]] else None

    def replaced_or_inserted(self, state: int, number: int, rest: str) -> Iterator[int]:
        """Numbers of words that read rest with one character replaced, or one more; one may come more than once."""
        for i in range(len(rest) + 1):
            labels, targets, before = self.edges[state]
            here = rest[i : i + 1]
            for c, target, n in zip(labels, targets, before, strict=True):
                found = self.accepted(target, number + n, rest[i:])
                if found is not None:
                    yield found
                if here and c != here:
                    found = self.accepted(target, number + n, rest[i + 1 :])
                    if found is not None:
                        yield found
            k = labels.find(here) if here else -1
            if k < 0:
                return
            state, number = targets[k], number + before[k]

    def deleted(self, state: int, number: int, rest: str) -> Iterator[int]:
        """Numbers of words that read rest without one character; one may come more than once."""
        for i in range(len(rest)):
            found = self.accepted(state, number, rest[i + 1 :])
            if found is not None:
                yield found
            step = self.follow(state, number, rest[i])
            if step is None:
                return
            state, number = step
