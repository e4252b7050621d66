"""Which of a vault's values a text may hold, found in one pass over the text however many values there are.

Spellings of names and addresses are words of Aho-Corasick automata over folded
text, and the digits of phone numbers of others over the text's digits. Values
come one by one, so there are automata of 1, 2, 4, ... values' worth: two of a
kind become one, and each value is built in a logarithmic number of times. What
is found is a superset, which the values' own patterns then decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick

_folds: dict[str, str] = {}
_by_upper: dict[str, str] = {}


def _fold_char(c: str) -> str:
    """One character for all that are equal without regard to case."""
    low = c.lower()[0]
    up = low.upper()
    return up.lower()[0] if len(up) == 1 else _by_upper.setdefault(up, low)


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        self[code] = got = _fold_char(chr(code))
        return got


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Of equal length; equal for texts that differ in case only."""
    return text.translate(_FOLDING)


class Words:
    """A growing set of (word, value); finds the values whose word stands in a text."""

    def __init__(self) -> None:
        self._levels: list[tuple[list[tuple[str, int]], object] | None] = []

    def add(self, pairs: list[tuple[str, int]]) -> None:
        level = max(0, len(pairs) - 1).bit_length()
        while True:
            self._levels += [None] * (level + 1 - len(self._levels))
            if self._levels[level] is None:
                break
            pairs = self._levels[level][0] + pairs
            self._levels[level] = None
            level = max(level + 1, (len(pairs) - 1).bit_length())
        by_word: dict[str, list[int]] = {}
        for word, value in pairs:
            by_word.setdefault(word, []).append(value)
        automaton = ahocorasick.Automaton()
        for word, values in by_word.items():
            automaton.add_word(word, tuple(values))
        automaton.make_automaton()
        self._levels[level] = (pairs, automaton)

    def within(self, text: str) -> set[int]:
        return {v for level in self._levels if level for _, values in level[1].iter(text) for v in values}


def digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


class RepeatIndex:
    """The values of a vault's tokens, by ``spell``: their spellings as words, and their digits as numbers."""

    def __init__(self, spell: Callable[[str, str], tuple[list[str], list[str]]]):
        self.spell, self.words, self.numbers = spell, Words(), Words()
        self.known: list[tuple[str, str]] = []
        self.rank: dict[str, int] = {}
        self.at = 0

    def take(self, changes: list[str], values: dict[str, str]) -> None:
        """Take up the tokens that were assigned since the last call."""
        words, numbers = [], []
        for token in changes[self.at :]:
            self.rank.setdefault(token, len(self.rank))
            own_words, own_numbers = self.spell(token, values[token])
            words += [(fold(w), len(self.known)) for w in own_words]
            numbers += [(n, len(self.known)) for n in own_numbers]
            self.known.append((token, values[token]))
        self.at = len(changes)
        for index, pairs in ((self.words, words), (self.numbers, numbers)):
            if pairs:
                index.add(pairs)

    def candidates(self, text: str, values: dict[str, str]) -> Iterator[tuple[str, str]]:
        """(token, value) that may stand in the text, longest value first, then in the order of the tokens."""
        found = self.words.within(fold(text)) | self.numbers.within(digits(text))
        held = {self.known[i] for i in found}
        now = [(t, v) for t, v in held if values.get(t) == v]
        return iter(sorted(now, key=lambda tv: (-len(tv[1]), self.rank[tv[0]])))
