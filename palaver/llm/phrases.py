"""Aho-Corasick over words: every word of the pattern vocabulary becomes one code point, so an automaton step is a word."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick

from .common import ALNUM

#: Code points are handed out from here, over the surrogates too few to matter; U+0000 stands for every other word.
_FIRST, _SURROGATES, _AFTER, _LAST = 1, 0xD800, 0xE000, 0x10FFFF


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(ALNUM).split()


_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code point offsets of the same words in the original text, for the few texts that need them."""
    return [m.span() for m in _WORD.finditer(text)]


class PhraseAutomaton:
    """One automaton for many word sequences; ``payloads`` with the same words are kept together."""

    def __init__(self, phrases: Iterable[tuple[tuple[bytes, ...], object]]):
        grouped: dict[tuple[bytes, ...], list] = {}
        for words, payload in phrases:
            if words:
                grouped.setdefault(tuple(words), []).append(payload)
        self._letters: dict[bytes, str] = {}
        self._automaton = ahocorasick.Automaton()
        for words, payloads in grouped.items():
            self._automaton.add_word("".join(self._letter(w) for w in words), (len(words), payloads))
        self.empty = not grouped
        if grouped:
            self._automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        if word not in self._letters:
            n = _FIRST + len(self._letters)
            if n >= _SURROGATES:
                n += _AFTER - _SURROGATES
            if n > _LAST:
                raise ValueError("too many distinct pattern words for one automaton; use smaller shards")
            self._letters[word] = chr(n)
        return self._letters[word]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """(first word, end word exclusive, payloads) of every occurrence, overlapping ones included."""
        if self.empty or not words:
            return
        get = self._letters.get
        for last, (n, payloads) in self._automaton.iter("".join([get(w, "\0") for w in words])):
            yield last + 1 - n, last + 1, payloads
