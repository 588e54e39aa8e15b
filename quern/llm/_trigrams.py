"""Boolean trigram queries of regular expressions.

A query is an AND of ORs of ANDs of trigrams without which no text can match: ``[[{abc, bcd}, {xyz}], ...]``. It is
read off the parsed expression: runs of parts that stand for few strings are spelled out, and the strings' trigrams are
mandatory; parts with many spellings end a run and ask for nothing. An empty query excludes no text.

Trigrams are of lower-cased text (A-Z), whatever the expression's case: a text that matches has them then as well.

Understood are literals, escapes, classes, groups with and without case, alternation and quantifiers; anything else
raises, so that no expression is misread.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

#: Strings of a run, and characters of a class, that are spelled out at most.
SPELLINGS, CHARACTERS = 128, 16

#: A part stands for a set of strings, or None where there are too many, with what it asks for by itself.
Query = list[list[frozenset[str]]]


@dataclass(frozen=True)
class _Part:
    strings: frozenset[str] | None
    query: tuple = ()


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _asked(strings: frozenset[str]) -> tuple:
    """What a run asks for: nothing if one of its strings is shorter than a trigram."""
    found = {_grams(s) for s in strings}
    if frozenset() in found:
        return ()
    # A string that asks for more than another one is covered by it.
    return (tuple(sorted((g for g in found if not any(h < g for h in found)), key=sorted)),)


def _joined(parts: list[_Part]) -> _Part:
    """Parts in a row."""
    run: frozenset[str] = frozenset({""})
    query: tuple = ()
    whole = True
    for part in parts:
        longer = None if part.strings is None else frozenset(a + b for a, b in product(run, part.strings)) if len(run) * len(part.strings) <= SPELLINGS else None
        if longer is not None:
            run = longer
            continue
        whole = False
        query += _asked(run) + part.query
        run = frozenset({""}) if part.strings is None else part.strings
    return _Part(run, query) if whole else _Part(None, query + _asked(run))


def _either(parts: list[_Part]) -> _Part:
    """One of several parts."""
    if all(p.strings is not None for p in parts):
        strings = frozenset().union(*(p.strings for p in parts))
        if len(strings) <= SPELLINGS:
            return _Part(strings)
    # Of each branch one demand is kept, so that an OR of them is one again.
    asked = [next(iter(sorted(p.query if p.strings is None else _asked(p.strings), key=len)), None) for p in parts]
    if None in asked:
        return _Part(None)
    return _Part(None, (tuple(sorted({g for branch in asked for g in branch}, key=sorted)),))


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, what: str) -> bool:
        found = self.text.startswith(what, self.at) and self.at < len(self.text)
        self.at += len(what) * found
        return found

    def wrong(self) -> ValueError:
        return ValueError(f"not understood at {self.at}: {self.text}")

    def either(self) -> _Part:
        parts = [self.row()]
        while self.take("|"):
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else _either(parts)

    def row(self) -> _Part:
        parts: list[_Part] = []
        while self.at < len(self.text) and self.peek() not in "|)":
            parts += self.quantified(self.atom())
        return _joined(parts)

    def atom(self) -> _Part:
        if self.take("("):
            if self.take("?i:") or self.take("?:"):
                pass
            elif self.peek() == "?":
                raise self.wrong()
            inner = self.either()
            if not self.take(")"):
                raise self.wrong()
            return inner
        if self.take("["):
            return self.one_of()
        if self.take("."):
            return _Part(None)
        if self.peek() in "^$*+?{" or not self.peek():
            raise self.wrong()
        found = self.character()
        return _Part(frozenset({found.lower() if found.isascii() else found}))

    def character(self) -> str:
        if not self.take("\\"):
            self.at += 1
            return self.text[self.at - 1]
        if self.take("x"):
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        found = self.peek()
        if not found or found.isalnum():
            raise self.wrong()
        self.at += 1
        return found

    def one_of(self) -> _Part:
        if self.peek() == "^":
            raise self.wrong()
        found: set[str] = set()
        while not self.take("]"):
            if self.at >= len(self.text) or self.peek() == "[":
                raise self.wrong()
            first = self.character()
            if self.peek() == "-" and self.peek(2) != "-]":
                self.at += 1
                found |= {chr(c) for c in range(ord(first), ord(self.character()) + 1)}
            else:
                found.add(first)
        lower = frozenset(c.lower() if c.isascii() else c for c in found)
        return _Part(lower if len(lower) <= CHARACTERS else None)

    def quantified(self, part: _Part) -> list[_Part]:
        """The part as often as its quantifier asks, and what may come more often."""
        low, high = 1, 1
        if self.take("?"):
            low, high = 0, 1
        elif self.take("*"):
            low, high = 0, None
        elif self.take("+"):
            low, high = 1, None
        elif self.take("{"):
            end = self.text.index("}", self.at)
            first, _, last = self.text[self.at : end].partition(",")
            low, high = int(first), (int(last) if last else None if "," in self.text[self.at : end] else int(first))
            self.at = end + 1
        if self.peek() in ("?", "+") and self.peek():
            raise self.wrong()
        if (low, high) == (0, 1) and part.strings is not None:
            return [_Part(part.strings | {""})]
        # Trigrams beyond a few repetitions are the same again.
        out = [part] * min(low, 4)
        return out if high == low <= 4 else [*out, _Part(None)]


def trigram_query(regex: str) -> Query:
    """The query of an expression; empty if it asks for nothing."""
    reader = _Reader(regex)
    part = reader.either()
    if reader.at < len(regex):
        raise reader.wrong()
    asked = part.query if part.strings is None else _asked(part.strings)
    return [list(one) for one in dict.fromkeys(asked)]
