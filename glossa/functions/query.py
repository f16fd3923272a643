"""The search box's little language as a tree, and the tree as one filter on a row's words.

    words            all of them                    "a phrase"     words in a row
    -word            not it                         a NEAR/3 b     at most 3 words between, in any order (NEAR alone: 2)
    H430, G746a      a number of the lexicon        lemma:logos    a lemma

``parse`` reads the typed parts once and binds NEAR tighter than the rest; ``condition`` turns the tree into a Column over an
array of folded words and, where asked for, arrays of numbers and lemmas, so a whole query is one pass with no join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a query, and the gap of NEAR alone.
MOST_CHARS, MOST_GAP, MOST_PAGE, NEAR_GAP = 4096, 1000, 1_000_000, 2


class Term(NamedTuple):
    """A leaf: kind is word, phrase, number or lemma."""

    kind: str
    text: str


class Near(NamedTuple):
    a: Term
    b: Term
    gap: int


class Without(NamedTuple):
    term: Term


class Every(NamedTuple):
    parts: tuple[Term | Near | Without, ...]


_SCANNER = re.Scanner(
    [
        (r"\s+", None),
        (r'"[^"]+"', lambda _, s: ("term", Term("phrase", " ".join(s[1:-1].lower().split())))),
        (r"(?i:NEAR)(?:/\d+)?(?=\s|\Z)", lambda _, s: ("near", (s, int(s.partition("/")[2] or NEAR_GAP)))),
        (r"-\S+", lambda _, s: ("not", Term("word", s[1:].lower()))),
        (r"[HGhg]\d+[A-Za-z]?(?=\s|\Z)", lambda _, s: ("term", Term("number", number(s)))),
        (r"(?i:lemma:)\S+", lambda _, s: ("term", Term("lemma", s[6:].lower()))),
        (r"\S+", lambda _, s: ("term", Term("word", s.lower()))),
    ]
)


def number(raw: str) -> str:
    """A lexicon number without leading zeros, its homograph letter in lower case."""
    digits = re.search(r"\d+", raw)[0]
    return f"{raw[0].upper()}{int(digits)}{raw[1 + len(digits) :].lower()}"


def _bound(parts: list[tuple]) -> Iterator[Term | Near | Without]:
    """Parts in order, NEAR taken with the terms on either side; at an end it is a word itself."""
    waiting: list = []
    feed = iter(parts)
    for kind, value in feed:
        if kind == "near":
            text, gap = value
            right = next(feed, None)
            if waiting and right and right[0] == "term" and isinstance(waiting[-1], Term):
                if gap > MOST_GAP:
                    raise ValueError(f"NEAR takes 0 to {MOST_GAP}")
                waiting[-1] = Near(waiting[-1], right[1], gap)
                continue
            waiting.append(Term("word", text.lower()))
            kind, value = right or (None, None)
        if kind:
            waiting.append(Without(value) if kind == "not" else value if kind == "term" else Term("word", value[0].lower()))
    yield from waiting


def parse(text: str) -> Every:
    if not isinstance(text, str) or len(text) > MOST_CHARS:
        raise ValueError(f"a query is text of at most {MOST_CHARS} characters")
    return Every(tuple(_bound(_SCANNER.scan(text)[0])))


def _places(words: Column, term: Term) -> Column:
    """Where a word or a phrase begins."""
    parts = term.text.split()
    hit = F.transform(words, lambda w, i: F.when(reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)]), i))
    return F.filter(hit, lambda i: i.isNotNull())


def condition(query: Every, words: Column, numbers: Column | None = None, lemmas: Column | None = None) -> Column:
    """Whether a row meets ``query``; an empty query is met by every row. The words are worked out once for all parts."""
    return F.transform(F.array(words), lambda held: _met(query, held, numbers, lemmas))[0]


def _met(query: Every | Term | Near | Without, words: Column, numbers: Column | None, lemmas: Column | None) -> Column:
    match query:
        case Every(parts):
            return reduce(lambda a, b: a & b, [_met(p, words, numbers, lemmas) for p in parts], F.lit(True))
        case Without(term):
            return ~_met(term, words, numbers, lemmas)
        case Near(a, b, gap):
            both = F.array_contains(words, a.text.split()[0]) & F.array_contains(words, b.text.split()[0])
            long_a, long_b = len(a.text.split()), len(b.text.split())
            between = lambda i, j: F.when(i <= j, j - i - long_a).otherwise(i - j - long_b)
            met = F.exists(_places(words, a), lambda i: F.exists(_places(words, b), lambda j: (i != j) & between(i, j).between(0, gap)))
            return both & met
        case Term("phrase", text):
            return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {text} "))
        case Term("word", text):
            return F.array_contains(words, text)
        case Term("number", text):
            if numbers is None:
                raise ValueError("these rows have no lexicon numbers")
            return F.array_contains(numbers, text)
        case Term(_, text):
            if lemmas is None:
                raise ValueError("these rows have no lemmas")
            return F.array_contains(lemmas, text)


def page_number(value: object) -> int:
    """A page from 1 to MOST_PAGE; anything else is page 1."""
    try:
        return min(max(int(str(value)), 1), MOST_PAGE)
    except ValueError:
        return 1
