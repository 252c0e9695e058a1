"""Web-style search queries: words are joined by AND, ``OR`` between groups, ``-`` excludes, quotes make phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass

from conceptlake.errors import InvalidParameter
from conceptlake.functions.stem import lexeme

WORD = re.compile(r"[^\W_]+")
#: Spark (Java) and DuckDB read this class alike: a token is a run of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Clause:
    """One AND group: every phrase of ``must`` (single words are phrases of one) and none of ``never``; with no ``must`` it
    holds wherever none of ``never`` stands."""

    must: tuple[tuple[str, ...], ...]
    never: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...]

    @property
    def lexemes(self) -> list[str]:
        return sorted({w for c in self.clauses for p in (*c.must, *c.never) for w in p})

    @property
    def wanted(self) -> list[str]:
        return sorted({w for c in self.clauses for p in c.must for w in p})


def words(text: str) -> tuple[str, ...]:
    return tuple(WORD.findall(text.lower()))


def lexemes(text: str, config: str = "simple") -> tuple[str, ...]:
    """The words' lexemes; stop words are left out."""
    return tuple(x for w in words(text) if (x := lexeme(w, config)) is not None)


def parse(text: str | None, config: str = "simple") -> Query:
    """Never fails on punctuation; a blank query is an error, one of stop words or signs alone has no clause."""
    if text is None or not text.strip():
        raise InvalidParameter("query must not be blank")
    clauses, must, never = [], [], []
    for minus, quoted, bare in re.findall(r'(-?)"([^"]*)"|(\S+)', text):
        if bare == "OR":
            clauses.append((must, never))
            must, never = [], []
            continue
        excluded = bool(minus)
        if bare:
            excluded, quoted = bare.startswith("-"), bare.lstrip("-")
        phrase = lexemes(quoted, config)
        if phrase:
            (never if excluded else must).append(phrase)
    clauses.append((must, never))
    return Query(tuple(Clause(tuple(dict.fromkeys(m)), tuple(dict.fromkeys(n))) for m, n in clauses if m or n))
