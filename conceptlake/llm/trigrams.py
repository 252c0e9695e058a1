"""Boolean trigram queries derived from regular expressions.

A query is ``ANY`` (no mandatory trigram: every text is a candidate), a trigram (3 bytes, ASCII letters in lower
case), or ``("and" | "or", (query, ...))``. The derivation walks the parse tree bottom-up; for every node it keeps
the full set of strings the node can match while that set is small, else the sets of possible first and last two
characters, and the query that any match implies. It is sound: a text that the regex matches always satisfies it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

ANY = True
#: A set of strings is kept whole up to this many, and a character class enumerated up to CLASS characters.
EXACT, CLASS = 64, 8


@dataclass(frozen=True)
class Info:
    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    query: object = ANY


EMPTY = Info(frozenset([""]), frozenset([""]), frozenset([""]))
UNKNOWN = Info(None, frozenset([""]), frozenset([""]))


def conj(*queries):
    parts: list = []
    for q in queries:
        if q is ANY:
            continue
        parts.extend(q[1] if isinstance(q, tuple) and q[0] == "and" else [q])
    parts = list(dict.fromkeys(parts))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def disj(*queries):
    if any(q is ANY for q in queries):
        return ANY
    parts: list = []
    for q in queries:
        parts.extend(q[1] if isinstance(q, tuple) and q[0] == "or" else [q])
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_string(s: str):
    """The trigrams of one literal; shorter literals demand nothing."""
    b = s.encode()
    return conj(*[bytes(b[i : i + 3]) for i in range(len(b) - 2)])


def of_set(strings: frozenset):
    return disj(*[of_string(s) for s in sorted(strings)]) if strings else ANY


def inexact(x: Info) -> Info:
    """Forget the full set, keeping what it implies."""
    if x.exact is None:
        return x
    return Info(None, frozenset(s[:2] for s in x.exact), frozenset(s[-2:] for s in x.exact), conj(x.query, of_set(x.exact)))


def concat(x: Info, y: Info) -> Info:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= EXACT:
        both = frozenset(a + b for a, b in product(x.exact, y.exact))
        return Info(both, frozenset(s[:2] for s in both), frozenset(s[-2:] for s in both), conj(x.query, y.query))
    border = ANY
    left, right = (x.exact or x.suffix), (y.exact or y.prefix)
    if len(left) * len(right) <= 4 * EXACT:
        border = of_set(frozenset(a[-2:] + b[:2] for a, b in product(left, right)))
    prefix = frozenset((a + b)[:2] for a, b in product(x.exact, y.prefix)) if x.exact is not None else x.prefix
    suffix = frozenset((a + b)[-2:] for a, b in product(x.suffix, y.exact)) if y.exact is not None else y.suffix
    one, two = inexact(x), inexact(y)
    small = lambda s: s if len(s) <= EXACT else frozenset([""])
    return Info(None, small(prefix), small(suffix), conj(one.query, two.query, border))


def either(infos: list[Info]) -> Info:
    if all(x.exact is not None for x in infos) and sum(len(x.exact) for x in infos) <= EXACT:
        both = frozenset().union(*(x.exact for x in infos))
        return Info(both, frozenset(s[:2] for s in both), frozenset(s[-2:] for s in both), disj(*[x.query for x in infos]))
    infos = [inexact(x) for x in infos]
    small = lambda s: s if len(s) <= EXACT else frozenset([""])
    return Info(None, small(frozenset().union(*(x.prefix for x in infos))), small(frozenset().union(*(x.suffix for x in infos))), disj(*[x.query for x in infos]))


def literal(code: int) -> Info:
    c = chr(code)
    c = c.lower() if "A" <= c <= "Z" else c
    return Info(frozenset([c]), frozenset([c]), frozenset([c]))


def members(items) -> frozenset | None:
    """The characters of a class, or None where it is negated, has a category or is large."""
    out: set[str] = set()
    for op, arg in items:
        kind = str(op)
        if kind == "LITERAL":
            out.add(chr(arg))
        elif kind == "RANGE" and arg[1] - arg[0] < 128:
            out.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    return frozenset(c.lower() if "A" <= c <= "Z" else c for c in out)


def walk(tree) -> Info:
    at = EMPTY
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            node = literal(arg)
        elif kind == "IN":
            chars = members(arg)
            node = Info(chars, chars, chars) if chars is not None and len(chars) <= CLASS else UNKNOWN
        elif kind == "SUBPATTERN":
            node = walk(arg[3])
        elif kind == "ATOMIC_GROUP":
            node = walk(arg)
        elif kind == "BRANCH":
            node = either([walk(x) for x in arg[1]])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            inner = walk(body)
            if low == 0:
                node = either([EMPTY, inner]) if int(high) == 1 else UNKNOWN
            elif low == high == 1:
                node = inner
            else:
                node = concat(inner, inner) if low == high == 2 else concat(inexact(inner), inexact(inner)) if low >= 2 else inexact(inner)
        elif kind in ("AT", "ASSERT", "ASSERT_NOT"):
            node = EMPTY
        else:
            node = UNKNOWN
        at = concat(at, node)
    return at


def query_of(pattern: str):
    """The Boolean trigram query that every text matched by ``pattern`` satisfies, or ANY."""
    return inexact(walk(re._parser.parse(pattern, re.ASCII))).query


def trigrams_of(query) -> set[bytes]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


def show(query) -> str:
    if query is ANY:
        return "ANY"
    return query.decode("utf-8", "replace") if isinstance(query, bytes) else "(" + f" {query[0].upper()} ".join(map(show, query[1])) + ")"
