"""Boolean trigram queries: what trigrams a text must have for a regular expression to match in it.

A query is a list of alternatives, each a set of lower-case trigrams that must all occur; None
says that the expression demands no trigram. Lower-casing only widens what passes.
"""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as op
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as op
    import sre_parse as parser

#: Bounds on what is enumerated; beyond them a part demands nothing, which is safe.
MOST_STRINGS, MOST_CLASS, MOST_ALTERNATIVES = 64, 4, 64


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 26:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _simplest(alternatives: list[frozenset[str]]) -> list[frozenset[str]] | None:
    """Without alternatives that demand more than another; None if one demands nothing or there are too many."""
    least = [a for a in set(alternatives) if not any(b < a for b in alternatives)]
    return None if any(not a for a in least) or len(least) > MOST_ALTERNATIVES else least


def _both(x, y):
    if x is None or y is None:
        return x if y is None else y
    return _simplest([a | b for a, b in product(x, y)]) or min(x, y, key=len)


def _of_strings(strings: set[str]):
    return _simplest([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _parse(nodes) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """The strings that a sequence is, where they can be listed; what it demands."""
    now: set[str] = {""}
    exact, need = True, None

    def flush():
        nonlocal now, need
        need, now = _both(need, _of_strings(now)), {""}

    for kind, value in nodes:
        strings, demand = None, None
        if kind is op.LITERAL:
            strings = {chr(value).lower()}
        elif kind is op.IN:
            strings = _class(value)
        elif kind is op.SUBPATTERN:
            strings, demand = _parse(value[-1])
        elif kind is op.BRANCH:
            parts = [_parse(x) for x in value[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                each = [d if s is None else _of_strings(s) for s, d in parts]
                demand = None if any(d is None for d in each) else _simplest([a for d in each for a in d])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            strings, demand = _parse(inner)
            if strings is not None and high == 1:
                strings = strings | {""} if low == 0 else strings
            elif strings is not None and low == high and low <= 8 and len(strings) == 1:
                strings = {next(iter(strings)) * low}
            else:
                demand = (demand if strings is None else _of_strings(strings)) if low else None
                strings = None
        elif kind is op.AT:
            continue
        if strings is not None and len(strings) * len(now) <= MOST_STRINGS:
            now = {a + b for a, b in product(now, strings)}
            continue
        exact = False
        flush()
        if strings is not None and len(strings) <= MOST_STRINGS:
            now = strings
        else:
            need = _both(need, demand)
    if exact:
        return now, None
    flush()
    return None, need


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    strings, need = _parse(parser.parse(pattern, re.ASCII))
    return need if strings is None else _of_strings(strings)
