"""What every match of a regex contains, derived from the regex."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Need:
    """What a text must contain: ``all`` of the parts and one of each group of alternatives."""

    all: frozenset = frozenset()
    any: tuple[tuple[Need, ...], ...] = ()

    @property
    def free(self) -> bool:
        return not self.all and not self.any

    def parts(self) -> set:
        return set(self.all).union(*(n.parts() for group in self.any for n in group))


def _both(a: Need, b: Need) -> Need:
    return Need(a.all | b.all, a.any + b.any)


#: Strings that a part of a regex can be, kept while there are at most so many; the least length of a useful one.
EXACT, LEAST = 64, 3


def required_literals(pattern: str) -> Need:
    """The lower-case strings that every match of ``pattern``, in any letter case, contains.

    The walk over the parsed regex keeps, as long as they are few, the exact
    strings the last parts can be, so that strings across the border of a group
    are found; what cannot be enumerated ends the run.
    """
    need, exact = _walk(sre_parse.parse(pattern))
    return _both(need, _strings(exact)) if exact is not None else need


def _strings(exact: frozenset[str]) -> Need:
    if not exact or any(len(s.encode()) < LEAST for s in exact):
        return Need()
    needs = tuple(Need(frozenset([s])) for s in sorted(exact))
    return needs[0] if len(needs) == 1 else Need(any=(needs,))


def _walk(parts) -> tuple[Need, frozenset[str] | None]:
    """Need of a sequence, and the strings its end can be (None: anything)."""
    need = Need()
    run: frozenset[str] | None = frozenset([""])
    whole = True  # whether `run` describes the sequence from its start

    def flush() -> None:
        nonlocal need, run, whole
        if run is not None:
            need = _both(need, _strings(run))
        run, whole = frozenset([""]), False

    for op, arg in parts:
        options: frozenset[str] | None = None
        inner = Need()
        if op is sre.LITERAL:
            options = frozenset([chr(arg).lower()])
        elif op is sre.IN:
            options = _set(arg)
        elif op is sre.SUBPATTERN:
            inner, options = _walk(arg[3])
        elif op is sre.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(e is not None and n.free for n, e in found):
                options = frozenset().union(*(e for _, e in found))
            else:
                each = tuple(_both(n, _strings(e)) if e is not None else n for n, e in found)
                inner = Need() if any(n.free for n in each) else Need(any=(each,))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            n, e = _walk(body)
            if low == 0 and high == 1 and e is not None and n.free:
                options = e | {""}
            elif low > 0:
                inner = _both(n, _strings(e)) if e is not None else n
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if options is not None and run is not None and len(options) * len(run) <= EXACT:
            need = _both(need, inner)
            run = frozenset(a + b for a in run for b in options)
        else:
            flush()
            need = _both(need, inner)
            if options is not None and len(options) <= EXACT:
                run = options
    return need, run if whole else (flush() or None)


def _set(items) -> frozenset[str] | None:
    out = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 4:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def contains(text: Column, need: Need) -> Column:
    """Whether a lower-case text has what is needed; a cheap test before the regex itself."""
    tests = [text.contains(s) for s in sorted(need.all)]
    tests += [reduce(lambda a, b: a | b, [contains(text, n) for n in group]) for group in need.any]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
