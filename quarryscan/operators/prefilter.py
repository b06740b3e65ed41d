"""Which rules can match a text at all: required literals of every pattern, looked for in one pass over the text.

`required` reads literals off a pattern's parse tree, such that every match holds at least one of them. `possible` looks for the literals of all rules at
once, with one automaton where pyahocorasick is installed and by built-in `contains` otherwise; both find the same. A rule
without literals is always possible. Literals are compared in lower case, so they are necessary for a match in either case, never sufficient.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .rulebook import Rule

try:
    import ahocorasick
except ModuleNotFoundError:
    ahocorasick = None

_PARSER, _OPS = re._parser, re._constants
#: Texts that a Python task is sent at once.
BATCH_ROWS = 500
#: Texts that a literal is put together from at most, members of a set and turns of a repetition that are written out, the least length of a literal that tells.
MOST, MEMBERS, TURNS, LEAST = 64, 8, 2, 3


def _sum(parts: list[set[str] | None]) -> set[str] | None:
    return None if any(p is None for p in parts) else set().union(*parts)


def _spelled(op, arg) -> set[str] | None:
    """All texts that an item matches, if these are few. What has no width counts as the empty text."""
    if op is _OPS.LITERAL:
        return {chr(arg).lower()}
    if op in (_OPS.AT, _OPS.ASSERT, _OPS.ASSERT_NOT):
        return {""}
    if op is _OPS.IN:
        if len(arg) <= MEMBERS and all(o is _OPS.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        return None
    if op is _OPS.SUBPATTERN:
        return _all_spelled(arg[3])
    if op is _OPS.BRANCH:
        out = _sum([_all_spelled(p) for p in arg[1]])
        return out if out is None or len(out) <= MOST else None
    if op in (_OPS.MAX_REPEAT, _OPS.MIN_REPEAT, _OPS.POSSESSIVE_REPEAT) and arg[1] <= TURNS:
        once = _all_spelled(arg[2])
        if once is None:
            return None
        out, turn = set(), {""}
        for i in range(arg[1] + 1):
            if i >= arg[0]:
                out |= turn
            turn = {a + b for a in turn for b in once}
            if len(out) > MOST or len(turn) > MOST:
                return None
        return out
    return None


def _all_spelled(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        each = _spelled(op, arg)
        if each is None or len(out) * len(each) > MOST:
            return None
        out = {a + b for a in out for b in each}
    return out


def _within(op, arg) -> set[str] | None:
    """Literals that an item needs, for items that cannot be written out."""
    if op is _OPS.SUBPATTERN:
        return _needed(arg[3])
    if op is _OPS.BRANCH:
        return _sum([_needed(p) for p in arg[1]])
    if op in (_OPS.MAX_REPEAT, _OPS.MIN_REPEAT, _OPS.POSSESSIVE_REPEAT) and arg[0] > 0:
        return _needed(arg[2])
    return None


def _needed(items) -> set[str] | None:
    """The best set of literals in a sequence of items: long ones first, then few."""
    found: list[set[str]] = []
    run = {""}
    for op, arg in items:
        each = _spelled(op, arg)
        if each is not None and len(run) * len(each) <= MOST:
            run = {a + b for a in run for b in each}
            continue
        found.append(run)
        run = each if each is not None else {""}
        if each is None and (inner := _within(op, arg)) is not None:
            found.append(inner)
    told = [x for x in (*found, run) if min(map(len, x)) >= LEAST]
    return max(told, key=lambda x: (min(min(map(len, x)), 6), -len(x)), default=None)


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match has one; None if the pattern has none that tell."""
    plain = re.sub(r"\A\(\?([a-z]+)\)", lambda m: f"(?{m[1].replace('d', '')})" if m[1] != "d" else "", pattern)
    try:
        literals = _needed(list(_PARSER.parse(plain)))
    except re.error:  # syntax that only Java's expressions have
        return None
    if literals is None:
        return None
    # A literal that holds another one adds nothing.
    return frozenset(x for x in literals if not any(y != x and y in x for y in literals))


def _first(items) -> tuple[set[str] | None, bool]:
    """Lower-case characters that a match of a sequence may begin with (None: any), and whether it may be empty."""
    out: set[str] = set()
    for op, arg in items:
        if op in (_OPS.AT, _OPS.ASSERT, _OPS.ASSERT_NOT):
            continue
        one, empty = None, False
        if op is _OPS.LITERAL:
            one = {chr(arg).lower()}
        elif op is _OPS.IN and all(o is _OPS.LITERAL or (o is _OPS.RANGE and a[1] - a[0] < 64) for o, a in arg):
            one = {chr(c).lower() for o, a in arg for c in ([a] if o is _OPS.LITERAL else range(a[0], a[1] + 1))}
        elif op is _OPS.SUBPATTERN:
            one, empty = _first(arg[3])
        elif op is _OPS.BRANCH:
            parts = [_first(p) for p in arg[1]]
            one, empty = _sum([p[0] for p in parts]), any(p[1] for p in parts)
        elif op in (_OPS.MAX_REPEAT, _OPS.MIN_REPEAT, _OPS.POSSESSIVE_REPEAT):
            one, empty = _first(arg[2])
            empty = empty or arg[0] == 0
        if one is None:
            return None, True
        out |= one
        if not empty:
            return out, False
    return out, True


def quick(pattern: str) -> str:
    """The same expression for Java; one of several alternatives first looks at a place's character, if it is known with which a match begins."""
    flags, rest = re.match(r"(\A\(\?[a-z]+\))?(.*)\Z", pattern, re.S).groups()
    try:
        items = list(_PARSER.parse(rest))
    except re.error:
        return pattern
    chars, empty = _first(items)
    if not any(op is _OPS.BRANCH for op, _ in items) or empty or chars is None or any(not c.isascii() for c in chars):
        return pattern
    both = sorted({x for c in chars for x in (c, c.upper())})
    return f"{flags or ''}(?=[{''.join(f'\\x{ord(c):02x}' for c in both)}])(?:{rest})"


def _automaton(words: dict[str, list[int]], always: list[int]):
    machine = ahocorasick.Automaton()
    for word, rules in words.items():
        machine.add_word(word, tuple(rules))
    machine.make_automaton()

    @F.arrow_udf("array<int>")
    def present(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            found = set(always)
            if text.is_valid:
                for _, rules in machine.iter(text.as_py().lower()):
                    found.update(rules)
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.int32()))

    return present


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches small that texts go to Python in: a task's memory follows them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def possible(content: Column, rules: Sequence[Rule], automaton: bool = ahocorasick is not None) -> Column:
    """Positions in `rules` of those that may match, as array<int>."""
    words: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        literals = required(r.pattern)
        if literals is None:
            always.append(i)
        for word in literals or ():
            words.setdefault(word, []).append(i)
    if automaton and words:
        return _automaton(words, always)(content)
    low = F.lower(content)
    one = lambda i: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w, of in words.items() if i in of])
    each = [F.lit(i) if i in always else F.when(one(i), F.lit(i)) for i in range(len(rules))]
    return F.array_compact(F.array(*each))
