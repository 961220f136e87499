"""Version ranges: ``satisfies`` for versions and ranges in the common package-manager grammar, as a pandas UDF."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERSION = re.compile(r"^\s*[v=]*\s*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$")
_PARTIAL = re.compile(r"^[v=]*(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")


def parse(text: str) -> tuple | None:
    """A sortable version: a release sorts after its pre-releases; numeric identifiers sort before others."""
    m = _VERSION.match(text)
    if not m:
        return None
    pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in m[4].split(".")) if m[4] else ()
    return int(m[1]), int(m[2]), int(m[3]), (0, pre) if pre else (1, ())


def _partial(text: str) -> tuple[list[int | None], tuple] | None:
    m = _PARTIAL.match(text.strip())
    if not m:
        return None
    numbers: list[int | None] = [int(g) if g and g.isdigit() else None for g in m.groups()[:3]]
    for k in range(2):
        if numbers[k] is None:
            numbers[k + 1] = None
    pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in m[4].split(".")) if m[4] else ()
    return numbers, pre


def _low(numbers: list[int | None], pre: tuple) -> tuple:
    return (*(n or 0 for n in numbers), (0, pre) if pre else (1, ()))


def _next(numbers: list[int | None], place: int) -> tuple:
    """The least pre-release of the version that follows at ``place``."""
    head = [n or 0 for n in numbers[: place + 1]]
    head[-1] += 1
    return (*head, *[0] * (2 - place), (0, ()))


def _bounds(term: str) -> list[tuple[str, tuple]] | None:
    """Comparisons that one term of a range stands for."""
    m = re.match(r"^(\^|~>?|[<>]=?|=)?\s*(.*)$", term)
    op, got = m[1] or "", _partial(m[2])
    if got is None:
        return None
    numbers, pre = got
    given = sum(n is not None for n in numbers)
    if given == 0:
        return [] if op not in ("<", ">") else [("<", (0, 0, 0, (0, ())))]
    low = _low(numbers, pre)
    if op == "^":
        place = next((k for k in range(given) if numbers[k]), given - 1)
        return [(">=", low), ("<", _next(numbers, place))]
    if op.startswith("~"):
        return [(">=", low), ("<", _next(numbers, min(1, given - 1)))]
    if op in ("", "="):
        return [("=", low)] if given == 3 else [(">=", low), ("<", _next(numbers, given - 1))]
    if given < 3 and op == ">":
        return [(">=", _next(numbers, given - 1)[:3] + ((1, ()),))]
    if given < 3 and op == "<=":
        return [("<", _next(numbers, given - 1))]
    return [(op, low)]


@functools.lru_cache(4096)
def compile_range(text: str) -> tuple | None:
    """Alternatives of comparisons, or None where the range cannot be read."""
    alternatives = []
    for one in text.split("||"):
        one = re.sub(r"([\^~<>=]+)\s+", r"\1", one.strip())
        if hyphen := re.match(r"^(\S+)\s+-\s+(\S+)$", one):
            low, high = _partial(hyphen[1]), _partial(hyphen[2])
            if low is None or high is None:
                return None
            given = sum(n is not None for n in high[0])
            top = [("<=", _low(*high))] if given == 3 else [("<", _next(high[0], given - 1))] if given else []
            alternatives.append(tuple([(">=", _low(*low)), *top]))
            continue
        bounds = [_bounds(t) for t in one.split()]
        if any(b is None for b in bounds):
            return None
        alternatives.append(tuple(c for b in bounds for c in b))
    return tuple(alternatives)


def satisfies(version: str | None, wanted: str | None) -> bool | None:
    """Whether the version is in the range; a pre-release only where a comparison names a pre-release of the same numbers. None where either cannot be read."""
    v, ranges = parse(version or ""), compile_range(wanted) if wanted is not None else None
    if v is None or ranges is None:
        return None
    tests = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    for alternative in ranges:
        if all(tests[op](v, to) for op, to in alternative) and (v[3][0] or any(to[:3] == v[:3] and not to[3][0] and to[3][1] for _, to in alternative)):
            return True
    return False


@F.pandas_udf(T.BooleanType())
def satisfies_udf(version: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([satisfies(v, w) for v, w in zip(version, wanted, strict=True)], dtype=object)
