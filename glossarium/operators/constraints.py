"""Constraints of hand-made files as tables, and one checker for all of them.

A file's format is a list of checks: a field, what must hold for it and the
bounds. The checker turns a row, or an element of one of its lists, into the
codes of the checks that fail, ``field:kind``; null fails unless a field may be
left out. Rules over several fields are named conditions beside the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of exam sections that English text may use as they are.
SECTIONS = "듣기|말하기|읽기|쓰기"
_QUOTED = "“[^”]*(”|$)|‘[^’]*(’|$)|\"[^\"]*(\"|$)"
_CONTROL = r"\p{Cntrl}"


def words_of(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))


def has_hangul(c: Column) -> Column:
    return c.rlike("[가-힣]")


def _tidy(c: Column) -> Column:
    return ~c.rlike(_CONTROL) & (F.trim(c) == c)


def _within(n: Column, least: int, most: int | None) -> Column:
    return n >= least if most is None else n.between(least, most)


#: What can be asked of a field: (field, bounds...) to whether it holds.
KINDS: dict[str, Callable[..., Column]] = {
    "filled": lambda c: F.trim(c) != "",
    "tidy": _tidy,
    "no-hangul": lambda c: ~has_hangul(F.regexp_replace(F.regexp_replace(c, _QUOTED, ""), SECTIONS, "")),
    "hangul": has_hangul,
    "no-hangul-at-all": lambda c: ~has_hangul(c),
    "words": lambda c, least, most=None: _within(words_of(c), least, most),
    "items": lambda c, least, most=None: _within(F.size(c), least, most),
    "range": lambda c, least, most: c.between(least, most),
    "one-of": lambda c, *values: c.isin(*values),
    "like": lambda c, pattern: c.rlike(pattern),
    "all-different": lambda c: F.size(F.array_distinct(c)) == F.size(c),
}


class Check(NamedTuple):
    field: str
    kind: str
    bounds: tuple = ()
    #: Null is fine.
    optional: bool = False


def english(field: str, least: int | None = None, most: int | None = None, optional: bool = False) -> list[Check]:
    """English text: there, tidy, without Hangul outside quotes, of a number of words."""
    own = [Check(field, kind, (), optional) for kind in ("filled", "no-hangul", "tidy")]
    return own + ([Check(field, "words", (least, most), optional)] if least is not None else [])


def sentence(field: str, least: int | None = None) -> list[Check]:
    """A Korean sentence: tidy, with an end mark."""
    own = [Check(field, "hangul"), Check(field, "tidy"), Check(field, "like", ("[.?!…”\"]$",))]
    return own + ([Check(field, "words", (least, None))] if least else [])


def named(code: str, holds: Column) -> Column:
    """The code where the condition doesn't hold, or is null."""
    return F.when(~F.coalesce(holds, F.lit(False)), F.lit(code))


def failed(checks: Iterable[Check], at: Callable[[str], Column], prefix: str = "", also: Iterable[tuple[str, Column]] = ()) -> Column:
    """The codes of the checks that fail, in the table's order, then those of further conditions that don't hold."""
    out = []
    for c in checks:
        holds = KINDS[c.kind](at(c.field), *c.bounds)
        out.append(named(f"{prefix}{c.field}:{c.kind}", holds | at(c.field).isNull() if c.optional else holds))
    out += [named(f"{prefix}{code}", holds) for code, holds in also]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def inside(x: Column) -> Callable[[str], Column]:
    """Fields of a struct, a.b for nested ones and a.0 for list elements."""

    def at(field: str) -> Column:
        c = x
        for name in field.split("."):
            c = F.get(c, F.lit(int(name))) if name.isdigit() else c[name]
        return c

    return at


def each(items: Column, checks: Iterable[Check], prefix: str, also: Callable[[Column], Iterable[tuple[str, Column]]] = lambda x: ()) -> Column:
    """The codes of all elements of a list."""
    return F.flatten(F.transform(items, lambda x: failed(checks, inside(x), prefix, also(x))))
