"""Document-store queries as Catalyst plans: predicates, sorting, paging, projection.

A ``Query`` is a small tree that compiles to one Column, so filters reach the
scan. Missing-value rules (a missing field is null; ``""`` is a value of its
own; the word ``"None"`` means missing or empty) are those of the operators'
docstrings, and differ from SQL's where a negation meets null.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum, auto
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of one predicate; more belong into a table and a semi join (``by_keys``).
MOST_VALUES = 1000
#: Elements returned as inner hits.
MOST_INNER_HITS = 100
#: Rows of one page or result.
MOST_ROWS = 10_000
NONE = "None"


class Op(Enum):
    """What a leaf asks of its field."""

    GT = auto()
    LT = auto()
    GE = auto()
    LE = auto()
    BETWEEN = auto()
    IN = auto()
    NOT_IN = auto()
    EQ = auto()
    NE = auto()
    LIKE = auto()
    NOT_LIKE = auto()
    IN_LIKE = auto()
    WILDCARD = auto()
    NOT_WILDCARD = auto()
    IN_WILDCARD = auto()
    PREFIX = auto()
    REGEXP = auto()
    EXISTS = auto()
    MISSING = auto()
    ALL = auto()
    IDS = auto()
    MATCH = auto()
    PHRASE = auto()
    ALL_TERMS = auto()
    ANY_TERMS = auto()


# ------------------------------------------------------------------ analysis

#: The analysis of text: lower case, runs of letters and digits, East Asian characters one by one.
TOKEN = r"([぀-ヿ㐀-鿿]|[a-z0-9À-ɏͰ-ӿ]+)"


def tokens(text: Column | str) -> Column:
    """The tokens of a text as an array; null for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def token_list(text: str) -> list[str]:
    """``tokens`` of a Python string."""
    return re.findall(TOKEN, text.lower())


def token_line(text: Column | str) -> Column:
    """The tokens of a text in one string, a blank around each."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def quorum(clause: str | int, optional: int) -> int:
    """How many of ``optional`` clauses must match: ``3``, ``-2``, ``75%``, ``-25%``, ``2<-25%`` (several, blank between)."""
    text = str(clause).strip()
    if "<" in text:
        needed = optional
        for part in text.split():
            limit, _, rule = part.partition("<")
            if optional > int(limit):
                needed = quorum(rule, optional)
        return needed
    if text.endswith("%"):
        share = float(text[:-1]) / 100
        n = math.floor(optional * abs(share))
        n = optional - n if share < 0 else n
    else:
        n = int(text)
        n = optional + n if n < 0 else n
    return max(0, min(n, optional))


def _has_specials(value: str) -> bool:
    return bool(re.search(r"[^\w]", value))


def like(text: Column, value: str, minimum: str | int | None = None) -> Column:
    """Text search: all tokens of a value with blanks or signs (or a quorum of them), else the lower-cased value as a phrase.

    Null for a null text. A value without tokens matches nothing.
    """
    wanted = list(dict.fromkeys(token_list(value)))
    if not wanted:
        return F.lit(False) & text.isNotNull()
    if minimum is not None:
        return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, wanted)))) >= quorum(minimum, len(wanted))
    if _has_specials(value):
        have = tokens(text)
        return functools.reduce(lambda a, b: a & b, [F.array_contains(have, w) for w in wanted])
    return F.contains(token_line(text), F.lit(f" {' '.join(token_list(value))} "))


def phrase(text: Column, value: str, slop: int = 0) -> Column:
    """The value's tokens one after another; with slop, up to so many other tokens in between."""
    wanted = token_list(value)
    if not wanted:
        return F.lit(False) & text.isNotNull()
    if slop == 0:
        return F.contains(token_line(text), F.lit(f" {' '.join(wanted)} "))
    gap = rf" (?:\S+ ){{0,{slop}}}"
    return F.regexp_like(token_line(text), F.lit(" " + gap.join(map(re.escape, wanted)) + " "))


def wildcard(text: Column, value: str) -> Column:
    """The value anywhere in the text, as it stands."""
    return F.contains(text, F.lit(value))


# ------------------------------------------------------------------ tree


@dataclass(frozen=True)
class Query:
    """A predicate: a leaf on a field, or a combination of others, maybe on one element of a nested array."""

    op: Op | None = None
    name: str | None = None
    values: tuple = ()
    minimum: str | int | None = None
    parts: tuple[Query, ...] = ()
    conjunction: bool = True
    negated: bool = False
    nested: str | None = None

    def __post_init__(self) -> None:
        if len(self.values) > MOST_VALUES:
            raise ValueError(f"{len(self.values)} values; over {MOST_VALUES} use by_keys")
        if self.op is Op.IDS:
            kept = tuple(str(v) for v in self.values if v not in (None, ""))
            if not kept:
                raise ValueError("no id is left")
            object.__setattr__(self, "values", kept)

    def __and__(self, other: Query) -> Query:
        return Query(parts=(self, other))

    def __or__(self, other: Query) -> Query:
        return Query(parts=(self, other), conjunction=False)

    def __invert__(self) -> Query:
        return replace(self, negated=not self.negated)

    def column(self, resolve: Callable[[str], Column] = F.col) -> Column:
        """The predicate as a Column; unknown counts as not matching.

        It may be null where a field is missing, which a filter takes for no;
        only under a negation is that made explicit, so that plain predicates
        stay in the form that is pushed to the scan.
        """
        if self.nested:
            inner = replace(self, nested=None, negated=False)
            out = F.exists(resolve(self.nested), lambda x: inner.column(lambda f: x[f]))
        elif self.parts:
            columns = [p.column(resolve) for p in self.parts]
            out = functools.reduce((lambda a, b: a & b) if self.conjunction else (lambda a, b: a | b), columns)
        elif self.op is None:
            out = F.lit(True)
        else:
            out = _leaf(self, resolve)
        return ~F.coalesce(out, F.lit(False)) if self.negated else out


def where(op: Op, name: str | None = None, *values: Any, minimum: str | int | None = None) -> Query:
    """A leaf."""
    return Query(op, name, tuple(values), minimum)


def every(*queries: Query, nested: str | None = None) -> Query:
    """All of the queries; with ``nested``, on one and the same element of that array."""
    return Query(parts=tuple(queries), nested=nested)


def some(*queries: Query, nested: str | None = None) -> Query:
    """Any of the queries; with ``nested``, on an element of that array."""
    return Query(parts=tuple(queries), conjunction=False, nested=nested)


def boolean(must: Sequence[Query] = (), should: Sequence[Query] = (), must_not: Sequence[Query] = (), filters: Sequence[Query] = (), minimum: str | int | None = None) -> Callable[[Callable[[str], Column]], Column]:
    """A boolean query as a function of the resolver. Without ``must`` and ``filters`` at least one ``should`` counts."""

    def column(resolve: Callable[[str], Column] = F.col) -> Column:
        out = F.lit(True)
        for q in (*must, *filters):
            out = out & q.column(resolve)
        for q in must_not:
            out = out & ~F.coalesce(q.column(resolve), F.lit(False))
        need = quorum(minimum, len(should)) if minimum is not None else int(bool(should) and not must and not filters)
        if should and need:
            out = out & (functools.reduce(lambda a, b: a + b, [F.coalesce(q.column(resolve), F.lit(False)).cast("int") for q in should]) >= need)
        return out

    return column


def _leaf(q: Query, resolve: Callable[[str], Column]) -> Column:
    if q.op is Op.ALL:
        return F.lit(True)
    c, v = resolve(q.name), q.values
    first = v[0] if v else None
    match q.op:
        case Op.GT:
            return c > first
        case Op.LT:
            return c < first
        case Op.GE:
            return c >= first
        case Op.LE:
            return c <= first
        case Op.BETWEEN:
            # Inclusive; bounds written the wrong way round are swapped, missing ones refused.
            if len(v) != 2 or any(x is None or x == "" for x in v):
                raise ValueError("between needs two bounds")
            return c.between(F.least(F.lit(v[0]), F.lit(v[1])), F.greatest(F.lit(v[0]), F.lit(v[1])))
        case Op.IN:
            # A None among the values means "missing or one of the rest"; none at all means missing.
            rest = [x for x in v if x is not None]
            out = c.isin(rest) if rest else F.lit(False)
            return (c.isNull() | out) if len(rest) < len(v) or not v else out
        case Op.NOT_IN:
            # Rows with a missing field pass unless None is listed; no values means the field exists.
            rest = [x for x in v if x is not None]
            if not v:
                return c.isNotNull()
            out = ~F.coalesce(c.isin(rest), F.lit(False)) if rest else F.lit(True)
            return c.isNotNull() & out if len(rest) < len(v) else out
        case Op.EQ:
            if not v or first is None:
                return c.isNull()
            return c.isNull() | (c == "") if first == NONE else c == F.lit(first)
        case Op.NE:
            if not v or first is None:
                return c.isNotNull()
            return c.isNotNull() & (c != "") if first == NONE else ~c.eqNullSafe(F.lit(first))
        case Op.LIKE:
            return c.isNull() if first is None else like(c, first, q.minimum)
        case Op.NOT_LIKE:
            return c.isNotNull() if first is None else ~F.coalesce(like(c, first, q.minimum), F.lit(False))
        case Op.IN_LIKE:
            return functools.reduce(lambda a, b: a | b, [F.coalesce(like(c, x, q.minimum), F.lit(False)) for x in v]) if v else c.isNull()
        case Op.WILDCARD:
            return wildcard(c, first)
        case Op.NOT_WILDCARD:
            return ~F.coalesce(wildcard(c, first), F.lit(False))
        case Op.IN_WILDCARD:
            return functools.reduce(lambda a, b: a | b, [wildcard(c, x) for x in v]) if v else c.isNull()
        case Op.PREFIX:
            return F.startswith(c, F.lit(first))
        case Op.REGEXP:
            return F.regexp_like(c, F.lit(first))
        case Op.EXISTS:
            return c.isNotNull()
        case Op.MISSING:
            return c.isNull()
        case Op.IDS:
            return c.cast("string").isin(list(v))
        case Op.MATCH:
            wanted = list(dict.fromkeys(t for x in v for t in token_list(x)))
            return F.size(F.array_intersect(tokens(c), F.array(*map(F.lit, wanted)))) >= max(1, quorum(q.minimum if q.minimum is not None else 1, len(wanted))) if wanted else F.lit(False)
        case Op.PHRASE:
            return phrase(c, first, int(q.minimum or 0))
        case Op.ALL_TERMS:
            return F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0
        case Op.ANY_TERMS:
            return F.arrays_overlap(c, F.array(*map(F.lit, v)))
    raise ValueError(f"unknown operator {q.op}")


def inner_hits(array: Column | str, query: Query, fields: Sequence[str] = (), most: int = MOST_INNER_HITS) -> Column:
    """The elements of a nested array that match, at most ``most``, with the chosen fields only."""
    array = F.col(array) if isinstance(array, str) else array
    hits = F.slice(F.filter(array, lambda x: query.column(lambda f: x[f])), 1, most)
    return F.transform(hits, lambda x: F.struct(*[x[f].alias(f) for f in fields])) if fields else hits


def nested_score(array: Column | str, query: Query, score: Callable[[Column], Column], mode: str = "avg") -> Column:
    """The score of a nested match over its matching elements: avg, max, min, sum, or none (0)."""
    array = F.col(array) if isinstance(array, str) else array
    scores = F.transform(F.filter(array, lambda x: query.column(lambda f: x[f])), score)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return {"avg": total / F.nullif(F.size(scores), F.lit(0)), "sum": total, "max": F.array_max(scores), "min": F.array_min(scores), "none": F.lit(0.0)}[mode]


# ------------------------------------------------------------------ order, pages, projection


def order_columns(orders: Sequence[tuple[str, str] | str]) -> list[Column]:
    """Sort keys; missing values last in either direction."""
    out = []
    for o in orders:
        name, way = (o, "asc") if isinstance(o, str) else o
        out.append(F.desc_nulls_last(name) if way.lower() == "desc" else F.asc_nulls_last(name))
    return out


def clamp(size: int, most: int = MOST_ROWS, least: int = 0) -> int:
    """A size within bounds; a negative one is the most."""
    return most if size < 0 else max(least, min(size, most))


def offset_of(page_index: int, page_size: int) -> int:
    """The rows before a page; pages count from 1, and lesser ones are the first."""
    return 0 if page_index < 2 else (page_index - 1) * page_size


def project(df: DataFrame, fields: Sequence[str] | str | None, key: str | None = None) -> DataFrame:
    """All fields for None, those of a list or of ``"a, b"``, the key alone for ``"None"``."""
    if fields is None:
        return df
    if fields == NONE:
        return df.select(key)
    names = [x.strip() for x in fields.split(",")] if isinstance(fields, str) else list(fields)
    return df.select(*dict.fromkeys(([key] if key else []) + [x for x in names if x]))


@dataclass(frozen=True)
class Page:
    """A request for documents."""

    query: Query = field(default_factory=Query)
    orders: tuple = ()
    page_index: int = 1
    page_size: int = -1
    fields: Sequence[str] | str | None = None
    key: str | None = None


def get_page(df: DataFrame, request: Page) -> DataFrame:
    """The rows of a request: all of them for a negative size, their number (column ``total``) for size 0, else one page."""
    rows = df.where(request.query.column())
    if request.page_size == 0:
        return rows.agg(F.count("*").alias("total"))
    if request.orders:
        rows = rows.orderBy(*order_columns(request.orders))
    if request.page_size > 0:
        rows = rows.offset(offset_of(request.page_index, request.page_size)).limit(request.page_size)
    return project(rows, request.fields, request.key)


def page_after(df: DataFrame, keys: Sequence[str], last: Sequence[Any] | None, size: int, query: Query | None = None) -> DataFrame:
    """Keyset paging: the next ``size`` rows after the key values ``last``, by ascending keys that hold no null."""
    rows = df.where(query.column()) if query else df
    if last is not None:
        after = F.lit(False)
        for i, name in enumerate(keys):
            same = functools.reduce(lambda a, b: a & b, [F.col(k) == F.lit(x) for k, x in zip(keys[:i], last)], F.lit(True))
            after = after | (same & (F.col(name) > F.lit(last[i])))
        rows = rows.where(after)
    return rows.orderBy(*keys).limit(size)


def by_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in a table of keys (column of the same name), of any size."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def get_one(df: DataFrame, query: Query, orders: Sequence = ()) -> DataFrame:
    """The first match by an order (or any), at most one row."""
    rows = df.where(query.column())
    return (rows.orderBy(*order_columns(orders)) if orders else rows).limit(1)


def exact_one(df: DataFrame, query: Query) -> dict[str, Any]:
    """The one match; an error unless there is exactly one."""
    rows = df.where(query.column()).take(2)
    if len(rows) != 1:
        raise LookupError(f"{'no' if not rows else 'more than one'} row matches")
    return rows[0].asDict()


def exists(df: DataFrame, query: Query) -> bool:
    """Whether a row matches."""
    return not df.where(query.column()).limit(1).isEmpty()
