"""Typed expressions over one row, a key or a group: each is a Spark column and what is known about it.

An expression is one value or a bag (a column of a group). Scalar operators take single known values: a
bag or a value that may be missing is refused instead of folded or passed on as null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .domains import BOOL, INT, REAL, STRING, TIMESTAMP, Domain, RuleError, of_value


@dataclass(frozen=True, eq=False)
class Expr:
    """column: over the rows or the group; single: the same where a group has one row."""

    column: Column
    domain: Domain
    optional: bool = False
    bag: bool = False
    single: Column | None = None
    aggregate: bool = False
    known: frozenset[str] = field(default_factory=frozenset)  # columns that are known where this is true
    name: str | None = None
    literal: object = None

    @property
    def alone(self) -> Column:
        return self.column if self.single is None else self.single

    def _with(self, f: Callable, *others: Expr, domain: Domain, **more) -> Expr:
        every = (self, *others)
        return Expr(f(*(x.column for x in every)), domain, single=f(*(x.alone for x in every)), aggregate=any(x.aggregate for x in every), **more)

    def _value(self, what: str) -> Expr:
        if self.bag:
            raise RuleError(f"{what} takes one value, not a bag; use map before grouping or an aggregate")
        if self.optional:
            raise RuleError(f"{what} takes a known value; {self.name or 'this one'} may be missing")
        return self

    def _pair(self, other, what: str) -> tuple[Expr, Expr]:
        return self._value(what), lift(other)._value(what)

    def _number(self, other, what: str, f: Callable, only: Domain | None = None, turned: bool = False) -> Expr:
        a, b = self._pair(other, what)
        a, b = (b, a) if turned else (a, b)
        if not a.domain.numeric or a.domain != b.domain or only and a.domain != only:
            raise RuleError(f"{what} of {a.domain} and {b.domain}")
        return a._with(f, b, domain=a.domain)

    def __add__(self, o):
        return self._number(o, "+", lambda a, b: a + b)

    def __radd__(self, o):
        return self._number(o, "+", lambda a, b: a + b, turned=True)

    def __sub__(self, o):
        return self._number(o, "-", lambda a, b: a - b)

    def __rsub__(self, o):
        return self._number(o, "-", lambda a, b: a - b, turned=True)

    def __mul__(self, o):
        return self._number(o, "*", lambda a, b: a * b)

    def __rmul__(self, o):
        return self._number(o, "*", lambda a, b: a * b, turned=True)

    def __truediv__(self, o):
        return self._number(o, "/", lambda a, b: a / b, REAL)

    def __rtruediv__(self, o):
        return self._number(o, "/", lambda a, b: a / b, REAL, turned=True)

    def __pow__(self, o):
        a, b = self._pair(o, "^")
        if a.domain != INT:
            return a._number(b, "^", F.pow)
        if b.domain != INT or not isinstance(b.literal, int) or b.literal < 0:
            raise RuleError("an int power takes a literal exponent of 0 or more (powers of doubles are inexact)")

        def power(x: Column, _: Column) -> Column:
            out = F.lit(1).cast("bigint")
            for _k in range(b.literal):
                out = out * x
            return out

        return a._with(power, b, domain=INT)

    def __neg__(self):
        self._value("-")
        if not self.domain.numeric:
            raise RuleError(f"- of {self.domain}")
        return self._with(lambda a: -a, domain=self.domain)

    def _order(self, other, what: str, f: Callable) -> Expr:
        a, b = self._pair(other, what)
        if a.domain != b.domain or not a.domain.orderable:
            raise RuleError(f"{what} of {a.domain} and {b.domain}")
        return a._with(f, b, domain=BOOL)

    def __lt__(self, o):
        return self._order(o, "<", lambda a, b: a < b)

    def __le__(self, o):
        return self._order(o, "<=", lambda a, b: a <= b)

    def __gt__(self, o):
        return self._order(o, ">", lambda a, b: a > b)

    def __ge__(self, o):
        return self._order(o, ">=", lambda a, b: a >= b)

    def _same(self, other, what: str, f: Callable) -> Expr:
        a, b = self._pair(other, what)
        for x, y in ((a, b), (b, a)):
            if x.domain.variants and y.literal is not None and y.domain == STRING:
                if y.literal not in x.domain.variants:
                    raise RuleError(f"{y.literal!r} is no variant of {x.domain}")
                return a._with(f, b, domain=BOOL)
        if a.domain != b.domain or not a.domain.equatable:
            raise RuleError(f"{what} of {a.domain} and {b.domain}")
        return a._with(f, b, domain=BOOL)

    def __eq__(self, o):
        return self._same(o, "==", lambda a, b: a == b)

    def __ne__(self, o):
        return self._same(o, "!=", lambda a, b: a != b)

    __hash__ = None

    def __and__(self, o):
        a, b = truth(self), truth(lift(o))
        return a._with(lambda x, y: x & y, b, domain=BOOL, known=a.known | b.known)

    def __or__(self, o):
        a, b = truth(self), truth(lift(o))
        return a._with(lambda x, y: x | y, b, domain=BOOL, known=a.known & b.known)

    def __invert__(self):
        return truth(self)._with(lambda a: ~a, domain=BOOL)

    def __bool__(self):
        raise RuleError("use &, | and ~, and cond() for a choice")

    def is_known(self) -> Expr:
        return self._presence(lambda a: a.isNotNull(), frozenset((self.name,)) if self.name else frozenset())

    def is_missing(self) -> Expr:
        return self._presence(lambda a: a.isNull(), frozenset())

    def _presence(self, f: Callable, known: frozenset) -> Expr:
        if self.bag:
            raise RuleError("a bag is neither known nor missing")
        return self._with(f, domain=BOOL, known=known)

    def default(self, value) -> Expr:
        """This value, or ``value`` where it is missing."""
        other = lift(value)._value("default")
        if self.bag or self.domain != other.domain and not (self.domain.variants and other.literal in self.domain.variants):
            raise RuleError(f"default of {self.domain} and {other.domain}")
        return self._with(F.coalesce, other, domain=self.domain)

    def is_in(self, bag: Expr) -> Expr:
        """Whether ``bag`` holds this value; missing elements match nothing."""
        value = self._value("in")
        same = value.domain == bag.domain or bag.domain.variants and value.literal in bag.domain.variants
        if not bag.bag or not same or not bag.domain.equatable:
            raise RuleError(f"{value.domain} in {bag.domain}")
        f = lambda v, b: F.coalesce(b == v, F.lit(False))
        return Expr(F.bool_or(f(value.column, bag.column)), BOOL, single=f(value.alone, bag.alone), aggregate=True)


def lift(value) -> Expr:
    """A literal as an expression."""
    if isinstance(value, Expr):
        return value
    domain = of_value(value)
    return Expr(F.lit(value).cast(domain.spark), domain, literal=value)


def truth(e: Expr) -> Expr:
    e = lift(e)._value("a condition")
    if e.domain != BOOL:
        raise RuleError(f"a condition of {e.domain}")
    return e


def choose(condition: Expr, then, otherwise) -> Expr:
    """One of two values of one domain."""
    c, a, b = truth(condition), lift(then), lift(otherwise)
    if a.bag or b.bag or a.domain != b.domain:
        raise RuleError(f"a choice of {a.domain} and {b.domain}")
    return c._with(lambda x, y, z: F.when(x, y).otherwise(z), a, b, domain=a.domain, optional=a.optional or b.optional)


def to_real(e: Expr) -> Expr:
    """An int value or bag as real; stays optional if it was."""
    if e.domain != INT:
        raise RuleError(f"to_real of {e.domain}")
    return Expr(e.column.cast("double"), REAL, e.optional, e.bag, e.alone.cast("double"), e.aggregate)


def _fold(e: Expr, what: str, ok: Callable[[Domain], bool], domain: Domain, f: Callable, single: Callable) -> Expr:
    if not isinstance(e, Expr) or not e.bag:
        raise RuleError(f"{what} takes a bag")
    if e.optional:
        raise RuleError(f"{what} takes a bag without missing values")
    if not ok(e.domain):
        raise RuleError(f"{what} of {e.domain}")
    return Expr(f(e.column), domain, single=single(e.alone), aggregate=True)


def sum_(e: Expr) -> Expr:
    return _fold(e, "sum", lambda d: d.numeric, e.domain, F.sum, lambda a: a)


def min_(e: Expr) -> Expr:
    return _fold(e, "min", lambda d: d.orderable, e.domain, F.min, lambda a: a)


def max_(e: Expr) -> Expr:
    return _fold(e, "max", lambda d: d.orderable, e.domain, F.max, lambda a: a)


def count(e: Expr) -> Expr:
    return _fold(e, "count", lambda d: True, INT, lambda a: F.count(F.lit(1)), lambda a: F.lit(1).cast("bigint"))


def _each(e: Expr, test: Callable | None, what: str) -> Expr:
    """The bag of what ``test`` says of each element."""
    if test is None:
        return e
    if not isinstance(e, Expr) or not e.bag or e.optional:
        raise RuleError(f"{what} takes a bag without missing values")
    said = truth(test(Expr(e.column, e.domain, single=e.alone)))
    return Expr(said.column, BOOL, bag=True, single=said.alone)


def any_(e: Expr, test: Callable | None = None) -> Expr:
    """Whether a bag of truths holds one, or ``test`` holds for an element."""
    e = _each(e, test, "any")
    return _fold(e, "any", lambda d: d == BOOL, BOOL, F.bool_or, lambda a: a)


def all_(e: Expr, test: Callable | None = None) -> Expr:
    """Whether a bag holds truths alone, or ``test`` holds for each element."""
    e = _each(e, test, "all")
    return _fold(e, "all", lambda d: d == BOOL, BOOL, F.bool_and, lambda a: a)


def mean(e: Expr) -> Expr:
    """Sum by count."""
    return (sum_(e) if e.domain == REAL else to_real(sum_(e))) / to_real(count(e))


def _known_fold(e: Expr, what: str, ok: Callable[[Domain], bool], f: Callable) -> Expr:
    if not isinstance(e, Expr) or not e.bag or not ok(e.domain):
        raise RuleError(f"{what} takes a bag of a fitting domain")
    return Expr(f(e.column), e.domain, optional=True, single=e.alone, aggregate=True)


def sum_known(e: Expr) -> Expr:
    """The sum of the known elements; missing if none is known. Beyond the algebra, as are the next three."""
    return _known_fold(e, "sum_known", lambda d: d.numeric, F.sum)


def min_known(e: Expr) -> Expr:
    return _known_fold(e, "min_known", lambda d: d.orderable, F.min)


def max_known(e: Expr) -> Expr:
    return _known_fold(e, "max_known", lambda d: d.orderable, F.max)


def count_known(e: Expr) -> Expr:
    """How many elements are known."""
    if not isinstance(e, Expr) or not e.bag:
        raise RuleError("count_known takes a bag")
    return Expr(F.count(e.column), INT, single=F.when(e.alone.isNull(), 0).otherwise(1).cast("bigint"), aggregate=True)


def _from_real(e: Expr, what: str, f: Callable, domain: Domain = INT) -> Expr:
    if lift(e)._value(what).domain != REAL:
        raise RuleError(f"{what} of {lift(e).domain}")
    return lift(e)._with(f, domain=domain)


def floor_(e: Expr) -> Expr:
    """The largest int that isn't above a real."""
    return _from_real(e, "floor", lambda a: F.floor(a).cast("bigint"))


def ceil_(e: Expr) -> Expr:
    """The smallest int that isn't below a real."""
    return _from_real(e, "ceil", lambda a: F.ceil(a).cast("bigint"))


def trunc_(e: Expr) -> Expr:
    """A real without its fraction, as int."""
    return _from_real(e, "trunc", lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("bigint"))


def round_(e: Expr, places: int = 0) -> Expr:
    """A real to so many decimal places; halves go away from zero."""
    return _from_real(e, "round", lambda a: F.round(a, places), REAL)


def _by(a: Expr, b, what: str, f: Callable) -> Expr:
    a, b = a._pair(b, what)
    if a.domain != INT or b.domain != INT or not isinstance(b.literal, int) or b.literal <= 0:
        raise RuleError(f"{what} takes an int and a literal above 0")
    return a._with(f, b, domain=INT)


def mod(a: Expr, b: int) -> Expr:
    """The remainder from 0 to b - 1."""
    return _by(a, b, "mod", F.pmod)


def div(a: Expr, b: int) -> Expr:
    """The quotient that goes with ``mod``: rounded down."""
    return _by(a, b, "div", lambda x, y: F.call_function("div", x - F.pmod(x, y), y))


def hashed(n: int, *values: Expr) -> Expr:
    """A number from 0 to n - 1 that depends on the values alone: for deterministic parts of a key."""
    values = [lift(v)._value("hash") for v in values]
    if not values or n < 1:
        raise RuleError("a hash takes values and a number of parts")
    return values[0]._with(lambda *x: F.pmod(F.xxhash64(*x), F.lit(n)), *values[1:], domain=INT)


def now() -> Expr:
    """The time at which the query began, the same for all its rows (of each batch, on a stream)."""
    return Expr(F.localtimestamp(), TIMESTAMP)


class Columns:
    """The columns in scope, as attributes or items."""

    def __init__(self, exprs: dict[str, Expr]):
        self._exprs = exprs

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Expr:
        if name not in self._exprs:
            raise RuleError(f"no column {name} here; there are {', '.join(self._exprs)}")
        return self._exprs[name]
