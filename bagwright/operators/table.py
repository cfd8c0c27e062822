"""Keyed tables: a DataFrame of index and value columns, and the facts that make its pipelines sound.

Each key has a bag of rows (one DataFrame row each). Four facts go along: whether a key has one row
at most, which columns may hold missing values, whether each key's rows are complete (or complete over some
columns of the key), and from which sides of which splits, or blocks of which partitions, the rows come. Operators check their rules at once, before any job, and lower to plain
DataFrame operations; projections, filters, key changes and unions never shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import INT, Domain, RuleError, enum
from ..functions.expressions import Columns, Expr, choose, lift, truth

_SPLITS = itertools.count()


@dataclass(frozen=True)
class Field:
    name: str
    domain: Domain
    optional: bool = False
    role: str = "var"


@dataclass(frozen=True)
class TableType:
    """keys: sets of columns that no two rows share (candidate keys). complete_over: columns whose every value is there for each rest of the key. lineage: one path per origin of (split, side) or (partition, block)."""

    index: tuple[Field, ...]
    values: tuple[Field, ...]
    keys: frozenset[frozenset[str]] = frozenset()
    complete: bool = False
    lineage: frozenset[tuple[tuple[int | str, bool | str], ...]] = frozenset(((),))
    complete_over: frozenset[str] = frozenset()

    @property
    def singletons(self) -> bool:
        names = {f.name for f in self.index}
        return any(k <= names for k in self.keys)

    @property
    def names(self) -> list[str]:
        return [f.name for f in (*self.index, *self.values)]

    def field(self, name: str) -> Field:
        for f in (*self.index, *self.values):
            if f.name == name:
                return f
        raise RuleError(f"no column {name}; there are {', '.join(self.names)}")


def disjoint(a: TableType, b: TableType) -> bool:
    """Whether one split or partition sends the origins of ``a`` to other sides or blocks than those of ``b``."""

    def sides(t: TableType, of) -> set:
        found = [{side for k, side in path if k == of} for path in t.lineage]
        return set().union(*found) if all(found) else set()

    splits = {k for path in a.lineage for k, _ in path}
    return any((x := sides(a, k)) and (y := sides(b, k)) and not x & y for k in splits)


class Choice:
    """A conditional body of map."""

    def __init__(self, condition: Expr, then, otherwise):
        self.condition, self.then, self.otherwise = truth(condition), then, otherwise


def cond(condition: Expr, then, otherwise):
    """One of two values, rows or bags of rows. ``then`` may be a function of the row, in which tested columns are known."""
    if isinstance(then, (Expr, int, float, str, bool)) and isinstance(otherwise, (Expr, int, float, str, bool)):
        return choose(condition, then, otherwise)
    return Choice(condition, then, otherwise)


def row(**fields) -> dict[str, Expr]:
    """A record: the value columns of one row."""
    return {k: lift(v) for k, v in fields.items()}


class KeyedTable:
    def __init__(self, df: DataFrame, kind: TableType, halves: tuple | None = None):
        if len(set(kind.names)) < len(kind.names):
            raise RuleError(f"a column name comes twice: {kind.names}")
        self.df, self.type, self._half = df.select(*kind.names), kind, halves

    def _scope(self, fields, bag: bool = False, known: frozenset = frozenset()) -> Columns:
        return Columns({f.name: Expr(F.col(f.name), f.domain, f.optional and f.name not in known, bag, name=f.name) for f in fields})

    def _derived(self, df: DataFrame, **changes) -> KeyedTable:
        return KeyedTable(df, replace(self.type, **changes))

    @property
    def index(self) -> list[str]:
        return [f.name for f in self.type.index]

    def to_df(self) -> DataFrame:
        return self.df

    # Rows

    def map(self, body: Callable) -> KeyedTable:
        """Each row to the rows that ``body(key, row)`` gives: a record, the row, (), a tuple of these, or cond()."""
        k = self._scope(self.type.index)
        own = self._scope(self.type.values)
        leaves = list(self._leaves(body(k, own), None, own, frozenset()))
        if not leaves:
            raise RuleError("this map drops every row; leave the table out instead")
        most = self._most(body(k, own), own)
        names = [n for n in self._order(leaves[0][1])]
        fields = []
        for n in names:
            domains = {r[n].domain for _, r in leaves if n in r}
            if any(set(r) != set(names) for _, r in leaves) or len(domains) > 1:
                raise RuleError("all rows of a map have the same columns and domains")
            if any(r[n].bag for _, r in leaves):
                raise RuleError(f"{n} is a bag")
            role = self.type.field(n).role if n in self.type.names else "var"
            fields.append(Field(n, leaves[0][1][n].domain, any(r[n].optional for _, r in leaves), role))
        if clash := set(names) & set(self.index):
            raise RuleError(f"a row can't set index columns: {sorted(clash)}")
        index = [F.col(n) for n in self.index]
        if len(leaves) == 1:
            guard, record = leaves[0]
            df = self.df if guard is None else self.df.filter(guard)
            df = df.select(*index, *(record[n].column.alias(n) for n in names))
        elif most == 1:
            whole = F.lit(False)
            for guard, _ in leaves:
                whole = F.lit(True) if guard is None else whole | guard
            cases = lambda n: self._cases([(g, r[n].column) for g, r in leaves])
            df = self.df.filter(whole).select(*index, *(cases(n).alias(n) for n in names))
        else:
            rows = F.array(*[F.struct((F.lit(True) if g is None else F.coalesce(g, F.lit(False))).alias("_on"), *(r[n].column.alias(n) for n in names)) for g, r in leaves])
            df = self.df.select(*index, F.inline(F.filter(rows, lambda x: x["_on"]))).drop("_on")
        keys = frozenset(k for k in self.type.keys if k <= set(self.index)) if most <= 1 else frozenset()
        if most <= 1 and any(all(n in r and r[n].name == n for _, r in leaves) for n in names):
            carried = {n for n in names if all(r[n].name == n for _, r in leaves)} | set(self.index)
            keys |= frozenset(k for k in self.type.keys if k <= carried)
        return self._derived(df, values=tuple(fields), keys=keys)

    def _order(self, record: dict) -> list[str]:
        declared = [f.name for f in self.type.values if f.name in record]
        return [*declared, *(n for n in record if n not in declared)] if set(declared) == set(record) else list(record)

    @staticmethod
    def _cases(parts: list[tuple[SparkColumn | None, SparkColumn]]) -> SparkColumn:
        out = None
        for guard, value in parts:
            guard = F.lit(True) if guard is None else guard
            out = F.when(guard, value) if out is None else out.when(guard, value)
        return out

    def _body(self, body, own: Columns, known: frozenset):
        if callable(body) and not isinstance(body, (Columns, Expr)):
            body = body(self._scope(self.type.values, known=known))
        if isinstance(body, Columns):
            return dict(self._scope(self.type.values, known=known)._exprs)
        return body

    def _leaves(self, body, guard, own, known):
        body = self._body(body, own, known)
        if isinstance(body, Choice):
            on = body.condition.column
            yield from self._leaves(body.then, on if guard is None else guard & on, own, known | body.condition.known)
            yield from self._leaves(body.otherwise, ~on if guard is None else guard & ~on, own, known)
        elif isinstance(body, (tuple, list)):
            for part in body:
                yield from self._leaves(part, guard, own, known)
        elif isinstance(body, dict) and body:
            yield guard, {n: lift(v) for n, v in body.items()}
        else:
            raise RuleError(f"a map gives rows, not {body!r}")

    def _most(self, body, own, known: frozenset = frozenset()) -> int:
        body = self._body(body, own, known)
        if isinstance(body, Choice):
            return max(self._most(body.then, own, known | body.condition.known), self._most(body.otherwise, own, known))
        return sum(self._most(p, own, known) for p in body) if isinstance(body, (tuple, list)) else 1

    def filter(self, condition: Callable) -> KeyedTable:
        """Rows for which ``condition(key, row)`` holds."""
        return self.map(lambda k, r: cond(condition(k, r), lambda own: own, ()))

    def mutate(self, **made: Callable) -> KeyedTable:
        """Rows with added or replaced value columns; each is a function of key and row."""
        return self.map(lambda k, r: {**r._exprs, **{n: lift(f(k, r)) for n, f in made.items()}})

    def select(self, *names: str) -> KeyedTable:
        return self.map(lambda k, r: {n: r[n] for n in names})

    # Groups

    def group_map(self, body: Callable) -> KeyedTable:
        """One row per key from aggregates of its bag; or, if all fields are bags, one row per row."""
        k, g = self._scope(self.type.index), self._scope(self.type.values, bag=True)
        record = body(k, g)
        if not isinstance(record, dict) or not record:
            raise RuleError("group_map gives one record")
        record = {n: lift(e) for n, e in record.items()}
        if clash := set(record) & set(self.index):
            raise RuleError(f"a record can't name index columns: {sorted(clash)}")
        fields = tuple(Field(n, e.domain, e.optional) for n, e in record.items())
        index = [F.col(n) for n in self.index]
        if any(e.bag for e in record.values()):
            if not all(e.bag for e in record.values()):
                raise RuleError("fields are all aggregates or all bags")
            return self._derived(self.df.select(*index, *(e.column.alias(n) for n, e in record.items())), values=fields, keys=frozenset())
        if self.type.singletons:  # a group of one row needs no shuffle
            df = self.df.select(*index, *(e.alone.alias(n) for n, e in record.items()))
        elif index and not any(e.aggregate for e in record.values()):
            df = self.df.select(*index).distinct().select(*index, *(e.column.alias(n) for n, e in record.items()))
        else:
            df = self.df.groupBy(*index).agg(*(e.column.alias(n) for n, e in record.items()), F.count(F.lit(1)).alias("_rows"))
            df = (df if index else df.filter("_rows > 0")).drop("_rows")  # an empty table has no groups
        return self._derived(df, values=fields, keys=frozenset((frozenset(self.index),)))

    def distinct(self) -> KeyedTable:
        """Each key's bag without repeated rows."""
        if self.type.singletons:
            return self
        return self._derived(self.df.distinct(), keys=self.type.keys | {frozenset(self.type.names)})

    def aggregate(self, *by: str, **made: Callable) -> KeyedTable:
        """Aggregates per key and ``by``; each is a function of key and group. Short for extend_key and group_map."""
        extended = self.extend_key(*by) if by else self
        return extended.group_map(lambda k, g: {n: f(k, g) for n, f in made.items()})

    def ordered(self, by: str, tie: tuple[str, ...] = (), **made) -> KeyedTable:
        """Columns that depend on an order within each key: cumsum(x), rank(), size(), lag(x), lead(x). Beyond the algebra's own operators.

        lag and lead need an order without ties: a candidate key among the key, ``by`` and ``tie``.
        """
        for n in (by, *tie):
            if not self.type.field(n).domain.orderable or self.type.field(n).optional:
                raise RuleError(f"{n} gives no order")
        if not self.index:
            raise RuleError("an order without a key would put the table in one task")
        ties = not any(k <= {*self.index, by, *tie} for k in self.type.keys)
        w = Window.partitionBy(*self.index).orderBy(by, *tie)
        fields = [*self.type.values]
        columns = []
        for n, (kind, of) in made.items():
            if kind == "rank":
                columns.append(F.rank().over(w).cast("bigint").alias(n))
                fields.append(Field(n, INT))
            elif kind == "size":
                columns.append(F.count(F.lit(1)).over(Window.partitionBy(*self.index)).alias(n))
                fields.append(Field(n, INT))
            else:
                source = self.type.field(of)
                if kind == "cumsum" and (not source.domain.numeric or source.optional):
                    raise RuleError(f"cumsum of {source.domain}")
                if kind != "cumsum" and ties:
                    raise RuleError(f"{kind} needs an order without ties; name columns for it in tie")
                made_ = {"cumsum": lambda of: F.sum(of).over(w.rangeBetween(Window.unboundedPreceding, 0)), "lag": lambda of: F.lag(of).over(w), "lead": lambda of: F.lead(of).over(w)}
                columns.append(made_[kind](of).alias(n))
                fields.append(Field(n, source.domain, kind != "cumsum"))
        return self._derived(self.df.select("*", *columns), values=tuple(fields))

    # Keys

    def extend_key(self, *names: str) -> KeyedTable:
        """Known value columns become part of the key. No work."""
        if not names:
            raise RuleError("extend_key takes columns")
        moved = []
        for n in names:
            f = self.type.field(n)
            if n in self.index or f in moved:
                raise RuleError(f"{n} is in the key")
            if not f.domain.equatable or f.optional:
                raise RuleError(f"{n} can't be part of a key: {f.domain}{', may be missing' if f.optional else ''}")
            moved.append(f)
        return self._derived(self.df, index=(*self.type.index, *moved), values=tuple(f for f in self.type.values if f not in moved))

    def shrink_key(self, *names: str) -> KeyedTable:
        """Key columns become values; rows of merged keys pool. Only for tables complete as such or over these columns; the splits are forgotten."""
        if not self.type.complete and not set(names) <= self.type.complete_over:
            raise RuleError("shrink_key needs a complete table: check or assume completeness first")
        if not names or set(names) - set(self.index):
            raise RuleError(f"shrink_key takes columns of the key {self.index}")
        moved = tuple(f for f in self.type.index if f.name in names)
        return self._derived(self.df, index=tuple(f for f in self.type.index if f not in moved), values=(*moved, *self.type.values), lineage=frozenset(((),)))

    # Joins

    def _join(self, right: KeyedTable, key: Callable, how: str) -> KeyedTable:
        if not isinstance(right, KeyedTable) or len(right.type.index) != 1:
            raise RuleError("the right side is one table with one index column")
        (of,) = right.type.index
        e = lift(key(self._scope(self.type.index), self._scope(self.type.values)))._value("a join key")
        if e.domain != of.domain and not (e.domain.spark == of.domain.spark == "string" and (e.domain.variants or of.domain.variants)):
            raise RuleError(f"a join key of {e.domain} for an index of {of.domain}")
        added = right.type.values if how in ("left", "inner") else ()
        if clash := sorted({f.name for f in added} & set(self.type.names)):
            raise RuleError(f"both sides have columns {clash}")
        # The right side isn't hinted: Spark broadcasts it where its size allows, else both are shuffled.
        other = right.df.select(F.col(of.name).alias("_key"), *(F.col(f.name) for f in added))
        if how in ("left_semi", "left_anti"):
            return self._derived(self.df.join(other, e.column == F.col("_key"), how))
        df = self.df.join(other, e.column == F.col("_key"), how).drop("_key")
        fields = tuple(replace(f, optional=f.optional or how == "left") for f in added)
        keys = self.type.keys if right.type.singletons else frozenset()
        return self._derived(df, values=(*self.type.values, *fields), keys=keys)

    def left_join(self, right: KeyedTable, key: Callable) -> KeyedTable:
        """Each row with every row of ``right`` at ``key(key, row)``; without one, with missing values."""
        return self._join(right, key, "left")

    def inner_join(self, right: KeyedTable, key: Callable) -> KeyedTable:
        return self._join(right, key, "inner")

    def anti_join(self, right: KeyedTable, key: Callable) -> KeyedTable:
        """Rows that ``right`` has no key for."""
        return self._join(right, key, "left_anti")

    def semi_join(self, right: KeyedTable, key: Callable) -> KeyedTable:
        return self._join(right, key, "left_semi")

    # Partition and union

    def split(self, condition: Callable) -> tuple[KeyedTable, KeyedTable]:
        """Two tables by a condition on the key, those for which it holds first; keys stay whole."""
        on = truth(condition(self._scope(self.type.index))).column
        on, number, out = F.coalesce(on, F.lit(False)), next(_SPLITS), []
        for side in (True, False):
            lineage = frozenset((*p, (number, side)) for p in self.type.lineage)
            out.append(KeyedTable(self.df.filter(on if side else ~on), replace(self.type, lineage=lineage), (self, number, side)))
        return out[0], out[1]

    def bind(self, other: KeyedTable) -> KeyedTable:
        """All rows of both tables (same columns and domains)."""
        if {(f.name, f.domain) for f in self.type.index} != {(f.name, f.domain) for f in other.type.index} or {(f.name, f.domain) for f in self.type.values} != {(f.name, f.domain) for f in other.type.values}:
            raise RuleError("bind takes tables of the same columns")
        if self._half and other._half and self._half[1] == other._half[1] and self._half[2] != other._half[2]:
            return self._half[0]  # both sides of one split, as they left it
        optional = {f.name for f in other.type.values if f.optional}
        apart = disjoint(self.type, other.type)
        # Tables without a common index value keep keys that contain the index.
        keys = frozenset(k for k in self.type.keys & other.type.keys if apart and k >= set(self.index))
        if apart and self.type.singletons and other.type.singletons:
            keys |= {frozenset(self.index)}
        return self._derived(
            self.df.unionByName(other.df),
            values=tuple(replace(f, optional=f.optional or f.name in optional) for f in self.type.values),
            keys=keys,
            complete=self.type.complete and other.type.complete,
            complete_over=self.type.complete_over & other.type.complete_over,
            lineage=self.type.lineage | other.type.lineage,
        )

    def tagged_bind(self, other: KeyedTable, mine: str, theirs: str, tag: str = "tag") -> KeyedTable:
        """All rows of both, with the name of their source in the enum ``tag``."""
        kind = enum(mine, theirs)
        a, b = (KeyedTable(t.df.withColumn(tag, F.lit(x)), replace(t.type, values=(*t.type.values, Field(tag, kind)))) for t, x in ((self, mine), (other, theirs)))
        return a.bind(b)

    def tagged_split(self, value: str, tag: str = "tag") -> KeyedTable:
        """The rows of one source, without the tag."""
        f = self.type.field(tag)
        if value not in f.domain.variants:
            raise RuleError(f"{value!r} is no variant of {f.domain}")
        return self._derived(self.df.filter(F.col(tag) == value).drop(tag), values=tuple(x for x in self.type.values if x.name != tag))

    # Shape

    def unpivot(self, *names: str, name: str = "name", value: str = "value") -> KeyedTable:
        """Value columns of one domain to rows, the column's name in the key; missing values stay as rows."""
        fields = [self.type.field(n) for n in names]
        if not fields or len({f.domain for f in fields}) > 1 or set(names) != {f.name for f in self.type.values}:
            raise RuleError("unpivot takes all value columns, of one domain; select them first")
        df = self.df.unpivot([F.col(n) for n in self.index], [F.col(n) for n in names], name, value)
        keys = frozenset((frozenset((*self.index, name)),)) if self.type.singletons else frozenset()
        return self._derived(df, index=(*self.type.index, Field(name, enum(*names))), values=(Field(value, fields[0].domain, any(f.optional for f in fields)),), keys=keys)

    def _pivot(self, index: tuple[Field, ...], name: str, value: str) -> tuple[DataFrame, tuple[Field, ...]]:
        kind, of = self.type.field(name), self.type.field(value)
        if not kind.domain.variants:
            raise RuleError(f"{name} is no enum; its variants are the new columns")
        if rest := {f.name for f in (*self.type.index, *self.type.values)} - {f.name for f in index} - {name, value}:
            raise RuleError(f"pivot leaves no place for {sorted(rest)}")
        df = self.df.groupBy(*(f.name for f in index)).pivot(name, list(kind.domain.variants)).agg(F.first(value))
        return df, tuple(Field(v, of.domain, True) for v in kind.domain.variants)

    def pivot(self, name: str, value: str) -> KeyedTable:
        """One row per key with a column per variant of the value column ``name``; absent ones are missing."""
        if not any(k <= {*self.index, name} for k in self.type.keys):
            raise RuleError(f"pivot needs one row per key and {name}")
        df, fields = self._pivot(self.type.index, name, value)
        return self._derived(df, values=fields, keys=frozenset((frozenset(self.index),)))

    def pivot_index(self, name: str, value: str) -> KeyedTable:
        """As ``pivot``, for a ``name`` in the key: only for complete tables of one row per key."""
        if not (self.type.complete or name in self.type.complete_over) or not self.type.singletons:
            raise RuleError("pivot over the key needs a complete table with one row per key")
        if name not in self.index:
            raise RuleError(f"{name} isn't in the key")
        index = tuple(f for f in self.type.index if f.name != name)
        df, fields = self._pivot(index, name, value)
        return self._derived(df, index=index, values=fields, keys=frozenset((frozenset(f.name for f in index),)), lineage=frozenset(((),)))

    # Facts

    def completeness_check(self, *checks: Callable[[KeyedTable], bool]) -> KeyedTable:
        """Complete from here on if all checks hold now; each is evaluated on the table."""
        for c in checks:
            if not c(self):
                raise RuleError("a completeness check failed")
        return self._derived(self.df, complete=True)

    def assume(self, complete: bool = False, disjoint_from: KeyedTable | None = None) -> KeyedTable | tuple[KeyedTable, KeyedTable]:
        """Take a fact on trust: completeness, or that two tables share no key (gives both)."""
        own = self._derived(self.df, complete=self.type.complete or complete)
        if disjoint_from is None:
            return own
        number = next(_SPLITS)
        sides = [KeyedTable(t.df, replace(t.type, lineage=frozenset((*p, (number, side)) for p in t.type.lineage))) for t, side in ((own, True), (disjoint_from, False))]
        return sides[0], sides[1]

    def row_count(self) -> int:
        return self.df.count()

    def cardinality(self, keys: KeyedTable, name: str = "n") -> KeyedTable:
        """How many rows each key of ``keys`` (one row per key, the same index) has here; 0 for a key without rows."""
        if [(f.name, f.domain) for f in keys.type.index] != [(f.name, f.domain) for f in self.type.index] or not keys.type.singletons:
            raise RuleError("cardinality takes a table of the same index with one row per key")
        if not self.index or name in self.index:
            raise RuleError("cardinality needs a key, and a name that isn't in it")
        n = self.df.groupBy(*self.index).agg(F.count(F.lit(1)).alias(name))
        df = keys.df.select(*self.index).join(n, self.index, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
        return KeyedTable(df, replace(keys.type, values=(Field(name, INT),), keys=frozenset((frozenset(self.index),))))


def disjointness_check(a: KeyedTable, b: KeyedTable, *columns: str) -> tuple[KeyedTable, KeyedTable]:
    """Both tables, known to be disjoint if they share no values of ``columns`` (their keys, if none) now."""
    names = list(columns) or a.index
    if not a.df.select(*names).join(b.df.select(*names), names, "left_semi").isEmpty():
        raise RuleError(f"the tables share values of {names}")
    return a.assume(disjoint_from=b)


def folds(t: KeyedTable, n: int, number: Callable[[Columns], Expr] | None = None) -> list[tuple[KeyedTable, KeyedTable]]:
    """``n`` pairs (train, test): test is one remainder of a hash of the key (or of ``number`` of it)."""
    if n < 2:
        raise RuleError("at least two folds")
    k = t._scope(t.type.index)
    value = F.xxhash64(*t.index) if number is None else lift(number(k))._value("a fold").column
    out = []
    for i in range(n):
        test, train = t.split(lambda _, i=i: Expr(F.pmod(value, F.lit(n)) == i, truth(lift(True)).domain))
        out.append((train, test))
    return out


def evaluate(train: KeyedTable, test: KeyedTable, fit: Callable, measure: Callable):
    """``measure(fit(train), test)``, only for tables that are known to be disjoint."""
    if not disjoint(train.type, test.type):
        raise RuleError("train and test aren't known to be disjoint")
    return measure(fit(train.df), test.df)


