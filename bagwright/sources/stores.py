"""Stores and other sources of keyed tables, and their tables on disk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domains import Domain, RuleError, of_type
from ..functions.expressions import choose, lift
from ..operators.table import Field, KeyedTable, TableType
from ..streaming.windows import valid_at


def _table(df: DataFrame, index: list[str], values: list[str] | None, domains: dict[str, Domain], optional: tuple[str, ...], const: tuple[str, ...]) -> tuple[DataFrame, tuple[Field, ...], tuple[Field, ...]]:
    values = [c for c in df.columns if c not in index] if values is None else values
    if bad := set(optional) & set(index):
        raise RuleError(f"index columns can't be optional: {sorted(bad)}")
    fields = []
    for n in (*index, *values):
        domain = domains.get(n) or of_type(df.schema[n].dataType)
        fields.append(Field(n, domain, n in optional, "index" if n in index else "const" if n in const else "var"))
    for f in fields[: len(index)]:
        if not f.domain.equatable:
            raise RuleError(f"{f.name} of {f.domain} can't be part of a key")
    df = df.select(*(F.col(f.name).cast(f.domain.spark).alias(f.name, metadata={"role": f.role, "optional": f.optional, "variants": list(f.domain.variants)}) for f in fields))
    return df, tuple(fields[: len(index)]), tuple(fields[len(index) :])


def store(df: DataFrame, index: list[str], values: list[str] | None = None, domains: dict[str, Domain] | None = None, optional: tuple[str, ...] = (), const: tuple[str, ...] = (), complete: bool = False, checked: bool = False, complete_over: tuple[str, ...] = (), block: tuple[str, str] | None = None) -> KeyedTable:
    """A table with one row per key.

    That is declared, not checked, as a check costs a pass and a shuffle of the keys; operators rely on it. With
    ``checked`` the data go through ``validate`` first. Declared as well: ``complete`` (a source that collects every
    row is complete by construction), ``complete_over`` (columns of the key whose every value is there for each rest of
    the key) and ``block``, a partition's name and the block that this table is: blocks of one partition are disjoint.
    """
    df, index_, values_ = _table(df, index, values, domains or {}, optional, const)
    if bad := set(complete_over) - set(index):
        raise RuleError(f"a table is complete over columns of its key; {sorted(bad)} aren't")
    lineage = frozenset((() if block is None else (tuple(block),),))
    made = KeyedTable(df, TableType(index_, values_, frozenset((frozenset(index),)), complete, lineage, frozenset(complete_over)))
    return validate(made) if checked else made


def bag_source(df: DataFrame, index: list[str], values: list[str] | None = None, domains: dict[str, Domain] | None = None, optional: tuple[str, ...] = (), unique: tuple[str, ...] = (), complete: bool = False) -> KeyedTable:
    """A table with any number of rows per key; ``unique`` names a candidate key. Beyond the algebra's stores."""
    df, index_, values_ = _table(df, index, values, domains or {}, optional, ())
    return KeyedTable(df, TableType(index_, values_, frozenset((frozenset(unique),)) if unique else frozenset(), complete))


def validate(t: KeyedTable) -> KeyedTable:
    """The table, if its data keep to its type: known columns hold no nulls, enums only variants, keys come once.

    One pass for columns; one shuffle of keys for each declared key.
    """
    tests = []
    for f in (*t.type.index, *t.type.values):
        if not f.optional:
            tests.append((f"{f.name} is missing", F.col(f.name).isNull()))
        if f.domain.variants:
            tests.append((f"{f.name} is no variant of {f.domain}", ~F.col(f.name).isin(*f.domain.variants)))
    if tests:
        found = t.df.agg(*(F.count_if(c).alias(str(i)) for i, (_, c) in enumerate(tests))).first()
        if wrong := [f"{what} in {n} rows" for (what, _), n in zip(tests, found) if n]:
            raise RuleError("; ".join(wrong))
    for key in t.type.keys:
        if not t.df.groupBy(*sorted(key)).count().filter("count > 1").isEmpty():
            raise RuleError(f"rows share the key {sorted(key)}")
    return t


def references(t: KeyedTable, column: str, other: KeyedTable) -> KeyedTable:
    """The table, if each known value of ``column`` is a key of ``other``."""
    if len(other.type.index) != 1 or t.type.field(column).domain.spark != other.type.index[0].domain.spark:
        raise RuleError("a reference goes to one index column of the same domain")
    (name,) = other.index
    if not t.df.filter(F.col(column).isNotNull()).join(other.df.select(F.col(name).alias("_key")), F.col(column) == F.col("_key"), "left_anti").isEmpty():
        raise RuleError(f"{column} holds values that are no key")
    return t


def outlives(t: KeyedTable, column: str, at: str, other: KeyedTable, since: str, until: str) -> KeyedTable:
    """The table, if each known value of ``column`` is a key of ``other`` with a row that holds at the time ``at``.

    A row of ``other`` holds from ``since`` up to, not including, ``until`` (missing: without end). A known value at a missing time is refused.
    """
    if len(other.type.index) != 1 or t.type.field(column).domain.spark != other.type.index[0].domain.spark:
        raise RuleError("a reference goes to one index column of the same domain")
    if len({t.type.field(at).domain, other.type.field(since).domain, other.type.field(until).domain}) > 1:
        raise RuleError(f"{at}, {since} and {until} are of different domains")
    ends = other.df.select(F.col(other.index[0]).alias("_key"), F.col(since).alias("_since"), F.col(until).alias("_until"))
    uses = t.df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_of"), F.col(at).alias("_at"))
    if not uses.join(ends, (F.col("_of") == F.col("_key")) & valid_at("_at", "_since", "_until"), "left_anti").isEmpty():
        raise RuleError(f"{column} holds values that are no key at {at}")
    return t


def conforms(t: KeyedTable, *fields: Field) -> KeyedTable:
    """The table, if it has these columns (a known column fits where a missing one would be allowed)."""
    for f in fields:
        own = t.type.field(f.name)
        if own.domain != f.domain or own.optional and not f.optional:
            raise RuleError(f"{f.name} is {own.domain}{' or missing' if own.optional else ''}, not {f.domain}")
    return t


def materialise(t: KeyedTable, name: str) -> bool:
    """Create the catalogue table ``name`` with the table's columns if it isn't there; whether it was made."""
    spark = t.df.sparkSession
    if spark.catalog.tableExists(name):
        return False
    columns = ", ".join(f"`{f.name}` {f.domain.spark}{'' if f.optional else ' NOT NULL'}" for f in (*t.type.index, *t.type.values))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return True


def refresh(t: KeyedTable, name: str) -> KeyedTable:
    """The view ``t`` as the rows of the catalogue table ``name`` (made if it isn't there), and that table."""
    materialise(t, name)
    t.df.select(*t.type.names).write.mode("overwrite").insertInto(name)
    return KeyedTable(t.df.sparkSession.table(name), t.type)


def insert(t: KeyedTable, rows: DataFrame) -> KeyedTable:
    """The table with further rows, which must keep to its type and, where keys come once, have new ones."""
    own = t.df.select(*t.type.names)
    more = rows.select(*(F.col(f.name).cast(f.domain.spark).alias(f.name) for f in (*t.type.index, *t.type.values)))
    validate(KeyedTable(more, t.type))
    for key in t.type.keys:
        if not more.join(own, sorted(key), "left_semi").isEmpty():
            raise RuleError(f"rows share the key {sorted(key)}")
    return KeyedTable(own.unionByName(more), replace(t.type, complete=False, complete_over=frozenset()))


def update(t: KeyedTable, where: Callable, **made: Callable) -> KeyedTable:
    """The table with columns set anew in the rows for which ``where(key, row)`` holds; each is a function of key and row."""
    return t.map(lambda k, r: {**r._exprs, **{n: choose(where(k, r), lift(f(k, r)), r[n]) for n, f in made.items()}})


#: Copies of a row that are made at a time.
COPIES = 1 << 16


def apply_deltas(t: KeyedTable, deltas: DataFrame, weight: str = "weight") -> KeyedTable:
    """The bag after weighted changes: rows whose weights (1 each in the table) sum to n come n times, however large n is."""
    names = t.type.names
    both = t.df.withColumn(weight, F.lit(1).cast("bigint")).unionByName(deltas.select(*names, F.col(weight).cast("bigint").alias(weight)))
    n = both.groupBy(*names).agg(F.sum(weight).alias("_n")).filter("_n > 0")
    # In two steps, so that no array has all copies.
    chunks = n.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(COPIES).cast("bigint"))))
    df = chunks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(COPIES), F.col("_n") - F.col("_from"))))).select(*names)
    return KeyedTable(df, replace(t.type, keys=frozenset()))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
