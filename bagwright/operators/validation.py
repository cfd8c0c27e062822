"""Pairs (train, test) beyond plain folds: whole groups, even strata, and tests that come later than what is learned from.

Each pair is known to be disjoint by the key that it is cut at, so ``evaluate`` takes it. All are lazy: each side
reads the table anew, so write out a table that is costly to make before it is cut.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.domains import RuleError
from ..functions.expressions import Columns, Expr, hashed, lift
from .table import _SPLITS, KeyedTable, folds

Pairs = list[tuple[KeyedTable, KeyedTable]]
#: Parts that a stratum is numbered in, so that a large one isn't in one task.
PARTS = 4096


def _keyed(t: KeyedTable, names: tuple[str, ...]) -> KeyedTable:
    moved = [n for n in names if n not in t.index]
    return t.extend_key(*moved) if moved else t


def grouped_folds(t: KeyedTable, n: int, *names: str, number: Callable[[Columns], Expr] | None = None) -> Pairs:
    """``n`` folds that keep rows of equal ``names`` (which join the key) together: by a hash, or by ``number``, of those alone."""
    if not names:
        raise RuleError("a group takes columns")
    t = _keyed(t, names)
    number = number or (lambda k: hashed(n, *(k[x] for x in names)))
    return folds(t, n, lambda k: number(Columns({x: k[x] for x in names})))


def temporal_folds(t: KeyedTable, by: str, *cuts) -> Pairs:
    """For each of the ascending ``cuts``: what comes before it, and what comes from it on up to the next one. ``by`` joins the key."""
    if not cuts or any(a >= b for a, b in itertools.pairwise(cuts)):
        raise RuleError("temporal folds take ascending cuts")
    if not t.type.field(by).domain.orderable:
        raise RuleError(f"{by} gives no order")
    t, out = _keyed(t, (by,)), []
    for cut, end in itertools.zip_longest(cuts, cuts[1:]):
        past, later = t.split(lambda k, cut=cut: k[by] < cut)
        out.append((past, later if end is None else later.split(lambda k, end=end: k[by] < end)[0]))
    return out


def stratified_folds(t: KeyedTable, n: int, *by: str, number: Callable[[Columns], Expr] | None = None, parts: int = PARTS) -> Pairs:
    """``n`` folds whose sizes differ by one row at most within each stratum (rows of equal ``by``; missing is a value of its own).

    Rows of a stratum are numbered by the remainder of a hash of the key (or of ``number`` of it) by ``parts``, then by
    the key. Only the counts of parts, ``parts`` for a stratum at most, come together by stratum. Needs one row per key.
    """
    if n < 2:
        raise RuleError("at least two folds")
    if not by or not t.type.singletons or not t.index:
        raise RuleError("stratified folds take columns of a table with one row per key")
    if any(not t.type.field(x).domain.equatable for x in by):
        raise RuleError(f"{by} give no strata")
    value = F.xxhash64(*t.index) if number is None else lift(number(t._scope(t.type.index)))._value("a fold").column
    rows = t.df.withColumn("_part", F.pmod(value, F.lit(parts)))
    strata = [F.col(x).alias(f"_by_{i}") for i, x in enumerate(by)]
    counts = rows.groupBy(*strata, F.col("_part").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(f"_by_{i}" for i in range(len(by)))).orderBy("_in")) - F.col("_n")
    counts = counts.withColumn("_before", before)
    here = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*t.index))
    same = F.col("_part") == F.col("_in")
    for i, x in enumerate(by):
        same &= F.col(x).eqNullSafe(F.col(f"_by_{i}"))
    dealt = rows.withColumn("_here", here).join(counts, same).withColumn("_fold", F.pmod(F.col("_before") + F.col("_here") - 1, F.lit(n)))
    out = []
    for i in range(n):
        split, pair = next(_SPLITS), []
        for side in (False, True):
            lineage = frozenset((*p, (split, side)) for p in t.type.lineage)
            pair.append(KeyedTable(dealt.filter((F.col("_fold") == i) == F.lit(side)), replace(t.type, lineage=lineage)))
        out.append((pair[0], pair[1]))
    return out
