"""Scalar domains of keyed tables and what each allows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pyspark.sql.types as T


class RuleError(ValueError):
    """A pipeline breaks a rule of keyed tables; raised before any job runs."""


@dataclass(frozen=True)
class Domain:
    name: str
    spark: str
    equatable: bool = True
    orderable: bool = True
    numeric: bool = False
    variants: tuple[str, ...] = ()

    def __str__(self) -> str:
        return self.name


STRING = Domain("string", "string", orderable=False)
INT = Domain("int", "bigint", numeric=True)
REAL = Domain("real", "double", equatable=False, numeric=True)
BOOL = Domain("bool", "boolean", orderable=False)
DATE = Domain("date", "date")
#: Beyond the original six: events need a time of day.
TIMESTAMP = Domain("timestamp", "timestamp_ntz")


def enum(*variants: str) -> Domain:
    """A closed set of strings; needed for pivots."""
    if not variants or len(set(variants)) < len(variants):
        raise RuleError("an enum needs variants, each once")
    return Domain(f"enum{{{','.join(variants)}}}", "string", orderable=False, variants=tuple(variants))


def of_value(value) -> Domain:
    """The domain of a literal."""
    for kind, domain in ((bool, BOOL), (int, INT), (float, REAL), (str, STRING), (dt.datetime, TIMESTAMP), (dt.date, DATE)):
        if isinstance(value, kind):
            return domain
    raise RuleError(f"no domain for the literal {value!r}")


def of_type(kind: T.DataType) -> Domain:
    """The domain of a Spark column; whole numbers widen to int, fractions to real."""
    if isinstance(kind, T.IntegralType):
        return INT
    if isinstance(kind, (T.FractionalType,)):
        return REAL
    for spark, domain in ((T.StringType, STRING), (T.BooleanType, BOOL), (T.DateType, DATE), (T.TimestampType, TIMESTAMP), (T.TimestampNTZType, TIMESTAMP)):
        if isinstance(kind, spark):
            return domain
    raise RuleError(f"no domain for the type {kind.simpleString()}")
