"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast (some dozens of bytes each).
HEAVY = 200_000
#: Tables that ``saved`` wrote and ``discard`` hasn't deleted, the oldest first.
_MADE: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data directory, through Spark's own reader (any file system)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only in local mode (tests, a laptop), where
    driver and executors are one process, may that be unset; a folder under /tmp is used then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "/tmp/bagwright-shared").rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._saved_path = path
    _MADE.append(made)
    return made


def discard(*made: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once all that reads them has been written itself."""
    for df in made:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._saved_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _MADE[:] = [x for x in _MADE if x is not df]


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at the end, the tables that were saved inside, but for the one that was saved last.

    For a block that ends with ``saved``: what its result was made from isn't read any more then.
    """
    before = set(map(id, _MADE))
    yield
    discard(*[x for x in _MADE[:-1] if id(x) not in before])


@atexit.register
def _clear() -> None:
    """What an operator's lazy result reads can't go before that is used; it goes with the session."""
    with contextlib.suppress(Exception):  # the session has ended already
        discard(*_MADE[:])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed so that no column of ``df`` has one of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str):
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def met(rows: DataFrame, found: DataFrame, on: list[str], total: int, heavy: int = HEAVY) -> DataFrame:
    """Inner join of ``rows`` (``total`` in number) with ``found`` (saved; one row per key, n: about the rows of that key).

    Keys that hold more than one in ``heavy`` of all rows are at most ``heavy`` in number, so they can be
    broadcast at any size of the input; the others have no hot key among them and are shuffled.
    """
    if found.count() <= heavy:
        return rows.join(F.broadcast(found.drop("n")), on)
    limit = -(-total // heavy)
    hot, rest = found.filter(F.col("n") >= limit).drop("n"), found.filter(F.col("n") < limit).drop("n")
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)
