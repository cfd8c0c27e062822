"""Line dedup: lines that many sites share are boilerplate and stay in one document alone.

1. The lines of each document are normalised (white space, case) and hashed to 128 bits, once; the
   hashes are written, and all that follows reads them instead of texts.
2. Per line a HyperLogLog sketch of its sites is built; partial sketches merge by aggregation, so a
   line that all documents hold travels as one sketch per task.
3. Lines whose estimate is clearly above or below ``sites`` are settled by it; those near the limit
   get an exact count of distinct sites.
4. Boilerplate is removed everywhere but in the document with the smallest doc_id, so no content
   disappears from the corpus. Texts move once, to meet the places of what they lose.

Rows of lines meet verdicts by ``met``, so that no line is a hot key, whatever its share.

Defined results: null or empty text stays as it is; lines without a word are never removed; a null
site is no site; rows with equal doc_id are one document (all keep or lose a line alike); a null
doc_id is larger than all others; an empty table gives no rows; all other columns are kept, whatever
their names, but n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, fresh, met, quoted, saved

#: Base-2 logarithm of a sketch's registers, and the standard errors that count as near the limit.
REGISTERS, MARGIN = 10, 4
_LINE = ["line", "more"]  # the two halves of a hash


def normal(line: Column) -> Column:
    """``line`` in lower case, runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(line, "[\\x09-\\x0D\\x20]+", " ")))


def hashed(docs: DataFrame, site: str = "source") -> DataFrame:
    """Saved: id, digest (of the text) and site of each row of ``docs``, and its lines with a word: place and hash."""
    # The seed of the second half is a hash of its own, so that the halves don't collide together.
    parts = F.transform(F.transform(F.split("text", "\n", -1), normal), lambda x, k: F.when(x != "", F.struct(k.alias("place"), F.xxhash64(x).alias("line"), F.xxhash64(F.lit(1), x).alias("more"))))
    rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), quoted(site).cast("string").alias("site"), F.filter(parts, lambda x: x.isNotNull()).alias("lines"))
    return saved(rows, "lines")


def _exploded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.inline("lines"))


def boilerplate(rows: DataFrame, sites: int = 10, heavy: int = HEAVY) -> tuple[DataFrame, int]:
    """Saved: line, more, keeper (id; null: none) and n of the lines of ``hashed`` rows that at least ``sites`` sites hold; rows of lines."""
    lines = _exploded(rows, "id", "site")
    sketched = lines.groupBy(*_LINE).agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"), F.min("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    error = MARGIN * 1.04 / (1 << REGISTERS) ** 0.5
    low, high = sites * (1 - error) - 1, sites * (1 + error) + 1
    about = sketched.select(*_LINE, "keeper", "n", F.hll_sketch_estimate("sketch").alias("about")).filter(F.col("about") > low)
    spread = saved(about, "spread")
    near = spread.filter(F.col("about") <= high).drop("about")
    total = rows.agg(F.sum(F.size("lines"))).first()[0] or 0
    exact = (
        met(lines.filter("site IS NOT NULL").select("site", *_LINE), near.select(*_LINE, "n"), _LINE, total, heavy)
        .distinct()
        .groupBy(*_LINE)
        .agg(F.count(F.lit(1)).alias("sites"))
        .filter(F.col("sites") >= sites)
        .join(near, _LINE)
    )
    columns = [*_LINE, "keeper", "n"]
    return saved(spread.filter(F.col("about") > high).select(*columns).unionByName(exact.select(*columns)), "boilerplate"), total


def dedup_lines(docs: DataFrame, sites: int = 10, site: str = "source", heavy: int = HEAVY) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and the columns n_lines and n_removed (long)."""
    rows = hashed(docs, site)
    common, total = boilerplate(rows, sites, heavy)
    # Rows of equal id and text lose the same places.
    lost = met(_exploded(rows, "id", "digest"), common, _LINE, total, heavy).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    docs = docs.drop("n_lines", "n_removed")
    columns, names = docs.columns, fresh(docs, "id", "digest", "places", "text_digest")
    lost = lost.groupBy("id", "digest").agg(F.collect_set("place").alias("places")).toDF(*names[:3])
    of, digest, places, own = map(quoted, names)
    joined = docs.withColumn(names[3], F.xxhash64("text")).join(lost, F.col("doc_id").eqNullSafe(of) & (own == digest), "left").select(*map(quoted, columns), places)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, size, removed = [], [], []
            for text, gone in zip(b["text"].to_pylist(), b[names[2]]):
                parts = () if text is None else text.split("\n")
                gone = set(gone.as_py() or ())
                texts.append("\n".join([x for k, x in enumerate(parts) if k not in gone]) if gone else text)
                size.append(len(parts))
                removed.append(len(gone))
            arrays = [pa.array(texts, b.schema.field("text").type) if n == "text" else b[n] for n in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(size, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)
