"""Quality rules: per-text counts, and lines that too many documents of one host share.

``measured`` counts words, symbols, repeated lines and repeated 8-word windows of each whole text.
``quality`` adds the cross-document rule: lines are normalised (white space, case) and hashed;
distinct documents are counted per host and line; lines in more than ``share`` of the host's
documents (and in more than ``least``) are removed; a document that loses more than ``depleted`` of
its words to that is rejected, as are those that fail the base rules.

Distinct (host, line, document) triples are spread by all three, and counts are summed before the
shuffle by line, so a line that all documents share is one row per task then. Rows with equal doc_id
are one document when documents are counted (as in line dedup), and have a verdict each; the rows
are told apart by a number that is written with them.

Defined results: null text has no words (base_failed); null host is a host of its own; a null doc_id
is a document of its own (all rows without one together); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SPACES, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", b"#*$%&|<>", 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], np.uint64)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows of so many words that come twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    at = np.zeros(n, np.uint64)
    for k in range(window):
        at += h[k : k + n] * _FACTORS[k % WINDOW]
    _, group, count = np.unique(at, return_inverse=True, return_counts=True)
    starts = (count[group] > 1).astype(np.int64)
    if not starts.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += starts
    edge[window : window + n] -= starts
    return int((edge.cumsum() > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """BASE of one text."""
    data = text.encode()
    words = data.split()  # bytes split at exactly the six ASCII characters of white space
    seen, again = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), len(data) - len(data.translate(None, SYMBOLS)), again, repeated(words)


def lines_of(text: str) -> list[dict]:
    """Distinct normalised lines with a word: hash, and the words in all their places."""
    found: dict[bytes, int] = {}
    for line in text.lower().encode().split(b"\n"):
        if words := line.split():
            key = b" ".join(words)
            found[key] = found.get(key, 0) + len(words)
    return [{"line": hashlib.blake2b(k, digest_size=16).digest(), "words": n} for k, n in found.items()]


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: doc_id, host, BASE, and ``lines`` (array of line, words)."""
    kinds = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b["text"].to_pylist()]
            base = list(zip(*map(measure, texts))) or [()] * len(BASE)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["host"], *(pa.array(x, pa.int64()) for x in base), pa.array(map(lines_of, texts), kinds)], names=["doc_id", "host", *BASE, "lines"])

    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, {', '.join(f'{c} long' for c in BASE)}, lines array<struct<line: binary, words: long>>")


def quality(docs: DataFrame, host: str = "source", share: float = 0.05, least: int = 20, depleted: float = 0.5) -> DataFrame:
    """doc_id, BASE, removed_words, base_failed and kept for each row of ``docs`` (doc_id, text, host)."""
    rows = saved(measured(docs, host).withColumn("row", F.monotonically_increasing_id()), "quality")
    lines = rows.select("row", "doc_id", "host", F.inline("lines"))
    documents = F.count_distinct(F.struct("doc_id"))  # a struct, so that null counts
    limits = rows.groupBy("host").agg(F.greatest(documents * F.lit(share), F.lit(float(least))).alias("most"))
    common = lines.groupBy("host", "line").agg(documents.alias("n")).filter(F.col("n") > least)
    common = common.join(limits, common["host"].eqNullSafe(limits["host"])).filter("n > most").select(common["host"].alias("at"), F.col("line").alias("shared"))
    gone = lines.join(common, lines["host"].eqNullSafe(F.col("at")) & (F.col("line") == F.col("shared"))).groupBy("row").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0))
    return (
        rows.drop("lines", "host")
        .join(gone, "row", "left")
        .select("doc_id", *BASE, removed.alias("removed_words"), failed.alias("base_failed"), (~failed & (removed <= depleted * F.col("n_words"))).alias("kept"))
    )
