"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams of labelled texts per language in numpy within tasks, adds the counts up in
Spark and returns log-probabilities: one row per bucket, one column per language, so its size is
buckets x languages whatever the corpus. The texts it learns from are a sample of at most about
``sample`` labelled rows (chosen by a hash of doc_id and text); this bound is a parameter.
``predict`` broadcasts that matrix and scores batches of whole texts.

Text is lower-cased; everything but letters counts as one space. The score is the probability of the
predicted language, with the evidence of long texts tempered to that of ``EVIDENCE`` n-grams.

Defined results: "und" with score 0 for null text, text without a letter, and where nothing was
learned; ties go to the language that sorts first; null labels are not learned from; equal texts get
equal results; an empty table gives no rows. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .portions import give_back

UNDETERMINED, SIZES, EVIDENCE, PORTION = "und", (2, 3), 64, 1 << 18


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    weight: np.ndarray  # buckets x languages


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``texts``, the text of each, and whether each text has a letter."""
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered]) if texts else np.zeros(0, np.int64)
    codes = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0)
    # A run of characters that aren't letters is one space; texts stay apart by theirs.
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    some = np.bincount(owner, codes != 0, len(texts)) > 0
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    found, of = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        inside = owner[:m] == owner[n - 1 :]
        found.append((h % np.uint64(buckets)).astype(np.int64)[inside])
        of.append(owner[:m][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), some
    return np.concatenate(found), np.concatenate(of), some


def _portions(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PORTION:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def held_out(doc_id: str):
    """Whether a row is held out from learning: its doc_id's checksum leaves 2 when divided by 4; a null id is not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sampled(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """About ``sample`` of the ``n`` rows of ``rows`` (all if they aren't more), chosen by a hash of doc_id and text.

    The share is kept to 62 bits, so it never becomes nothing, however many rows there are.
    """
    if n <= sample:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)) < F.lit((sample << 62) // n))


def fit(labelled: DataFrame, sample: int = 40_000, buckets: int = 1 << 16, smooth: float = 0.5) -> Model:
    """A model from ``labelled`` (doc_id, text, lang)."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    labelled = sampled(labelled, labelled.count(), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            texts, langs = b["text"].to_pylist(), b["lang"].to_pylist()
            for part in _portions(texts):
                found, of, _ = grams(texts[part], buckets)
                named = np.array(langs[part], object)
                for lang in set(langs[part]):
                    sums[lang] = sums.get(lang, 0) + np.bincount(found[(named == lang)[of]], minlength=buckets)
                    docs[lang] = docs.get(lang, 0) + int((named == lang).sum())
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            size = len(at) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(np.append(at, -1)), pa.array(np.append(counts[at], docs[lang]))], names=["lang", "bucket", "n"])

    made = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(made["lang"].unique()))
    table = np.zeros((buckets, len(languages)))
    prior = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        of = made[made["lang"] == lang]
        at, n = of["bucket"].to_numpy(), of["n"].to_numpy()
        table[at[at >= 0], k], prior[k] = n[at >= 0], n[at < 0].sum()
    table += smooth
    with np.errstate(invalid="ignore", divide="ignore"):
        return Model(languages, np.log(prior / prior.sum()), np.log(table / table.sum(axis=0)).astype(np.float32))


def score(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    texts = [t or "" for t in texts]
    named, scores = [], []
    for part in _portions(texts):
        size = part.stop - part.start
        found, of, some = grams(texts[part], len(model.weight))
        total = np.stack([np.bincount(of, model.weight[found, k], size) for k in range(len(model.languages))], axis=1) if model.languages else np.zeros((size, 0))
        n = np.bincount(of, minlength=size)
        if not model.languages:
            some = np.zeros(size, bool)
        best = (total + model.prior).argmax(axis=1) if model.languages else np.zeros(size, int)
        scaled = total * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None] + model.prior
        chance = np.exp(scaled - scaled.max(axis=1, keepdims=True, initial=-np.inf))
        chance /= np.maximum(chance.sum(axis=1, keepdims=True), 1e-300)
        for i in range(size):
            named.append(model.languages[best[i]] if some[i] else UNDETERMINED)
            scores.append(float(chance[i, best[i]]) if some[i] else 0.0)
    return named, scores


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", value: str = "score") -> DataFrame:
    """``df`` with the columns ``lang`` and ``value`` for its column ``text``; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (lang, value)] + [T.StructField(lang, T.StringType()), T.StructField(value, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, scores = score(b[text].to_pylist(), shared.value)
            kept = [n for n in b.schema.names if n not in (lang, value)]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in kept), pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
        give_back()

    return df.mapInArrow(run, schema)
