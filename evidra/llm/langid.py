"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Training follows the regularised leader (FTRL-proximal, with L1 and L2 penalties) over a bounded sample of
labelled rows; document frequencies count all training rows. A temperature fitted on rows kept apart from
training calibrates the scores. A text's features are its n-gram frequencies, so scoring sums one row of the
weight table for each n-gram and no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, slices, small_batches, tidied

BITS = 15
ORDERS = (1, 2, 3)
#: Labelled rows of each language that training may take, and how many of them (1 in so many) calibrate.
ROWS_PER_LANGUAGE = 1500
#: Labelled rows of all languages together; of more than 16 languages each has less than ROWS_PER_LANGUAGE.
SAMPLE_ROWS = 24_000
CALIBRATION = 5
EPOCHS = 4
#: Share of each calibration label spread over all languages, so that rows without errors don't ask for certainty.
SMOOTHING = 0.02
SCALE = 64.0
UNKNOWN = "und"


def buckets(texts: list[str], bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """(bucket at each code point for n-grams of each order, where each text begins and the end).

    Texts are lower-cased and end in a NUL; an n-gram that holds a NUL goes to bucket 2**bits.
    """
    ready = [t.lower() for t in texts]
    points = np.frombuffer(("\0".join(ready) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    code = np.zeros(len(points), np.uint32)
    empty = np.zeros(len(points), bool)
    for n in range(1, max(ORDERS) + 1):
        tail = points[n - 1 :]
        code[: len(tail)] = code[: len(tail)] * np.uint32(0x01000193) + tail + np.uint32(0x9E37)
        empty[: len(tail)] |= tail == 0
        empty[len(tail) :] = True
        if n in ORDERS:
            h = code * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            b = (h >> np.uint32(32 - bits)).astype(np.int32)
            b[empty] = 1 << bits
            out.append(b)
    return out, np.cumsum([0] + [len(t) + 1 for t in ready])


def counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, n-grams in each) of one text."""
    own, _ = buckets([text], bits)
    found, n = np.unique(np.concatenate(own), return_counts=True)
    real = found < 1 << bits
    return found[real].astype(np.int32), n[real].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2**bits + 1, languages), IDF and scale included
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        own, at = buckets(texts, int(len(self.weights) - 1).bit_length() - 1)
        every = np.stack(own)
        z = np.zeros((len(texts), len(self.languages)))
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            n = np.bincount(every[:, a:b].ravel(), minlength=len(self.weights)).astype(np.float32)
            z[k] = n @ self.weights / max(1.0, float(n[:-1].sum()))
        return z

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, calibrated probability) of each text."""
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (size, classes) after `epochs` passes over rows of (features, values, class)."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x, y = rows[k]
            zi, ni = z[i], n[i]
            w = weight(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            squared = g * g
            z[i] = zi + g - (np.sqrt(ni + squared) - np.sqrt(ni)) / alpha * w
            n[i] = ni + squared
    return weight(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        m = s.max(axis=1)
        right = (1 - SMOOTHING) * s[np.arange(len(y)), y] + SMOOTHING * s.mean(axis=1)
        return float((m + np.log(np.exp(s - m[:, None]).sum(axis=1)) - right).mean())

    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, rows = (1 << bits) + 1, 0
        df = np.zeros(width, np.int64)
        for batch in batches:
            column = batch.column("text")
            for i, j in slices(column):
                for k in range(i, j, 64):
                    texts = column.slice(k, min(64, j - k)).to_pylist()
                    own, at = buckets([t or "" for t in texts], bits)
                    base = np.repeat(np.arange(len(texts)) * width, np.diff(at))
                    seen = np.zeros(len(texts) * width, bool)
                    for b in own:
                        seen[base + b] = True
                    df += seen.reshape(len(texts), width).sum(axis=0)
                    rows += len(texts)
        df[-1] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["bucket", "n"])

    return run


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t, bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("part"), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([b.tobytes() for _, b in rows], pa.binary())], names=["lang", "part", "buckets", "counts"])

    return run


def train(labelled: DataFrame, bits: int = BITS, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model from rows (key, text, lang), or None without any. key only picks the sample.

    Document frequencies count every row. The regression takes about rows_per_language rows of each
    language, SAMPLE_ROWS of all at most, picked by a hash of key and text over all of them. Of equally probable
    languages the first in order of its name counts.
    """
    labelled = labelled.filter("lang is not null and text is not null")
    frequency = labelled.select("text").mapInArrow(tidied(_frequencies(bits)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << bits) + 1)
    for bucket, n in frequency:
        df[bucket] = n
    if not df[-1]:
        return None
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    wanted = min(rows_per_language, SAMPLE_ROWS / max(1, languages := sizes.count()))
    if languages > SAMPLE_ROWS:
        raise ValueError(f"{languages} languages are more than the {SAMPLE_ROWS} rows to learn from")
    share = sizes.select("lang", (F.lit(float(wanted)) / F.col("n")).alias("share"))
    chance = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(share), "lang").withColumn("chance", chance).filter("chance < share").select("lang", "text", F.pmod(F.hash("key", "text"), F.lit(CALIBRATION)).alias("part"))
    rows = sample.mapInArrow(tidied(_features(bits)), "lang string, part int, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (bytes(r.buckets), r.lang))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    idf = (np.log((1 + df[-1]) / (1 + df)) + 1) * SCALE
    idf[-1] = 0
    fit: list = []
    held: list = []
    for r in rows:
        i, n = np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.float32).astype(float)
        if len(i):
            (held if r.part == 0 else fit).append((i, n / n.sum() * idf[i], languages.index(r.lang)))
    w = ftrl(fit or held, len(languages), len(idf))
    t = temperature(np.array([x @ w[i] for i, x, _ in held]).reshape(len(held), -1), np.array([y for *_, y in held], int)) if held else 1.0
    return Model(languages, (w * idf[:, None]).astype(np.float32), t)


def held_out(id_column: Column, of: int = 4, remainder: int = 2) -> Column:
    """crc32 of the id as text, modulo `of`, is `remainder`; a null id counts as the empty text."""
    return crc_bucket(F.coalesce(id_column.cast("string"), F.lit("")), of) == remainder


def _score(model):
    """Takes the columns __text and __letters, passes all others, and adds lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        limit = (1 << 20) // max(1, len(m.languages) // 8 if m else 1)
        for batch in batches:
            column = batch.column("__text")
            names = [n for n in batch.schema.names if n not in ("__text", "__letters")]
            for i, j in slices(column, limit):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                letters = batch.column("__letters").slice(i, j - i).to_pylist()
                if m is None:
                    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    best, p = m.predict(texts)
                    lang = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)]
                    score = np.where(letters, p, 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, j - i) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def _model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int, bits: int):
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return docs.sparkSession.sparkContext.broadcast(train(base.filter(~held_out(F.col("key"), folds, fold)), bits))


def _with_text(docs: DataFrame, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    return docs.withColumns({"__text": text, "__letters": F.coalesce(text.rlike(r"\p{L}"), F.lit(False))})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the model learns from the rows that aren't held out.

    A null text, or one without a letter, is `und` with score 0, and so is every row if no labelled text
    is left to learn from. Rows with a null label are scored and not learnt from. Equal texts get equal
    results. Other columns are ignored.
    """
    model = _model(docs, id_col, text_col, lang_col, folds, fold, bits)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(F.col(f"`{id_col}`"), folds, fold).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    rows = _with_text(own, "text").drop("text")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidied(_score(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns, whose language identify() names with a score of `least` or more."""
    model = _model(docs, id_col, text_col, lang_col, folds, fold, bits)
    own = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    order = [f"__c{k}" for k in range(len(docs.columns))]  # own names: columns of docs may be called as ours
    renamed = _with_text(docs.toDF(*order), order[docs.columns.index(text_col)])
    out = renamed.mapInArrow(tidied(_score(model)), T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(order, docs.schema.fields, strict=True)), *own.fields[-2:]]))
    return out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(n).alias(f.name) for n, f in zip(order, docs.schema.fields, strict=True)])
