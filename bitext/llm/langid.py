"""Language ID: multinomial naive Bayes over hashed character 1- to 3-grams.

Training counts hashed n-grams per language over a bounded sample of the labelled rows; the
smoothed log-probabilities form one integer matrix (bucket x language), which is broadcast
(4 bytes x buckets x languages). Scoring gathers matrix rows for all n-grams of a batch of
texts and sums them per text. Sums of integers do not depend on batches or partitions.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is
every text when no labelled row exists; equal scores go to the language that sorts first;
rows with a null id are not held out and not trained on; texts are read whole; repeated rows
give a row each; empty tables give no rows; further columns are kept by ``predict``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

BITS = 15
ORDERS = (1, 2, 3)
#: About so many documents per language are trained on; rarer languages give all they have.
TRAIN_DOCS = 3000
#: Different labels that a model may have; more are an error, not a smaller model.
MAX_LABELS = 2000
SMOOTHING = 0.1
SCALE = 1 << 12
#: n-grams that are scored at once with up to 8 labels; with more labels in proportion fewer.
CHUNK = 1 << 19
#: Labels whose counts a training task holds before it hands them on.
HELD_LABELS = 64
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    langs: list[str]
    matrix: np.ndarray  # (2**BITS + 1, langs) int32; the last row, of zeros, is for no n-gram


@cache
def _letters() -> np.ndarray:
    """Lower-case letter, or a space, for every code point."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(len(table)):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def codes(text: str) -> np.ndarray:
    """Letters in lower case, runs of anything else as one space, a space at either end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[raw]
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def buckets(c: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each place, per order; 0 codes are in no n-gram."""
    out = np.empty((len(ORDERS), len(c)), np.int32)
    wide = np.concatenate([c, np.zeros(max(ORDERS) - 1, c.dtype)]).astype(np.uint32)
    for k, n in enumerate(ORDERS):
        h = np.full(len(c), n, np.uint32)
        ok = np.ones(len(c), bool)
        for j in range(n):
            x = wide[j : j + len(c)]
            h = (h ^ x) * np.uint32(0x01000193) + (h >> np.uint32(15))
            ok &= x != 0
        h = (h * np.uint32(2654435769)) >> np.uint32(32 - BITS)
        out[k] = np.where(ok, h, 1 << BITS)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Model of the labelled rows outside the held-out fold.

    Rows are sampled by a hash of id and text with one rate per language, ``train_docs`` over the
    language's rows; the rates need a count without texts. Equal rows are all in the sample or
    none is; they become one with their number, so about ``train_docs`` texts are trained on.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} different labels: the column {lang} holds no languages")
    if not totals:
        return Model([], np.zeros(((1 << BITS) + 1, 0), np.int32))
    rates = F.create_map(*(F.lit(x) for lang_, n in totals.items() for x in (lang_, min(1.0, train_docs / n))))
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.element_at(rates, F.col("lang")) * 1_000_000)
    sample = sample.where("text IS NOT NULL").groupBy("text", "lang").agg(F.count(F.lit(1)).alias("n"))

    def summed(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, own in counts.items():
            at = np.flatnonzero(own[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])
        counts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name, n in zip(*batch.columns, strict=True):
                if len(counts) >= HELD_LABELS and name.as_py() not in counts:
                    yield from summed(counts)
                own = counts.setdefault(name.as_py(), np.zeros((1 << BITS) + 1, np.int64))
                c = codes(t.as_py())
                for at in range(0, len(c), CHUNK):  # the n-grams that start in the chunk
                    b = buckets(c[at : at + CHUNK + max(ORDERS) - 1])[:, :CHUNK]
                    own += n.as_py() * np.bincount(b.ravel(), minlength=len(own))
        yield from summed(counts)

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = sorted(totals)
    n = np.zeros((1 << BITS, len(langs)), np.int64)
    place = {name: k for k, name in enumerate(langs)}
    n[table["bucket"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    p = np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * len(n)))
    matrix = np.zeros((len(n) + 1, len(langs)), np.int32)
    matrix[:-1] = np.rint(p * SCALE)
    return Model(langs, matrix)


def score(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and posterior of each text; texts are scored together, as many places at once as CHUNK and the labels allow."""
    chunk = max(1 << 10, CHUNK * 8 // max(8, len(model.langs)))
    sums = np.zeros((len(texts), len(model.langs)), np.int64)
    lettered = np.zeros(len(texts), bool)
    parts: list[np.ndarray] = []
    owners: list[int] = []
    gap = np.zeros(max(ORDERS) - 1, np.uint32)

    def flush() -> None:
        if parts:
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
            b = buckets(np.concatenate(parts))
            for row in b:
                np.add.at(sums, owners, np.add.reduceat(model.matrix[row], starts, axis=0, dtype=np.int64))
            parts.clear()
            owners.clear()

    held = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        c = codes(t)
        lettered[i] = (c != 32).any()
        if not lettered[i] or not model.langs:
            continue
        for at in range(0, len(c), chunk):
            piece = c[at : at + chunk + len(gap)]
            if len(piece) > chunk:  # n-grams that start in the overlap belong to the next piece
                flush()
                b = buckets(piece)[:, :chunk]
                sums[i] += sum(model.matrix[row].sum(axis=0, dtype=np.int64) for row in b)
                continue
            parts += [piece, gap]
            owners += [i, i]
            held += len(piece)
        if held >= chunk:
            flush()
            held = 0
    flush()
    out = []
    for s, ok in zip(sums, lettered, strict=True):
        if not ok or not model.langs:
            out.append((UNKNOWN, 0.0))
            continue
        k = int(s.argmax())
        out.append((model.langs[k], float(1 / np.exp((s - s[k]) / SCALE).sum())))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", posterior: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and its posterior (names must be free)."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(posterior, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_model.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = []
            for at in range(0, len(column), 256):
                found += score(m, column.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=[*batch.schema.names, lang_pred, posterior],
            )

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the model comes from the other folds."""
    model = train(docs, doc_id, text, lang, train_docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, posterior at least ``min_score``."""
    model = train(docs, train_docs=train_docs)
    p, s = shared.free_name(docs, "lang_pred"), shared.free_name(docs, "score")
    return predict(docs, model, "text", p, s).where((F.col(p) != UNKNOWN) & (F.col(s) >= min_score)).drop(p, s)
