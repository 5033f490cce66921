"""Secret scans: fixed patterns plus a likelihood ratio of two character Markov models.

The patterns find assignments, access keys and long hex runs. The method adds spans: one
first-order Markov model of random strings and one of ordinary identifiers score every token
that no pattern touches. A token counts as random where its log-likelihood ratio, summed over
its transitions, is at least ``EVIDENCE`` and at least ``THRESHOLD`` a transition; there is no
least length. Ratios are integers, so that sums do not depend on how texts are cut.

Random strings are labelled by the patterns (their matches in a bounded sample of documents)
and completed with generated ones of several alphabets; ordinary identifiers are the shorter
of the other tokens of that sample, and its plain numbers.

Defined results: null is the empty text; texts without a span give 0, 0, 0 and the digest of
the empty string; texts are searched whole; repeated rows give a row each and equal texts
train once; an empty table gives no rows; further columns are kept by ``find_secrets``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

# The patterns of the contract and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Untouched tokens of these lengths are labelled ordinary, and plain numbers; others carry no label.
ORDINARY_CHARS = range(4, 12)
#: About so many documents are trained on, sampled by a hash of the text.
TRAIN_DOCS = 5000
GENERATED = 3000
SMOOTHING = 0.5
BACK_OFF = 5.0
#: Log-likelihood ratio of a random token in nats: in all, and per transition.
EVIDENCE = 30.0
THRESHOLD = 0.6
SCALE = 1 << 12
#: Characters that are scored at once; a token is never cut.
CHUNK = 1 << 20

SIZE = len(ALPHABET)
DIGITS = range(52, 62)
_CODE = np.full(129, SIZE, np.int32)  # SIZE is the code of all other characters
_CODE[[ord(c) for c in ALPHABET]] = np.arange(SIZE)
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, by start, then kind; code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def codes(text: str) -> np.ndarray:
    """Number in the alphabet of every character, or SIZE."""
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def tokens(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of alphabet characters."""
    edge = np.diff(np.concatenate([[0], (c < SIZE).astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def transitions(c: np.ndarray) -> np.ndarray:
    """Cell of the (SIZE + 1)-square matrix for every character and the next."""
    return c[:-1] * (SIZE + 1) + c[1:]


def generated(n: int = GENERATED) -> Iterator[str]:
    """Random strings of usual secret alphabets, the same in every run."""
    r = random.Random(11)
    for i in range(n):
        letters = (ALPHABET[:62], ALPHABET[:64], "0123456789abcdef", ALPHABET[:26] + ALPHABET[52:62])[i % 4]
        yield "".join(r.choices(letters, k=r.randint(20, 64)))


def labelled(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the transitions of a text's random and of its ordinary tokens."""
    spans = base_spans(text)
    c = codes(text)
    cells = transitions(c)
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS] + [(a, b) for k, a, b in spans if k != "assign"]
    rand = np.concatenate([np.zeros(0, np.int64), *(cells[a : b - 1] for a, b in values)])
    starts, ends = tokens(c)
    letters = np.concatenate([[0], np.cumsum(~np.isin(c, DIGITS))])
    own = (np.isin(ends - starts, ORDINARY_CHARS) | (letters[ends] == letters[starts])) & ~touched(starts, ends, spans)
    inside = np.zeros(len(c) + 1, np.int64)
    np.add.at(inside, starts[own], 1)
    np.add.at(inside, ends[own] - 1, -1)  # a token's last character starts no transition
    return rand, cells[np.cumsum(inside)[: len(cells)] > 0]


def touched(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Whether each interval overlaps one of the spans (sorted by start)."""
    first = np.array([a for _, a, _ in spans], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, _, b in spans], np.int64))
    before = first.searchsorted(ends) - 1  # the last span that starts before the interval ends
    return (before >= 0) & (np.append(reach, 0)[before] > starts)


def train(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Log-likelihood ratio (random to ordinary, times SCALE) of every transition, from a bounded sample."""
    rows = docs.select(F.col(text).cast("string").alias("text"))
    total = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < min(1.0, train_docs / max(1, total)) * 1_000_000)
    # A text of many rows is sampled with all of them: one of them is enough.
    sample = sample.dropDuplicates(["text"])
    square = (SIZE + 1) ** 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, square), np.int64)
        for batch in batches:
            for t in batch.column(0):
                for own, cells in zip(counts, labelled(t.as_py() or ""), strict=True):
                    own += np.bincount(cells, minlength=square)
        label, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[label, cell])], names=["label", "cell", "n"])

    found = sample.mapInArrow(count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, square))
    counts[found["label"].to_numpy(), found["cell"].to_numpy()] += found["n"].to_numpy()
    return ratios(counts.reshape(2, SIZE + 1, SIZE + 1)[:, :SIZE, :SIZE])


def ratios(counts: np.ndarray) -> np.ndarray:
    """The ratio of every cell, 0 beside the alphabet, from transition counts of both labels."""
    counts = counts.copy()
    for token in generated():
        c = codes(token)
        np.add.at(counts[0], (c[:-1], c[1:]), 1)
    # Seldom seen rows lean on how often a character comes at all.
    single = counts.sum(axis=1) + SMOOTHING
    single /= single.sum(axis=1, keepdims=True)
    p = np.log((counts + BACK_OFF * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + BACK_OFF))
    out = np.zeros((SIZE + 1, SIZE + 1), np.int64)
    out[:SIZE, :SIZE] = np.rint((p[0] - p[1]) * SCALE)
    return out.ravel()


def random_tokens(text: str, ratio: np.ndarray, evidence: float = EVIDENCE, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens that the ratio calls random."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at, size = 0, CHUNK
    while at < len(text):
        c = codes(text[at : at + size])
        if at + size < len(text):  # cut behind the last character that is in no token
            others = np.flatnonzero(c == SIZE)
            if not len(others):
                size *= 2
                continue
            c = c[: others[-1] + 1]
        starts, ends = tokens(c)
        sums = np.concatenate([[0], np.cumsum(ratio[transitions(c)])])
        score, steps = sums[ends - 1] - sums[starts], ends - starts - 1
        rand = (score >= evidence * SCALE) & (score >= threshold * SCALE * steps)
        out.append((starts[rand] + at, ends[rand] + at))
        at, size = at + len(c), CHUNK
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def scan(text: str | None, ratio: np.ndarray, evidence: float = EVIDENCE, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    spans = base_spans(text)
    starts, ends = random_tokens(text, ratio, evidence, threshold)
    if len(starts):
        free = ~touched(starts, ends, spans)
        spans += [(KINDS[3], a, b) for a, b in zip(starts[free].tolist(), ends[free].tolist(), strict=True)]
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans", train_docs: int = TRAIN_DOCS, evidence: float = EVIDENCE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus an array of (kind, start, end), under a name that is free; the model is 37 kB and goes along."""
    spans = shared.free_name(docs, spans)
    ratio = train(docs, text, train_docs)
    schema = T.StructType([T.StructField(spans, T.ArrayType(SPAN))])

    def make() -> Callable:
        return lambda texts: (([dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t, ratio, evidence, threshold)],) for t in texts)

    return shared.append_columns(docs, text, make, schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in square brackets; overlaps merge."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(shared.as_text_rows(docs, doc_id, text), **options)
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
