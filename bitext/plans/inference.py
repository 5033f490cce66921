"""Batch inference with a pluggable function: batched calls, halving, retries, fallbacks.

Replies are written to the shared folder when a job has all of them, so a block is asked for
once, however often its reply is used, and all uses see the same one. With a ``journal``, a
folder, each call's replies are stored at once as well: a task or application that is killed
asks for no answered block again (see ``bitext.journal``).
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext import journal as journals
from bitext.operators import checks, workspace
from bitext.storage import materialize

Translate = Callable[[list[str]], list[str]]
FATAL = ("401", "403", "UNAUTHORIZED", "PERMISSION_DENIED", "API_KEY_INVALID", "API key")
RATE = ("429", "rate limit", "RESOURCE_EXHAUSTED", "quota")
TRIES, BASE_DELAY, GROWTH = 6, 1.5, 2.2


def replace_terms(text: str, terms: Sequence[tuple[str, str]]) -> str:
    """Fallback for one text: each term in turn, longest source first, in any case."""
    for source, target in sorted((t for t in terms if t[0] and t[1]), key=lambda t: -len(t[0])):
        text = re.sub(re.escape(source), lambda _, t=target: t, text, flags=re.I)
    return text


def stub_translate(texts: list[str], terms: Sequence[tuple[str, str]] = ()) -> list[str]:
    """Deterministic offline model: terms replaced."""
    return [replace_terms(t, terms) for t in texts]


def stub(terms: Sequence[tuple[str, str]]) -> Translate:
    return partial(stub_translate, terms=tuple(terms))


def scripted(answer: Callable[[str], str]) -> Translate:
    """An offline model from the answer to one prompt."""
    return partial(_answers, answer)


def _answers(answer: Callable[[str], str], texts: list[str]) -> list[str]:
    return [answer(t) for t in texts]


def call_with_retry(fn: Translate, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """One call; rate limits are waited out, growing, or as long as the error says."""
    for attempt in range(1, TRIES + 1):
        try:
            return fn(texts)
        except Exception as e:
            message = str(e)
            if attempt == TRIES or not any(x.lower() in message.lower() for x in RATE):
                raise
            said = re.search(r"retry in ([0-9.]+)\s*s", message, re.I)
            sleep(float(said[1]) if said else BASE_DELAY * GROWTH ** (attempt - 1))
    raise AssertionError


def translate_batch(texts: list[str], fn: Translate, terms: Sequence[tuple[str, str]] = (), sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """As many texts as came in, in order.

    A failed call or a reply of another size is halved; a single text that fails gets its terms
    replaced, one whose reply has another size stays. An empty item stays. Authorisation errors
    end the job.
    """
    try:
        out = call_with_retry(fn, texts, sleep)
        failed = False
    except Exception as e:
        if any(x in str(e) for x in FATAL):
            raise
        out, failed = [], True
    if len(out) == len(texts):
        return [o if o and o.strip() else t for o, t in zip(out, texts, strict=True)]
    if len(texts) == 1:
        return [replace_terms(texts[0], terms)] if failed else texts
    middle = len(texts) // 2
    return translate_batch(texts[:middle], fn, terms, sleep) + translate_batch(texts[middle:], fn, terms, sleep)


def translate_blocks(rows: DataFrame, fn: Translate, batch: int = 20, terms: Sequence[tuple[str, str]] = (), text: str = "text", out: str = "translated", journal: str | None = None, key: str = "") -> DataFrame:
    """``rows`` plus ``out``. Filter before: nothing is pushed below the calls.

    The number of partitions is the number of concurrent callers. ``key`` tells the requests of
    one model, language pair and purpose from others in the ``journal``.
    """
    return _asked(rows.drop(out), text, out, lambda texts: translate_batch(texts, fn, terms), batch, journal, f"translate:{key}")


def _asked(rows: DataFrame, text: str, out: str, call: journals.Call, size: int, journal: str | None, key: str) -> DataFrame:
    """``rows``, untouched, plus a column of what ``call`` makes of ``text``, up to ``size`` at once."""
    if journal is not None:
        return materialize(journals.ask(rows, text, out, call, size, journal, key), "replies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            texts = [t or "" for t in given.column(given.schema.get_field_index(text)).to_pylist()]
            replies = [x for at in range(0, len(texts), size) for x in call(texts[at : at + size])]
            yield pa.RecordBatch.from_arrays([*given.columns, pa.array(replies, pa.string())], names=[*given.schema.names, out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    return materialize(rows.mapInArrow(run, schema), "replies")


def polish_blocks(requests: DataFrame, bitext: DataFrame, fn: Translate, batch: int = 20, journal: str | None = None, key: str = "") -> DataFrame:
    """``bitext`` with polished translations; an empty reply leaves the current one."""

    def lenient(texts: list[str]) -> list[str]:
        return [x or " " for x in fn(texts)]

    new = translate_blocks(requests, lenient, batch, text="prompt", out="reply", journal=journal, key=f"polish:{key}").select("doc_id", "block_id", "prompt", "reply")
    rows = bitext.join(new, ["doc_id", "block_id"], "left")
    # A blank reply comes back as the prompt.
    empty = F.col("reply").isNull() | (F.col("reply") == F.col("prompt"))
    return rows.withColumn("translated", F.when(empty, F.col("translated")).otherwise(F.col("reply"))).drop("prompt", "reply")


def ask_documents(requests: DataFrame, fn: Translate, tries: int = 2, journal: str | None = None, key: str = "") -> DataFrame:
    """``requests`` plus ``reply``: one retry, then null. Parsers turn null into defaults."""

    def ask(prompt: str | None) -> str | None:
        for _ in range(tries):
            try:
                return fn([prompt or ""])[0]
            except Exception as e:
                if any(x in str(e) for x in FATAL):
                    raise
        return None

    return _asked(requests.drop("reply"), "prompt", "reply", lambda prompts: [ask(p) for p in prompts], 1, journal, f"ask:{key}")


def review_round(bitext: DataFrame, issues: DataFrame, glossary: DataFrame, fn: Translate, max_retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """One retry round: bitext and issues after translating the blocks with high issues again."""
    retry = workspace.retry_set(bitext, issues, max_retries)
    again = translate_blocks(retry.drop("translated"), fn, text="original")
    after = workspace.overlay_retry(bitext, again)
    recheck = checks.check_all(after.join(retry.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi"), glossary)
    return after, workspace.merge_issues(issues, retry, recheck)
