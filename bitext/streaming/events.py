"""Token streams, running progress, sessions with a time limit, incremental work.

Functions of the first two kinds take a batch or a streaming DataFrame alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitext import versions
from bitext.operators.terms import learn_from_edits
from bitext.operators.workspace import pending_after
from bitext.plans.edits import term_candidates
from bitext.plans.inference import Translate, translate_blocks
from bitext.storage import listing

PHASES = ("planning", "executing", "reviewing", "completed", "failed")
SESSION_MINUTES, RESPONSE_MINUTES = 30, 10


def _data(line: Column) -> Column:
    """What a data line holds, null for other lines."""
    return F.when(line.startswith("data: "), F.trim(F.substring(line, 7, 1 << 30)))


def _delta(body: Column) -> Column:
    return F.when(body != "[DONE]", F.get_json_object(body, "$.choices[0].delta.content"))


def assemble_token_stream(lines: DataFrame) -> DataFrame:
    """response_id, text from server-sent lines (response_id, line_no, line), in line order.

    Lines that are no data, the end mark, malformed ones and those without content add nothing.
    """
    delta = _delta(_data(F.col("line")))
    parts = F.array_sort(F.collect_list(F.when(delta.isNotNull(), F.struct("line_no", delta.alias("delta")))))
    return lines.groupBy("response_id").agg(F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("text"))


#: Responses share a state row by a hash of their ids: a call of Python, and of the state store, is then one for many of them.
BUCKETS = 4096
#: What is kept of each response of a bucket: text of its lines before ``following``, lines after a gap as they came, its first end mark (or -1), whether it has gone out.
RESPONSES = "ids array<{0}>, created array<bigint>, texts array<string>, following array<bigint>, places array<array<bigint>>, deltas array<array<string>>, last array<bigint>, sent array<boolean>"


def response_function(minutes: int) -> Callable:
    """The function of ``assemble_responses``, over the rows and the state of a bucket."""

    def collect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # By response: created (ms), text, following, lines by number, last, sent.
        kept = {i: [c, t, f, dict(zip(p, d, strict=True)), *rest] for i, c, t, f, p, d, *rest in zip(*state.get, strict=True)} if state.exists else {}
        new, touched, out = {}, set(), []
        for frame in [] if state.hasTimedOut else frames:
            ids = frame["response_id"].tolist() if key[0] >= 0 else [None] * len(frame)
            for i, n, delta, done, ms in zip(ids, *(frame[c].tolist() for c in ("line_no", "delta", "done", "ms")), strict=True):
                if i not in kept:
                    kept[i], new[i] = [ms, "", 0, {}, -1, False], True
                one = kept[i]
                if i in new and ms < one[0]:
                    one[0] = ms
                if one[5] or n < one[2]:  # of a response that has gone out, or repeated
                    continue
                one[3][n] = delta
                if done and (one[4] < 0 or n < one[4]):
                    one[4] = n
                touched.add(i)
        for i in touched:
            _, text, following, lines, last, _ = one = kept[i]
            more = []
            while following in lines and (last < 0 or following <= last):
                more.append(lines.pop(following))
                following += 1
            one[1:3] = text + "".join(more), following
            if 0 <= last < following:
                out.append((i, one[1], True))
                one[1], one[3], one[5] = "", {}, True
        now, limit = state.getCurrentWatermarkMs(), minutes * 60_000
        for i in [i for i, one in kept.items() if one[0] + limit < now]:
            _, text, _, lines, last, sent = kept.pop(i)
            if not sent:
                out.append((i, text + "".join(lines[n] for n in sorted(lines) if last < 0 or n <= last), False))
        if kept:
            rows = [(i, c, t, f, list(lines), list(lines.values()), *rest) for i, (c, t, f, lines, *rest) in kept.items()]
            state.update(tuple(map(list, zip(*rows, strict=True))))
            # A time limit has to lie after the watermark.
            state.setTimeoutTimestamp(max(min(one[0] for one in kept.values()) + limit, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["response_id", "text", "complete"])

    return collect


def assemble_responses(lines: DataFrame, minutes: int = RESPONSE_MINUTES, lateness: str = "10 minutes") -> DataFrame:
    """response_id, text, complete from a stream of server-sent lines (response_id, line_no, line, ts) in any order.

    Lines of a response are numbered from 0 without gaps. Its text goes out, once, when every
    line up to its end mark has come, or, as incomplete, ``minutes`` of event time after its
    first lines; after that its state is gone. Until then a short row without text remembers
    that it went out. Lines of a response that come twice count once. A response's text so far
    is written again with each micro-batch that brings lines of it.
    """
    bucket = F.when(F.col("response_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("response_id"), F.lit(BUCKETS)))
    body = _data(F.col("line"))
    rows = lines.withWatermark("ts", lateness).select(
        "response_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce(_delta(body), F.lit("")).alias("delta"), F.coalesce(body == "[DONE]", F.lit(False)).alias("done"),
        F.unix_millis("ts").alias("ms"), "ts", bucket.alias("bucket"),
    )
    kind = lines.schema["response_id"].dataType.simpleString()
    return rows.groupBy("bucket").applyInPandasWithState(
        response_function(minutes), f"response_id {kind}, text string, complete boolean", RESPONSES.format(kind), "append", GroupStateTimeout.EventTimeTimeout
    )


def progress(events: DataFrame) -> DataFrame:
    """doc_id, completed, events, phase (of the latest event; ties by event_id) from (event_id, doc_id, type, phase, ts)."""
    return events.groupBy("doc_id").agg(
        F.count_if(F.col("type") == "block_completed").alias("completed"), F.count(F.lit(1)).alias("events"),
        F.max_by("phase", F.struct("ts", "event_id")).alias("phase"),
    )


def session_processor() -> StatefulProcessor:
    """The processor, of a class that travels with the query: state drivers see no shipped files."""

    class Sessions(StatefulProcessor):
        """A session lives for 30 minutes from its creation, whatever happens in it."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("session", "created long, events long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            stamps = sorted(int(t.value // 1000) for frame in rows for t in frame["ts"])
            limit = SESSION_MINUTES * 60_000_000
            out = []
            created, n = self.state.get() if self.state.exists() else (None, 0)
            timer = created
            for t in stamps:
                if created is not None and t >= created + limit:
                    out.append((key[0], created, n))
                    created, n = None, 0
                if created is None:
                    created = t
                n += 1
            if created != timer:
                if timer is not None:
                    self.handle.deleteTimer((timer + limit) // 1000)
                self.handle.registerTimer((created + limit) // 1000)
            self.state.update((created, n))
            yield self._frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            out = []
            if self.state.exists():
                created, n = self.state.get()
                out.append((key[0], created, n))
                self.state.clear()
            yield self._frame(out)

        @staticmethod
        def _frame(rows: list[tuple]) -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=["doc_id", "created", "events"])
            return frame.astype({"doc_id": "int64", "created": "int64", "events": "int64"})

        def close(self) -> None:
            pass

    return Sessions()


def evict_stale_sessions(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """doc_id, created (microseconds), events of every session that has ended, from a stream of (doc_id, ts).

    The watermark bounds the state; later rows are dropped. The query needs the RocksDB state
    store, which ``runs.run_available`` gives it.
    """
    rows = events.select("doc_id", "ts").withWatermark("ts", lateness)
    return rows.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=session_processor(), outputStructType="doc_id long, created long, events long", outputMode="Append", timeMode="EventTime"
    )


def incremental_translate(blocks: DataFrame, fn: Translate, results: str, checkpoint: str, journal: str | None = None):
    """Start a query that translates blocks (doc_id, block_id, text) without a stored result and appends theirs.

    A repeated micro-batch finds its results stored, so none is kept twice. With a ``journal``
    every reply is stored at once, and a micro-batch that was cut short asks only for the rest.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(["doc_id", "block_id"])
        # Of the stored results only the two key columns are read.
        todo = pending_after(fresh, batch.sparkSession.read.parquet(results)) if listing(results) else fresh
        translate_blocks(todo, fn, journal=journal).write.mode("append").parquet(results)

    return blocks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn_stream(edits: DataFrame, termbase: str, checkpoint: str):
    """Start a query that learns from edits; each micro-batch commits a version of the table ``termbase``.

    A repeated micro-batch finds its own commit (see ``bitext.versions``) and does nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        tag = f"{checkpoint}:{batch_id}"
        now = versions.last(termbase)
        if now is None:
            raise ValueError("commit a first version of the termbase before learning")
        if now["tag"] != tag:
            learnt = learn_from_edits(term_candidates(batch), versions.latest(batch.sparkSession, termbase))
            versions.commit(learnt.drop("change", "rows_in"), termbase, tag)

    return edits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
