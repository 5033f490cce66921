"""What is kept across failures: replies, versions, and the state of streams."""

from __future__ import annotations

import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitext import journal, versions
from bitext.plans import inference, replies
from bitext.streaming import events, runs

ROWS = [(k, f"b{k}", f"text number {k % 37}") for k in range(120)]
LINES = "response_id string, line_no long, line string"
EDITS = "doc_id long, block_id string, source_text string, before_text string, after_text string"
TERMBASE = "id string, source string, target string, source_lang string, target_lang string, domain string, frequency long, confirmed boolean, created_at timestamp, updated_at timestamp"


def counting(folder, broken_at=None):
    """A model that leaves a file per text that it is asked for, and dies at one text."""

    def answer(texts):
        for t in texts:
            if t == broken_at:
                raise ValueError("401 killed")
            open(f"{folder}/{uuid.uuid4().hex}-{t.replace(' ', '_')}", "w").close()
        return [t.upper() for t in texts]

    return answer


def asked(folder):
    return [name.split("-", 1)[1] for name in os.listdir(folder)]


@pytest.mark.parametrize("batch", [1, 4])
def test_a_killed_run_asks_for_no_answered_block_again(spark, tmp_path, batch):
    (tmp_path / "calls").mkdir()
    rows, path = spark.createDataFrame(ROWS, "doc_id long, block_id string, text string").repartition(2), str(tmp_path / "journal")
    with pytest.raises(Exception, match="401"):
        inference.translate_blocks(rows, counting(tmp_path / "calls", "text number 20"), batch, journal=path)
    before = asked(tmp_path / "calls")
    stored = {r.digest for r in journal.answers(spark, path).collect()}
    assert 0 < len(stored) < 37
    done = inference.translate_blocks(rows, counting(tmp_path / "calls"), batch, journal=path)
    assert sorted((r.doc_id, r.translated) for r in done.collect()) == [(k, t.upper()) for k, _, t in ROWS]
    again = asked(tmp_path / "calls")
    # Only texts without a stored answer come again, once in each of the tasks that have them.
    assert len(again) - len(before) <= 4 * (37 - len(stored))
    third = inference.translate_blocks(rows, counting(tmp_path / "calls"), batch, journal=path)
    assert third.count() == 120 and len(asked(tmp_path / "calls")) == len(again)
    journal.compact(spark, path)
    assert journal.answers(spark, path).count() == 37
    assert inference.translate_blocks(rows, counting(tmp_path / "calls"), batch, journal=path).count() == 120
    assert len(asked(tmp_path / "calls")) == len(again)


def test_a_repeated_task_reads_its_own_entries(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame(ROWS, "doc_id long, block_id string, text string").coalesce(1)
    outs = [journal.ask(rows, "text", "reply", counting(tmp_path / "calls"), 5, str(tmp_path / "journal"), "k", run="r") for _ in range(2)]
    first = asked_by(outs[0], tmp_path)
    # Planned before anything was stored: what it knows comes from the files of its own partitions.
    assert asked_by(outs[1], tmp_path) == first
    other = journal.ask(rows, "text", "reply", counting(tmp_path / "calls"), 5, str(tmp_path / "journal"), "other key")
    assert asked_by(other, tmp_path) > first


def asked_by(out, tmp_path):
    """How many texts all calls had asked for after ``out`` was computed once."""
    assert len(out.collect()) == 120
    return len(asked(tmp_path / "calls"))


def test_a_micro_batch_that_was_cut_short_asks_only_for_the_rest(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    spark.createDataFrame(ROWS, "doc_id long, block_id string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = runs.stream_table(spark, str(tmp_path / "in"))
    run = lambda fn: runs.finish(events.incremental_translate(stream, fn, str(tmp_path / "out"), str(tmp_path / "state"), journal=str(tmp_path / "journal")))
    with pytest.raises(Exception, match="401"):
        run(counting(tmp_path / "calls", "text number 30"))
    kept = journal.answers(spark, str(tmp_path / "journal")).count()
    before = len(asked(tmp_path / "calls"))
    run(counting(tmp_path / "calls"))
    assert len(asked(tmp_path / "calls")) - before <= 4 * (37 - kept)
    assert sorted((r.doc_id, r.translated) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(k, t.upper()) for k, _, t in ROWS]


def test_taken_names_do_not_matter(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x", "y")], "doc_id long, text string, request_digest string, request_reply string")
    got = journal.ask(rows, "text", "reply", lambda t: [x + "!" for x in t], 2, str(tmp_path / "j"), "k").first()
    assert tuple(got) == (1, "a", "x", "y", "a!")


def test_failed_documents_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, prompt string")

    def broken(texts):
        if texts[0] == "b":
            raise ValueError("no")
        return ["first"]

    first = inference.ask_documents(rows, broken, journal=str(tmp_path / "j"))
    assert sorted((r.doc_id, r.reply) for r in first.collect()) == [(1, "first"), (2, None), (3, "first")]
    second = inference.ask_documents(rows, lambda texts: ["second"], journal=str(tmp_path / "j"))
    assert sorted((r.doc_id, r.reply) for r in second.collect()) == [(1, "first"), (2, "second"), (3, "first")]


def test_versions_are_whole_and_in_order(spark, tmp_path):
    base = str(tmp_path / "t")
    assert versions.latest(spark, base) is None and versions.last(base) is None
    assert [versions.commit(spark.range(n), base, f"tag{n}") for n in (3, 4, 4)] == [0, 1, 1]
    assert versions.latest(spark, base).count() == 4
    (tmp_path / "t" / "data-torn").mkdir()  # rows of a writer that died before its commit
    (tmp_path / "t" / "_log" / ".torn").write_text("{")
    assert versions.latest(spark, base).count() == 4 and versions.last(base)["number"] == 1


@pytest.mark.parametrize("files", [0, 3])
def test_learning_keeps_every_micro_batch(spark, tmp_path, files):
    base = str(tmp_path / "terms")
    versions.commit(spark.createDataFrame([], TERMBASE), base, "start")
    (tmp_path / "in").mkdir()
    for k in range(files):
        edits = [(k, "b", f"bank{k} of the river", f"bank{k} is old", f"ufer{k} is old"), (k, "c", "shared word here", "shared word", "shared wort")]
        spark.createDataFrame(edits, EDITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        runs.finish(events.learn_stream(stream, base, str(tmp_path / "state")))
    got = {(r.target, r.frequency) for r in versions.latest(spark, base).collect()}
    assert got == ({("ufer0", 1), ("ufer1", 1), ("ufer2", 1), ("wort", 3)} if files else set())
    assert versions.last(base)["number"] == files


def sse(words, end=True):
    lines = [f'data: {{"choices":[{{"delta":{{"content":"{w} "}}}}]}}' for w in words]
    return [*lines[:2], ": ping", "data: {broken", *lines[2:], *(["data: [DONE]", 'data: {"choices":[{"delta":{"content":"after"}}]}'] if end else [])]


def at_hour(spark, rows, hour):
    return spark.createDataFrame(rows, LINES).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + hour * 3600))).coalesce(1)


def test_responses_equal_the_batch_form_over_shuffled_micro_batches(spark, tmp_path):
    r, path = random.Random(3), str(tmp_path / "in")
    rows = []
    for k in range(40):
        for n, line in enumerate(sse([f"w{k}x{j}" for j in range(r.randint(0, 9))], end=k % 5 != 4)):
            rows += [(f"r{k}", n, line)] * (1 + (r.random() < 0.1))  # some lines come twice
    r.shuffle(rows)
    for at in range(0, len(rows), 150):
        at_hour(spark, rows[at : at + 150], 0).write.mode("append").parquet(path)
    # The watermark then passes the limit of what lacks its end.
    for hour in (2, 4):
        at_hour(spark, [("late", 0, "data: [DONE]")], hour).write.mode("append").parquet(path)
    stream = spark.readStream.schema(f"{LINES}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = {x.response_id: (x.text, x.complete) for x in runs.run_available(events.assemble_responses(stream), "append", "responses").collect()}
    before_end = spark.createDataFrame(rows, LINES).dropDuplicates().where("line NOT LIKE '%after%'")
    want = {x.response_id: x.text for x in events.assemble_token_stream(before_end).collect()}
    for k in range(40):
        assert got[f"r{k}"] == (want[f"r{k}"], k % 5 != 4), k
    assert got["late"] == ("", True) and len(got) == 41


def test_state_of_ended_responses_is_gone(spark, tmp_path):
    path = str(tmp_path / "in")
    for step in range(4):
        rows = [(f"r{step}-{k}", n, line) for k in range(20) for n, line in enumerate(sse(["a", "b"], end=k % 2 == 0))]
        at_hour(spark, rows, 2 * step).write.mode("append").parquet(path)
    stream = spark.readStream.schema(f"{LINES}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    with runs.settings(spark, runs.ROCKSDB):
        query = events.assemble_responses(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query = query.trigger(availableNow=True).foreachBatch(lambda df, _: df.count()).start()
        runs.finish(query)
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    # The last step leaves as much as the first did: ended ones leave nothing.
    assert kept and kept[-1] <= max(kept) <= 2 * max(kept[0], 1)


def test_batches_are_halved_until_all_align(spark):
    rows = [(1, b, p, f"t{b}-{p}") for b in range(3) for p in range([1, 13, 20][b])]
    batches = spark.createDataFrame(rows, "doc_id long, batch int, pos int, text string")
    calls = []

    def ask(df):
        calls.append(df.count())
        texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.upper(x["text"]))
        few = F.when(F.col("n") > 3, F.slice("texts", 1, 1)).otherwise(F.col("texts"))
        return df.groupBy("doc_id", "batch").agg(texts.alias("texts"), F.count(F.lit(1)).alias("n")).select("doc_id", "batch", few.alias("texts"))

    got = replies.align_until(batches, ask)
    assert sorted((r.batch, r.pos, r.translated) for r in got.collect()) == sorted((b, p, t.upper()) for _, b, p, t in rows)
    assert calls == sorted(calls, reverse=True) and len(calls) == 4
    assert {r.rounds for r in got.where("batch = 0").collect()} == {1} and {r.rounds for r in got.where("batch = 2").collect()} == {4}


class State:
    """A state row of the test's own."""

    hasTimedOut, value = False, None
    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        self.limit = ms


def test_responses_of_a_bucket_share_a_call_and_a_state_row():
    state, collect = State(), events.response_function(10)

    def send(*rows):
        frame = pd.DataFrame(rows, columns=["response_id", "line_no", "delta", "done", "ms"])
        return [tuple(r) for out in collect((7,), iter([frame]), state) for r in out.itertuples(index=False)]

    assert send(("a", 1, "y", False, 5), ("b", 0, "z", False, 3), ("a", 4, "", True, 4)) == []
    assert state.limit == 3 + 600_000
    # An earlier end mark counts, though it comes later; what has gone out does not come again.
    assert send(("a", 0, "x", False, 9), ("a", 2, "", True, 9)) == [("a", "xy", True)]
    assert send(("a", 3, "w", False, 9), ("b", 1, "", True, 9), ("b", 0, "z", False, 9)) == [("b", "z", True)]
    state.getCurrentWatermarkMs = lambda: 700_000
    state.hasTimedOut = True
    assert list(collect((7,), iter([]), state)) == [] and not state.exists
