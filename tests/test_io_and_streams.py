"""Files, guarded writes and streams over several micro-batches."""

import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cueweave.operators import events, render
from cueweave.plans import bindings, queries
from cueweave.session import shared_dir
from cueweave.sources import manifest, readers, result_table, writers
from cueweave.streaming import batches, ordered, progress, runner, status


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_requests_from_files(spark, tmp_path):
    lines = [{"request_id": 1, "url": "u"}, {"request_id": 2, "url": "u", "lang": " FR ", "format": "JSON", "initial_prompt": "  ", "vad": False, "model": "tiny"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    got = readers.read_requests(spark, str(tmp_path / "r.json"), "json")
    assert rows(got.fillna("-"), "request_id", "model", "vad", "lang", "word_timestamps", "initial_prompt", "use_cache", "max_duration_min", "max_line_width") == [
        (1, "auto", True, "-", False, "-", True, 720, 42), (2, "tiny", False, "fr", True, "-", True, 720, 42)]


def test_probes(spark, tmp_path):
    docs = ['{"id": "a", "duration": 61.5, "subtitles": {"fr": [{"ext": "vtt", "url": "u"}]}, "formats": [1]}', "{}", "nonsense", '{"id": "b"}']
    (tmp_path / "p.jsonl").write_text("\n".join(docs))
    got = readers.read_probe_json(spark, str(tmp_path / "p.jsonl"))
    assert sorted(r["video_id"] or "" for r in got.collect()) == ["", "", "a", "b"]
    assert got.where("error_code = 20").count() == 2
    assert got.where("video_id = 'a'").first()["subtitles"]["fr"][0]["url"] == "u"


def test_caption_and_checksum_files(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.0 --> 00:02.0\nx\n")
    (tmp_path / "SUMS").write_text(f"{'f' * 64}  tool\n")
    assert readers.read_caption_files(spark, str(tmp_path / "a.vtt")).first()["text"].startswith("WEBVTT\n\n00:01.0")
    assert rows(readers.read_checksums(spark, str(tmp_path / "SUMS")), "name", "sum") == [("tool", "f" * 64)]
    assert rows(readers.read_files(spark, str(tmp_path / "SUMS")), "name", "size") == [("SUMS", 71)]


def test_pcm_files(spark, tmp_path):
    for i, b in enumerate([b"\x01", b"\x00\xff", b"\x7f"]):
        (tmp_path / f"m-{i}.pcm").write_bytes(b)
    from cueweave.operators.audio import pcm_decode

    got = pcm_decode(readers.read_pcm_chunks(spark, str(tmp_path)))
    assert [x * 32768 for r in got.orderBy("chunk_no").collect() for x in r["samples"]] == [1.0, 32767.0]


def test_only_known_versions_are_read(spark, tmp_path):
    entry = {"version": 1, "document": {"source": {"video_id": "a", "title": "t"}, "transcript": {"segments": [{"id": 0, "start": 0.5, "end": 1.25, "text": "x"}]}}}
    lines = [entry, {**entry, "version": 2}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    got = readers.read_envelopes(spark, str(tmp_path / "e.jsonl"))
    assert got.count() == 1
    segs = readers.segments_of(got, "document.transcript.segments", "document.source.video_id")
    assert rows(segs, "media_id", "segment_id", "start_ms", "end_ms", "text") == [("a", 0, 500, 1250, "x")]


def test_guarded_writes(spark, tmp_path):
    frame = spark.createDataFrame([(1, "txt", "a.txt", 0, "x")], "media_id BIGINT, format STRING, filename STRING, part BIGINT, content STRING")
    target = str(tmp_path / "out")
    writers.write_documents(frame, target)
    with pytest.raises(writers.OutputRefused):
        writers.write_documents(frame, target)
    writers.write_documents(frame.withColumn("content", F.lit("y")), target, overwrite=True)
    assert spark.read.parquet(target).first()["content"] == "y"
    with pytest.raises(writers.OutputRefused):
        writers.write_documents(frame, str(tmp_path / "absent" / "out"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(writers.OutputRefused):
        writers.write_documents(frame, str(tmp_path / "file"), overwrite=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["file", "out"]


ENTRIES = "digest STRING, entry_id BIGINT, written_at BIGINT, accessed BIGINT, bytes BIGINT"


def test_results_in_buckets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    first = spark.createDataFrame([(f"d{i}", i, 1, 10, 5) for i in range(20)], ENTRIES)
    assert result_table.upsert_results(first, path, buckets=4) == 1
    state = lambda: rows(result_table.read_results(spark, path), "digest", "entry_id", "accessed")
    before, folders = state(), manifest.read(spark, path)
    fresh = spark.createDataFrame([("d3", 99, 2, 12, 5)], ENTRIES)
    hits = spark.createDataFrame([("d3", 11), ("d7", 40), ("d7", 30), ("gone", 50), (None, 1)], "digest STRING, accessed BIGINT")

    def fails(*_):
        raise OSError("the driver dies between the files and the manifest")

    with monkeypatch.context() as m:
        m.setattr(manifest, "publish", fails)
        with pytest.raises(OSError):
            result_table.upsert_results(fresh, path, hits)
    assert state() == before and manifest.read(spark, path) == folders
    result_table.upsert_results(fresh, path, hits)
    want = [(d, 99 if d == "d3" else i, {"d3": 12, "d7": 40}.get(d, a)) for d, i, a in before]
    assert state() == sorted(want)
    changed = {b for b, f in manifest.read(spark, path).items() if folders.get(b) != f}
    assert len(changed) <= 3 and len(folders) == 5  # the buckets of d3, d7 and gone; two of four stay or more
    with pytest.raises(manifest.Conflict):
        manifest.publish(spark, path, {}, 1)
    result_table.evict_results(spark, path, 3 * 5)
    assert [d for d, *_ in state()] == ["d0", "d3", "d7"]
    with pytest.raises(ValueError):
        result_table.upsert_results(spark.createDataFrame([(None, 1, 1, 1, 1)], ENTRIES), path)


def test_published_documents_are_all_old_or_all_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    made = lambda text: spark.createDataFrame([(i, "txt", f"{i}.txt", 0, text) for i in range(5)],
                                              "media_id BIGINT, format STRING, filename STRING, part BIGINT, content STRING")
    assert writers.publish_documents(made("old"), path) == 1
    content = lambda: {r["content"] for r in writers.read_documents(spark, path).collect()}
    boom = F.udf(lambda t: 1 / 0, "string")
    with pytest.raises(Exception):
        writers.publish_documents(made("new").withColumn("content", boom("content")), path)  # the files
    assert content() == {"old"}
    with monkeypatch.context() as m:
        m.setattr(manifest, "publish", lambda *_: 1 / 0)  # the pointer
        with pytest.raises(ZeroDivisionError):
            writers.publish_documents(made("new"), path)
    assert content() == {"old"}
    writers.publish_documents(made("new"), path)
    assert content() == {"new"}


def test_a_failed_replacement_puts_the_old_result_back(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(1, "txt", "a.txt", 0, "old")], "media_id BIGINT, format STRING, filename STRING, part BIGINT, content STRING")
    target = str(tmp_path / "out")
    writers.write_documents(frame, target)
    real, calls = writers._rename, []

    def second_fails(fs, source, goal):
        calls.append(1)
        if len(calls) == 2:
            raise writers.OutputRefused("no")
        real(fs, source, goal)

    monkeypatch.setattr(writers, "_rename", second_fails)
    with pytest.raises(writers.OutputRefused):
        writers.write_documents(frame.withColumn("content", F.lit("new")), target, overwrite=True)
    assert spark.read.parquet(target).first()["content"] == "old"


def test_documents_are_rendered_once(spark, monkeypatch):
    """Refusing, counting and replacing read what is stored."""
    seen, real = spark.sparkContext.accumulator(0), render.render

    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(render, "render", lambda *a: real(*a).withColumn("content", F.udf(counted, "string")("content")))
    written = queries.QUERIES["write_documents"](spark, "/root/testdata/sf0.001").count()
    assert seen.value == written > 0


def in_steps(spark, tmp_path, frame, steps, interleaved=True):
    """The frame as a stream of `steps` files, one per micro-batch: rows dealt out in turn, or in seq order."""
    source = tmp_path / "source"
    deal = F.pmod("seq", F.lit(steps)) + 1 if interleaved else F.ntile(steps).over(Window.orderBy("seq"))
    cuts = frame.withColumn("_step", deal)
    for k in range(1, steps + 1):
        cuts.where(F.col("_step") == k).drop("_step").coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def events_frame(spark):
    rnd = random.Random(8)
    data, t = [], 0
    for i in range(400):
        t += rnd.choice([0, 5, 40, 150])
        data.append((rnd.randrange(3), i, t, rnd.choice(["progress", "segments", "download", "notice"]), rnd.choice("ab"), rnd.randrange(100)))
    return data, spark.createDataFrame(data, "task_id BIGINT, seq BIGINT, ts_ms BIGINT, type STRING, item STRING, percent INT")


def test_progress_over_micro_batches(spark, tmp_path):
    _, frame = events_frame(spark)
    source, delay = in_steps(spark, tmp_path, frame, 3), runner.table_delay(frame)
    got = runner.drain_closed(source, lambda s: progress.stream_progress(s, delay), "t-progress", frame)
    assert rows(got, "task_id", "seq", "percent") == rows(events.progress_highwater(frame), "task_id", "seq", "percent")


class OneState:
    """What `highwater` asks of the state of one task."""

    def __init__(self):
        self.get, self.due, self.watermark = None, None, 0

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def update(self, value):
        self.get, self.due = value, None

    def setTimeoutTimestamp(self, ms):  # noqa: N802
        assert ms > self.watermark
        self.due = ms


def test_progress_waits_in_one_small_value():
    rnd = random.Random(9)
    data = [(t, i, rnd.randrange(-1, 100)) for i, t in enumerate(rnd.choices(range(500), k=3000))]
    state, got = OneState(), []
    for cut in range(0, 3000, 500):
        part = pd.DataFrame(data[cut:cut + 500], columns=["ts_ms", "seq", "percent"])
        got += list(progress.highwater((7,), iter([part[:200], part[200:]]), state))
        assert not got and len(state.get[0]) <= 101 and state.due == min(state.get[0]) + ordered.SHIFT_MS
    for now in (200, 600):
        state.watermark = now + ordered.SHIFT_MS
        got += list(progress.highwater((7,), iter([]), state))
    high, want = -1, []
    for _, seq, percent in sorted(data):
        if percent > high:
            high = percent
            want.append((7, seq, percent))
    assert [tuple(r) for frame in got for r in frame.itertuples(index=False)] == want
    assert state.get == ([], [], [], high) and state.due is None


def test_a_source_without_rows(spark, tmp_path):
    _, frame = events_frame(spark)
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "none"))
    assert runner.drain_closed(empty, progress.stream_progress, "t-none").count() == 0
    assert runner.drain_closed_batches(empty, batches.closed_windows, "t-none", batches.coalesce_batch).count() == 0
    with pytest.raises(runner.SourceNotRead):
        runner.drain(empty, "t-unread", frame)


def test_exact_batches_over_micro_batches(spark, tmp_path):
    data, frame = events_frame(spark)
    source, delay = in_steps(spark, tmp_path, frame, 3), runner.table_delay(frame)
    opened = runner.drain_closed(source, lambda s: batches.stream_openings(s, delay=delay), "t-openings", frame)
    assert rows(batches.assign_batches(frame, opened), "task_id", "seq", "batch_ms") == sorted(reference_batches(data))


def test_windows_close_in_order_and_end_their_state(spark, tmp_path):
    """With files in order a short delay does; the last window comes with the closing only."""
    data, frame = events_frame(spark)
    source = in_steps(spark, tmp_path, frame, 4, interleaved=False)
    work = lambda s: batches.stream_openings(s, delay="1 second")
    early = runner.drain(work(source), "t-open")
    closed = runner.drain_closed(source, work, "t-closed", frame)
    want = {(task, t) for task, _, t in reference_batches(data)}
    assert set(map(tuple, closed.collect())) == want
    assert set(map(tuple, early.collect())) < want


def reference_batches(data):
    """(task, seq, start of the window) message by message."""
    out = []
    for task in range(3):
        start = None
        for _, seq, t, *_ in (d for d in data if d[0] == task):
            if start is None or t - start >= 100:
                start = t
            out.append((task, seq, start))
    return out


def test_coalescing_over_micro_batches(spark, tmp_path):
    _, frame = events_frame(spark)
    source, delay = in_steps(spark, tmp_path, frame, 3), runner.table_delay(frame)
    written = runner.drain_closed_batches(source, lambda s: batches.closed_windows(s, delay=delay), "t-coalesced", batches.coalesce_batch, frame)
    whole = batches.coalesce_batch(frame)
    assert rows(written, *whole.columns) == rows(whole, *whole.columns)


def test_closing_gives_the_last_windows(spark, tmp_path):
    _, frame = events_frame(spark)
    source, delay = in_steps(spark, tmp_path, frame, 3), runner.table_delay(frame)
    counted = lambda s: batches.windowed_counts(s.withColumn("ts", F.timestamp_millis("ts_ms")), watermark=delay)
    want = rows(frame.groupBy("task_id", (F.floor(F.col("ts_ms") / 100) * 100).alias("w")).agg(F.count("*").alias("n")), "task_id", "w", "n")
    closed = runner.drain_closed(source, counted, "t-flush", frame).withColumn("w", F.unix_millis("window_start"))
    assert rows(closed, "task_id", "w", "n") == want
    assert runner.drain(counted(source), "t-open").count() < len(want)


def test_every_watch_run_counts(spark, tmp_path):
    """A failure, then a success on one day in two micro-batches; and many runs in any order."""
    day = 86_400_000
    runs = [(1, 100 + day, 1, "failure"), (1, 200 + day, 2, "success"), (1, 300 + day, 3, "inconclusive")]
    rnd = random.Random(6)
    runs += [(rnd.choice([2, 3, None]), rnd.randrange(400) * day // 3, i, rnd.choice(["failure", "success", "inconclusive"])) for i in range(4, 200)]
    frame = spark.createDataFrame(runs, "target_id BIGINT, ts_ms BIGINT, seq BIGINT, state STRING")
    known = frame.where("target_id IS NOT NULL")
    source, delay = in_steps(spark, tmp_path, known, 3), runner.table_delay(known)
    got = runner.drain_closed(source, lambda s: status.stream_watch(s, delay), "t-watch", known)
    whole = status.watch_actions(known, day)
    assert rows(got, *whole.columns) == rows(whole, *whole.columns)
    assert [r[1:] for r in rows(whole.where("target_id = 1"), "target_id", "day", "action")] == [(1, "close"), (1, "open")]
    found = status.incidents(whole, day).where("target_id = 1").collect()
    assert [(r["opened"], r["failures"], r["closed"]) for r in found] == [(1, 1, 1)]


def test_a_table_of_several_files_is_read(spark, tmp_path):
    frame = spark.range(90).select((F.col("id") % 4).alias("task_id"), F.col("id").alias("seq"), (F.col("id") * 50).alias("ts_ms"))
    frame.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    frame.coalesce(1).write.parquet(str(tmp_path / "dir"))
    next((tmp_path / "dir").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for table in ("many", "one"):
        read = runner.drain(runner.table_stream(spark, str(tmp_path), table, maxBytesPerTrigger="1"), f"t-{table}", frame)
        assert rows(read, "seq") == [(i,) for i in range(90)]


def test_status_over_micro_batches(spark, tmp_path):
    _, frame = events_frame(spark)
    shaped = frame.select("task_id", "seq", "ts_ms", F.when(F.col("type") == "progress", F.col("percent")).alias("percent"),
                          F.when(F.col("type") == "segments", F.col("ts_ms") * 3).alias("end_ms"))
    written = runner.drain_batches(status.stream_status(in_steps(spark, tmp_path, shaped, 3)), "t-status", lambda b: b, "update")
    whole = events.task_status(shaped)
    assert rows(status.latest_status(written).select(*whole.columns).fillna(-1), *whole.columns) == rows(whole.fillna(-1), *whole.columns)


def test_watermark_drops_late_windows(spark, tmp_path):
    frame = spark.sql("SELECT CAST(1 AS BIGINT) AS task_id, id AS seq, timestamp_millis(1700000000000 + id * 60) AS ts FROM range(20)")
    counted = batches.windowed_counts(in_steps(spark, tmp_path, frame, 2))
    written = runner.drain_batches(counted, "t-windows", lambda b: b, "update")
    latest = written.groupBy("window_start").agg(F.max("n").alias("n"))
    assert latest.agg(F.sum("n")).first()[0] == 20


def test_large_tables_in_few_files_get_more_partitions(spark, tmp_path, monkeypatch):
    """A task's share does not grow with the table."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert bindings.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(bindings, "SPREAD_BYTES", 1 << 10)
    spread = bindings.table(spark, str(tmp_path), "documents")
    assert spread.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism and spread.count() == 400


class _Counted:
    """State of one key in a dictionary; counts the calls that would go to the state store."""

    def __init__(self):
        self.held, self.calls, self.timers = {}, 0, set()

    def getMapState(self, *_):
        return self

    def getValueState(self, name, _):
        return _CountedValue(self, name)

    def __getattr__(self, name):
        work = {
            "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k], "updateValue": lambda k, v: self.held.__setitem__(k, v),
            "removeKey": lambda k: self.held.pop(k), "keys": lambda: [k for k in self.held if isinstance(k, tuple)],
            "registerTimer": lambda ms: self.timers.add(ms), "deleteTimer": lambda ms: self.timers.discard(ms),
        }[name]

        def call(*a):
            self.calls += 1
            return work(*a)

        return call


class _CountedValue:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def exists(self):
        return self.handle.containsKey(self.name)

    def get(self):
        return self.handle.getValue(self.name)

    def update(self, value):
        self.handle.updateValue(self.name, value)

    def clear(self):
        self.handle.removeKey(self.name)


@pytest.mark.parametrize("kind", ["daily", "watch"])
def test_a_key_takes_few_state_calls(kind):
    start = 1_704_200_000_000
    frame = pd.DataFrame({"ts_ms": [start + 2 * 86_400_000, start, start + 1], "seq": [3, 1, 2], "state": ["success", "failure", "failure"]})
    processor, handle = (batches.Openings(86_400_000) if kind == "daily" else status.Watch()), _Counted()
    processor.init(handle)
    now = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms + ordered.SHIFT_MS)
    found = [*processor.handleInputRows((7,), iter([frame]), now(0)), *processor.handleExpiredTimer((7,), now(ordered.CLOSE_MS), None)]
    got = [r for f in found for r in f.itertuples(index=False, name=None)]
    days = [start // 86_400_000, start // 86_400_000 + 2]
    assert got == ([(7, start), (7, start + 2 * 86_400_000)] if kind == "daily" else [
        (7, start, 1, days[0], "open"), (7, start + 1, 2, days[0], "append"), (7, start + 2 * 86_400_000, 3, days[1], "close")])
    assert not handle.held
    assert handle.calls <= 8
