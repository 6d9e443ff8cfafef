"""Streams give what the batch plans give."""

import datetime as dt

from quillmark.plans import packs, rules
from quillmark.streaming import pipelines


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_flags_stream_as_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "no!\nfine", "en"), (2, "two  blanks", "en")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    got = _run(pipelines.flag_stream(stream, [packs.EXCLAMATION, packs.SPACING]), "flagged")
    want = rules.flags(docs, [packs.EXCLAMATION, packs.SPACING]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_windows_and_state(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), f"k{m % 2}", m % 3) for m in (0, 5, 10, 70, 75, 300)]
    events = spark.createDataFrame(rows, "ts timestamp, kind string, id long")
    events.write.parquet(str(tmp_path / "ev"))
    read = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    got = _run(pipelines.tumbling(read(), "1 hour", "kind"), "tumbled")
    assert sum(r["n"] for r in got) == 5  # the last window waits for the watermark
    assert sum(r["n"] for r in _run(pipelines.sessions(read(), "30 minutes", "kind"), "sessions")) == 5
    assert len(_run(pipelines.once(read(), "id"), "once")) >= 3
    assert sum(r["n"] for r in _run(pipelines.sliding(read(), "1 hour", "30 minutes", "kind"), "slid")) == 10


def test_latest_health(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "ok", t0), ("a", "error", t0 + dt.timedelta(seconds=5)), ("b", "ok", t0)]
    h = spark.createDataFrame(rows, "witness string, status string, ts timestamp")
    h.write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(h.schema).parquet(str(tmp_path / "h"))
    got = {r["witness"]: r["status"] for r in _run(pipelines.latest_health(stream), "health", "update")}
    assert got == {"a": "error", "b": "ok"}
