"""Streams give what batches give."""

from pyspark.sql import functions as F

from wordloom.operators.frequency import token_counts
from wordloom.streaming import usage


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_incremental_histogram(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x y x"), (2, "b", "y")], "doc_id long, source string, text string")
    inbox = str(tmp_path / "in")
    docs.filter("doc_id = 1").write.parquet(inbox)
    run = lambda: usage.incremental_histogram(spark.readStream.schema(docs.schema).parquet(inbox), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    run()
    docs.filter("doc_id = 2").write.mode("append").parquet(inbox)
    run()
    expected = rows(token_counts(docs.select(F.col("source").alias("book"), "text"), ["book"]))
    assert rows(usage.read_histogram(spark, str(tmp_path / "out"))) == expected


def test_window_usage(spark, tmp_path):
    events = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"))
    events.write.parquet(str(tmp_path / "e"))
    stream = usage.window_usage(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("usage_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("usage_windows")) == rows(usage.window_usage(events))


def test_unique_jobs(spark):
    jobs = spark.createDataFrame([(1, "ocr", "t"), (1, "ocr", "t"), (2, "ocr", "t")], "book_id int, kind string, tag string")
    assert usage.unique_jobs(jobs).count() == 2


def test_changing_histogram(spark, tmp_path):
    """Edits, deletions, moves to another book, replays and events out of order come to what the last versions are."""
    schema = "doc_id long, version long, book string, text string"
    batches = [
        [(1, 1, "a", "x y x"), (2, 1, "a", "y"), (3, 5, "b", "late but last"), (None, 1, "a", "no document"), (9, None, "a", "no version")],
        [(1, 2, "a", "x z"), (2, 2, "b", "y y"), (3, 4, "b", "early"), (4, 1, None, "no book"), (1, 1, "a", "x y x")],
        [(2, 3, None, None), (4, 2, "c", None), (5, 1, "a", None), (5, 2, "a", "back"), (1, 2, "a", "x z")],
        [(6, 1, "d", "two"), (6, 1, "d", "three"), (3, 6, "b", "")],
    ]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    done = []
    for batch in batches:
        events = spark.createDataFrame(batch, schema)
        events.coalesce(1).write.mode("append").parquet(inbox)
        usage.changing_histogram(spark.readStream.schema(events.schema).parquet(inbox), out, str(tmp_path / "check")).awaitTermination(120)
        done += batch
        assert rows(usage.read_changes(spark, out)) == rows(usage.latest_counts(spark.createDataFrame(done, schema)))
    assert rows(usage.read_changes(spark, out)) == [("a", "back", 1), ("a", "x", 1), ("a", "z", 1), ("d", "two", 1)]
