"""Streams: incremental histograms and usage by event time."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.functions import text as T
from wordloom.operators.frequency import token_counts


def window_usage(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n for each window of event time (ts); on a stream, events later than `late` are left out and
    a window is final once the watermark passes it."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return source.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def unique_jobs(jobs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first of jobs of equal (book_id, kind, tag) within the watermark."""
    keys = ["book_id", "kind", "tag"]
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if jobs.isStreaming else jobs.dropDuplicates(keys)


def incremental_histogram(docs: DataFrame, path: str, checkpoint: str, book: str = "source") -> StreamingQuery:
    """Writes token counts of each batch of new documents as a part of its own, batch=N, so that a batch that is run
    again replaces what it wrote. read_histogram adds the parts up."""

    def write(batch: DataFrame, number: int) -> None:
        counts = token_counts(batch.select(F.col(book).alias("book"), "text"), ["book"])
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_histogram(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("book", "token").agg(F.sum("count").alias("count"))


def count_changes(events: DataFrame) -> DataFrame:
    """book, token, delta: how the counts change with each document that comes in, is edited or goes. events: doc_id,
    version, book, text; a null text says that the document is gone.

    A document's state is its version and its own counts. A later version takes the old counts back and gives the new ones,
    also where its book is another; an earlier version, or one that was seen, changes nothing, so events may come in any
    order and more than once. Of events of one document and version the last by book and words counts. Rows without a
    document or version are left out."""

    def change(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, book, held = state.get if state.exists else (None, None, "{}")
        best = None
        for part in parts:
            for v, b, words in zip(part["version"], part["book"], part["tokens"], strict=True):
                new = (int(v), b if isinstance(b, str) else "", [] if words is None else list(words))
                best = new if best is None or new > best else best
        if best is None or version is not None and best[0] <= version:
            return
        counts = Counter(best[2])
        delta = Counter({(best[1], t): n for t, n in counts.items()})
        delta.subtract({(book, t): n for t, n in json.loads(held).items()})
        state.update((best[0], best[1], json.dumps(counts)))
        yield pd.DataFrame([(b, t, n) for (b, t), n in delta.items() if n], columns=["book", "token", "delta"])

    rows = events.filter("doc_id IS NOT NULL AND version IS NOT NULL").select("doc_id", F.col("version").cast("long").alias("version"), "book", T.tokens(T.normalise(F.coalesce("text", F.lit("")))).alias("tokens"))
    return rows.groupBy("doc_id").applyInPandasWithState(change, "book string, token string, delta long", "version long, book string, counts string", "append", GroupStateTimeout.NoTimeout)


def changing_histogram(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of each batch of events as a part of its own, which a batch that is run again replaces.
    read_changes adds them up to the counts of all documents as they are."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("book", "token").agg(F.sum("delta").alias("delta")).filter("delta <> 0").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return count_changes(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark, path: str) -> DataFrame:
    """book, token, count; no row for what no document has any more."""
    return spark.read.parquet(path).groupBy("book", "token").agg(F.sum("delta").alias("count")).filter("count <> 0")


def latest_counts(events: DataFrame) -> DataFrame:
    """The same of a table of events: the counts of each document's last version."""
    rows = events.filter("doc_id IS NOT NULL AND version IS NOT NULL")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("book", "text"), F.struct("version", F.coalesce("book", F.lit("")).alias("b"), T.tokens(T.normalise(F.coalesce("text", F.lit("")))).alias("t"))).alias("d"))
    return token_counts(last.select(F.coalesce("d.book", F.lit("")).alias("book"), "d.text"), ["book"])
