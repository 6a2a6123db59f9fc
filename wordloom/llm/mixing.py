"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of id and text) and repeated up to `most` times; a copy's virtual
finish time is the source's tokens up to and including it, divided by the source's target. All copies are range-sorted
by finish time, sums run over the ranges and within them, and the order is truncated where the total budget is used
up, so every source stands at about the same share of its target wherever the mix is cut. A source's running sums go
down a fixed tree of 256 x 256 ranges, so that no task holds a whole source, however large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import cut, row_key

WEIGHTS, MOST = (1, 2, 3), 3
#: Copies in a range of the global order, about.
RANGE_ROWS = 1 << 16


def n_words(text):
    """How many words a text has (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.0, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with target: share of all sizes, dealt by weight, none above most times its size.

    The weights repeat over the sources in order of their code points, null last. Stopping the sources of least
    most * size / weight first gives the same as resharing the excess until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("double")
    ranked = sources.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = ranked.withColumn("_level", (F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # The first source that isn't stopped, and all after it, stand at that source's level.
    level = level.withColumn("_free", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    level = level.withColumn("_at", F.first("_free", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return level.select("source", "source_size", F.coalesce(F.col("_w") * F.col("_at"), F.col("_cap")).alias("target"))


def _down(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """levels[k] has keys[:k+1] and size, and the last what else its rows have; adds _before, the sum of all that
    comes earlier with the same keys[0], by one level at a time."""
    top = levels[0].drop("size").withColumn("_before", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        within = W.partitionBy(*keys[:k]).orderBy(keys[k]).rowsBetween(W.unboundedPreceding, -1)
        sums = level.withColumn("_own", F.coalesce(F.sum("size").over(within), F.lit(0)))
        match = top.drop("size").withColumnsRenamed({x: f"_t{x}" for x in keys[:k]})
        on = [F.col(x).eqNullSafe(F.col(f"_t{x}")) for x in keys[:k]]
        top = sums.join(match, on).withColumn("_before", F.col("_before") + F.col("_own")).drop("_own", *[f"_t{x}" for x in keys[:k]])
    return top


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each row of docs: doc_id, row (tells rows of one id apart), size, source, source_size, target,
    cum (the source's tokens up to and including it), copies (how often the mix takes the document, 0 to most) and taken
    (copies * size).

    Copies are taken whole, in order of finish time, while the sum of all taken up to and including those of equal
    finish time is within the budget (the sum of the targets). The order within a source is by md5 of the id (null as
    'null') and the text, then id, then row. Documents without words are taken once and cost nothing; so are those of a source
    without words, whose target is 0. Rows equal in id and text have one place each. An empty table gives no rows.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    slim = cut(
        docs.select(F.col(id).alias("doc_id"), row_key(text).alias("row"), n_words(F.col(text)).alias("size"), F.col(source).alias("source"), digest.alias("h"))
        .withColumn("a", F.substring("h", 1, 2)).withColumn("b", F.substring("h", 3, 2))
    )
    fine = cut(slim.groupBy("source", "a", "b").agg(F.sum("size").alias("size")))
    coarse = fine.groupBy("source", "a").agg(F.sum("size").alias("size"))
    total = fine.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(total, share, weights, most).withColumn("size", F.lit(0))
    placed = cut(_down([goals, coarse, fine], ["source", "a", "b"])).drop("size").withColumnsRenamed({"source": "_s", "a": "_a", "b": "_b"})
    near = W.partitionBy("source", "a", "b").orderBy("h", "doc_id", "row").rowsBetween(W.unboundedPreceding, 0)
    summed = slim.withColumn("_own", F.sum("size").over(near))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    queued = summed.join(placed, on).select("doc_id", "row", "size", "source", "source_size", "target", (F.col("_before") + F.col("_own")).alias("cum"))
    queued = cut(queued)
    at = cut_time(queued, most)
    copies = sum((F.when(_finish(e) <= F.lit(at), 1).otherwise(0) for e in range(most)), F.lit(0))
    copies = F.when(F.col("size") == 0, 1).otherwise(copies).cast("int")
    return queued.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def _finish(epoch):
    """The virtual finish time of a document's copy number epoch (from 0)."""
    return (F.lit(epoch) * F.col("source_size") + F.col("cum")) / F.col("target")


def cut_time(queued: DataFrame, most: int) -> float:
    """The latest finish time whose copies, with all earlier ones, fit in the budget; -1 if none does.

    The copies are range-sorted by finish time and written with their range's number; a range's sum of earlier ranges,
    of which there is one row each, and the running sum within it say where the budget runs out.
    """
    budget = queued.groupBy("source").agg(F.max("target").alias("t")).agg(F.sum("t")).first()[0]
    if not budget:
        return -1.0
    costly = queued.filter("size > 0 AND target > 0")
    ranges = max(1, -(-costly.count() * most // RANGE_ROWS))
    copies = costly.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select("size", _finish(F.col("e")).alias("v"))
    ordered = cut(copies.repartitionByRange(ranges, "v").withColumn("k", F.spark_partition_id()))
    sums = ordered.groupBy("k").agg(F.sum("size").alias("s"), F.min("v").alias("low")).withColumn("before", F.coalesce(F.sum("s").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    room = F.lit(budget * (1 + 1e-12))
    last = sums.filter(F.col("before") <= room).agg(F.max(F.struct("k", "before", "low", "s")).alias("x")).select("x.*").first()
    # All ranges before the last one that begins within the budget fit whole; that one is cut.
    own = ordered.filter(F.col("k") == last["k"]).groupBy("v").agg(F.sum("size").alias("s"))
    spent = own.withColumn("spent", F.lit(last["before"]) + F.sum("s").over(W.orderBy("v")))
    at = spent.filter(F.col("spent") <= room).agg(F.max("v")).first()[0]
    if at is None:
        at = ordered.filter(F.col("k") < last["k"]).agg(F.max("v")).first()[0]
    return -1.0 if at is None else at


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with the columns of docs, in order of finish
    time: every beginning of the result, as files or partitions in order, is near the targets' shares. Documents
    without words come first."""
    plan = mix(docs, id, text, source, share, weights, most).filter("copies > 0")
    key = lambda *c: F.xxhash64(*c)
    turns = F.array_sort(F.collect_list(F.struct("copies", "cum", "source_size", "target")))  # rows equal in id, text and source
    plan = plan.groupBy("doc_id", "row", "source").agg(turns.alias("__wl_turns"))
    plan = plan.select(key("doc_id", "row", "source").alias("__wl_key"), F.col("doc_id").alias("__wl_id"), F.col("row").alias("__wl_same"), F.col("source").alias("__wl_source"), "__wl_turns")
    rows = docs.withColumn("__wl_row", row_key(text)).withColumn("__wl_k", key(id, "__wl_row", source))
    on = (F.col("__wl_k") == F.col("__wl_key")) & F.col(id).eqNullSafe(F.col("__wl_id")) & (F.col("__wl_row") == F.col("__wl_same")) & F.col(source).eqNullSafe(F.col("__wl_source"))
    single, several = plan.filter(F.size("__wl_turns") == 1), plan.filter(F.size("__wl_turns") > 1)
    nth = F.row_number().over(W.partitionBy("__wl_k", id, "__wl_row", source).orderBy(F.lit(1)))
    once = rows.join(single, on).withColumn("__wl_turn", F.col("__wl_turns")[0])
    again = rows.join(several, on).withColumn("__wl_n", nth).withColumn("__wl_turn", F.try_element_at("__wl_turns", F.col("__wl_n"))).drop("__wl_n")
    taken = once.unionByName(again).filter("__wl_turn.copies > 0").withColumn("__wl_copy", F.explode(F.expr("sequence(0, __wl_turn.copies - 1)")))
    at = F.when(F.col("__wl_turn.target") > 0, (F.col("__wl_copy") * F.col("__wl_turn.source_size") + F.col("__wl_turn.cum")) / F.col("__wl_turn.target")).otherwise(0.0)
    return taken.withColumn("__wl_at", at).repartitionByRange("__wl_at").sortWithinPartitions("__wl_at", "__wl_key").select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (list_value(1.0::DOUBLE, 2.0, 3.0))[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, (source_size * {MOST})::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
f AS (SELECT *, first_value(CASE WHEN lev * w <= cap THEN lev END IGNORE NULLS) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM l),
t AS (SELECT source, source_size, coalesce(w * lv, cap) AS target FROM f),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT size, (k * source_size + cum) / target AS v FROM q, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND target > 0),
g AS (SELECT v, sum(sum(size)) OVER (ORDER BY v) AS spent FROM e GROUP BY v),
b AS (SELECT coalesce(max(v), -1) AS stop FROM g WHERE spent <= (SELECT sum(target) FROM t) * (1 + 1e-12)),
n AS (SELECT q.*, CASE WHEN size = 0 THEN 1 ELSE (cum / target <= b.stop)::INT + ((source_size + cum) / target <= b.stop)::INT + ((2 * source_size + cum) / target <= b.stop)::INT END AS copies FROM q, b)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies::INT AS copies FROM n
"""
