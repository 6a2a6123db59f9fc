"""Benchmark passages in documents, by a prefix-filtered set join of word shingles.

A benchmark item's windows are its runs of WINDOW words (a shorter item is one window). A window is the set of its
shingles, and it lies in a document only if all of them do; so of a set ordered by rarity a prefix of one shingle, the
rarest in all documents, is enough to meet every document that has the window. Windows with a shingle that no document
has are gone before the join. Where a document has a window's rarest shingle, the window's length and the shingle's place
in it say where the window would begin and end; what stays within the document is verified: the words of the
document's window of that size, as SHA-256, have to be the item's.

Only DataFrame functions. Documents are read where they lie and never shuffled: shingles of the benchmark go to them in
blocks of BLOCK rows of fixed width, each block broadcast, whatever the benchmark's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import ascii_lower, cut, row_key
from wordloom.operators.ranges import numbered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Rows of a broadcast table: 8 bytes each when counting, about 100 when joining (50 MB).
BLOCK = 1 << 19


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash of the `width` words from each word on; the last ones have fewer words."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))


def windows_of(items: DataFrame, id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(windows: number, words, n, sha; owners: number, item), both written. Each distinct window has one number."""
    own = items.select(F.col(f"`{id}`").alias("item"), words_of(F.col(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = own.select("item", "w", F.explode_outer(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("words"))
    each = cut(each.select("item", "words", F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("sha")))
    windows = cut(numbered(each.groupBy("sha").agg(F.first("words").alias("words")).withColumn("n", F.size("words"))))
    return windows, cut(each.select("item", "sha").distinct().join(windows.select("sha", "number"), "sha").select("number", "item"))


def in_blocks(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """rows (written) in parts of about `most` rows, by a hash of the key."""
    parts = -(-rows.count() // most)
    part = F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(max(parts, 1)))
    return [rows.filter(part == k) for k in range(parts)]


def _spread(docs: DataFrame, text: str, width: int, *columns: Column) -> DataFrame:
    """columns, words, at (from 0) and h of each shingle of each text."""
    found = docs.select(*columns, words_of(F.col(f"`{text}`")).alias("words"))
    # A row for each shingle is made where the join takes it. The outer form keeps Spark from adding a filter on the array's
    # size below, which would find the words anew for each word.
    found = found.select("*", shingle_hashes(F.col("words"), width).alias("_h"))
    return found.select(*[c for c in found.columns if c != "_h"], F.posexplode_outer("_h").alias("at", "h"))


def rarest(docs: DataFrame, text: str, windows: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """number, n, sha, width, h, offset: the shingle of each window that is rarest in all texts, written; windows with a shingle
    that no text has are left out. Ties go by hash, then by offset."""
    width = F.least(F.col("n"), F.lit(shingle))
    of = F.when(F.col("n") == 1, shingle_hashes(F.col("words"), 1))
    for k in range(2, shingle):
        of = of.when(F.col("n") == k, shingle_hashes(F.col("words"), k))
    rows = windows.select("number", "n", "sha", width.alias("width"), F.slice(of.otherwise(shingle_hashes(F.col("words"), shingle)), F.lit(1), F.col("n") - width + 1).alias("hs"))
    rows = cut(rows.select("number", "n", "sha", "width", F.posexplode_outer("hs").alias("offset", "h")))
    counts = []
    for w in range(1, shingle + 1):
        keys = cut(rows.filter(F.col("width") == w).select("h").distinct())
        for part in in_blocks(keys, "h", block):
            met = _spread(docs, text, w).select("h").join(F.broadcast(part), "h", "left_semi")
            counts.append(met.groupBy("h").agg(F.count("*").alias("count")).withColumn("width", F.lit(w)))
    if not counts:
        return rows.limit(0)
    seen = cut(reduce(DataFrame.unionByName, counts))
    rated = rows.join(seen, ["width", "h"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    chosen = rated.groupBy("number", "n", "sha", "width").agg(F.min(F.struct("count", "h", "offset")).alias("p"))
    return cut(chosen.filter("p.count > 0").select("number", "n", "sha", "width", "p.h", "p.offset"))


def occurrences(docs: DataFrame, id: str, text: str, posts: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """_id, _row, start, n, number of each window of posts (of rarest) in each text, written."""
    hits = []
    for w in range(1, shingle + 1):
        for part in in_blocks(posts.filter(F.col("width") == w), "number", block):
            groups = part.groupBy("h").agg(F.collect_list(F.struct("offset", "n", "sha", "number")).alias("posts"))
            spread = _spread(docs, text, w, F.col(f"`{id}`").alias("_id"), row_key(text).alias("_row"))
            start = lambda p: F.col("at") - p["offset"]
            fits = lambda p: (start(p) >= 0) & (start(p) + p["n"] <= F.size("words"))
            same = lambda p: F.unhex(F.sha2(F.array_join(F.slice("words", start(p) + 1, p["n"]), " "), 256)) == p["sha"]
            held = F.filter("posts", lambda p: F.when(fits(p), same(p)).otherwise(F.lit(False)))  # noqa: B023
            met = spread.join(F.broadcast(groups), "h").select("_id", "_row", "at", F.explode_outer(held).alias("p")).filter("p IS NOT NULL")
            hits.append(met.select("_id", "_row", (F.col("at") - F.col("p.offset")).alias("start"), "p.n", "p.number"))
    if not hits:
        return docs.limit(0).select(F.col(f"`{id}`").alias("_id"), F.lit(0).cast("long").alias("_row"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("number"))
    return cut(reduce(DataFrame.unionByName, hits))


def covered(spans: Column) -> Column:
    """How many positions the sorted spans (start, n) cover."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    last = lambda s: s["start"] + s["n"]
    return F.aggregate(spans, begin, lambda a, s: F.struct(F.greatest(a["end"], last(s)).alias("end"), (a["n"] + F.greatest(last(s) - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")))["n"]


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id, n_words, spans (sorted start and n of the windows it has), n_hit (words within
    them), n_items, items_sha256 (of the items' ids, sorted as strings and joined by commas), contaminated.

    Null or wordless text has no words and no hits; a null or wordless item has no windows. Items that share a window
    all count; an item without id marks words but isn't counted. Rows of one id are told apart by their text, and
    repeated rows get the same result. Other columns are ignored, whatever their names; empty tables are fine.
    """
    windows, owners = windows_of(items, item, item_text, window)
    hits = occurrences(docs, id, text, rarest(docs, text, windows, shingle, block), shingle, block)
    # What a text's windows cover is no longer than the text, and no more items own them than there are.
    spans = hits.groupBy("_id", "_row").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    owned = hits.select("_id", "_row", "number").distinct().join(owners.filter("item IS NOT NULL"), "number").groupBy("_id", "_row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    found = spans.withColumnsRenamed({"_id": "_i", "_row": "_r"}).join(owned, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left").select("_i", "_r", "spans", "items")
    rows = docs.select(F.col(f"`{id}`").alias("_id"), row_key(text).alias("_row"), F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left")
    none = F.expr("cast(array() AS array<string>)")
    items_of = F.coalesce("items", none)
    return joined.select(
        F.col("_id").alias(id), "n_words", "spans", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"),
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("spans")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + {WINDOW} - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d) CROSS JOIN (SELECT DISTINCT n FROM v) WHERE k + n - 1 <= len(w)),
h AS (SELECT DISTINCT r, k, x.n, x.s FROM x JOIN v ON x.n = v.n AND x.s = v.s),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h JOIN v ON h.n = v.n AND h.s = v.s WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN i ON d.r = i.r
"""
