"""The reference data sets' places taken by the driver's tables, for the queries.

Books are the documents of one source; the dictionary is what the documents themselves tell about their words.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import frequency, lemma
from wordloom.sources.written import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, token, count."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "text")
    return frequency.token_counts(docs, ["book"])


def counts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_counts, written once."""
    return written(book_counts(spark, sf_dir))


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, count, count_lc, lang, toxic (the least label of the labelled documents) for each token and language;
    written once, so that totals don't read the documents again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    each = labelled.select("lang", "toxic", F.explode(T.surface_tokens(F.col("text"))).alias("t"))
    return written(each.groupBy(F.lower("t").alias("token"), "lang").agg(F.count("*").alias("count"), F.sum((F.col("t") == F.lower("t")).cast("long")).alias("count_lc"), F.min("toxic").alias("toxic")))


def frequencies(by: DataFrame) -> DataFrame:
    """token, count, count_lc, cap_ratio, pm, pm_lc of all documents. by: surface()."""
    merged = by.groupBy("token").agg(F.sum("count").alias("count"), F.sum("count_lc").alias("count_lc"))
    return frequency.per_million(merged.withColumn("cap_ratio", (F.col("count") - F.col("count_lc")) / F.col("count")))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words table: a row for each lower-case token of the documents.

    Origin is the language that has the word most often; a word counts as known if the benchmark has it or it occurs
    twice; as offensive if all labelled documents with it are toxic; as an adjective by its ending.
    """
    by = surface(spark, sf_dir)
    merged = by.groupBy("token").agg(
        F.sum("count").alias("count"), F.sum("count_lc").alias("count_lc"), F.min("toxic").alias("toxic"),
        F.min_by("lang", F.struct((-F.col("count")).alias("n"), "lang")).alias("etymology_lang"),
    )
    merged = frequency.per_million(merged.withColumn("cap_ratio", (F.col("count") - F.col("count_lc")) / F.col("count")))
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct().withColumn("known", F.lit(True))
    word = F.col("token")
    return merged.join(known, "token", "left").select(
        word.alias("word"), "count", "cap_ratio", "pm", "pm_lc", "etymology_lang",
        T.letter_count(word).alias("length"), T.alpha_only(word).alias("alpha_only"), T.rare_letters(word).alias("rare_letters"),
        T.vowel_groups(word).alias("syllables"), (F.coalesce("known", F.lit(False)) | (F.col("count") >= 2)).alias("in_wiktionary"),
        F.lit(False).alias("is_form_of"), F.lit(False).alias("is_proper"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_offensive"),
        word.rlike("(able|ible|ish|al|ous)$").alias("is_adj"),
    )


def words_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary, written once, for plans that join it several times."""
    return written(dictionary(spark, sf_dir))


def words_and_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """words_table and counts_table, written at the same time."""
    with ThreadPoolExecutor(2) as pool:
        words, counts = pool.submit(words_table, spark, sf_dir), pool.submit(counts_table, spark, sf_dir)
        return words.result(), counts.result()


def lemmas(words: DataFrame, level: int, vectors: DataFrame | None = None, derivations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(word, root) of the words of letters at a level, and their families."""
    letters = words.filter("alpha_only")
    two = written(lemma.two_steps(written(lemma.steps(letters, level, vectors, derivations))))
    rooted = written(lemma.roots(letters, two))
    return rooted, lemma.families(letters, rooted)


def word_vectors(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """word, vector: the embeddings in order of vec_id for the most frequent words of letters."""
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("rank"), F.col("embedding").alias("vector"))
    ranked = frequency.positional_rank(words.filter("alpha_only").select("word", "count"), "count", "word")
    return written(ranked.join(vectors, "rank").select("word", "vector"))


def derivations(words: DataFrame) -> DataFrame:
    """word, target: each word of letters with what it begins with, one to four letters shorter, alone and before an e."""
    word = F.col("word")
    stems = [F.substring(word, F.lit(1), F.length(word) - k) for k in range(1, 5)]
    found = words.filter("alpha_only").select("word", F.explode(F.array(*stems, *[F.concat(x, F.lit("e")) for x in stems])).alias("target"))
    return found.filter("length(target) >= 3 AND target <> word")


def word_pos(words: DataFrame) -> DataFrame:
    """word, pos, source: a part of speech by ending, and for words with rare letters a second opinion."""
    word = F.col("word")
    pos = F.when(word.endswith("ing") | word.endswith("ed"), "verb").when(word.endswith("ly"), "adv").when(word.rlike("(able|ible|ish|al|ous)$"), "adj").when(F.length(word) <= 2, "prep").otherwise("noun")
    first = words.select("word", pos.alias("pos"), F.lit("wiktextract").alias("source"))
    second = words.filter("rare_letters IS NOT NULL").select("word", F.lit("noun").alias("pos"), F.lit("wordnet").alias("source"))
    return first.unionByName(second)
