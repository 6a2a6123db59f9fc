"""Word relations: semantic and lexical links, coordinate terms, pages of relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Relation names by link number, and the order in which relations are shown.
SEMANTIC = {1: "hypernym", 11: "part meronym", 12: "part holonym", 13: "member meronym", 14: "member holonym", 15: "substance meronym", 16: "substance holonym"}
SHOWN = ("hypernym", "coordinate", "part meronym", "part holonym", "member meronym", "member holonym", "substance meronym", "substance holonym", "derivation", "antonym", "pertainym")
# Part-of-speech codes.
POS = {"n": "noun", "v": "verb", "a": "adj", "s": "adj", "r": "adv"}


def lemma_senses(words: DataFrame, senses: DataFrame, synsets: DataFrame, domains: DataFrame) -> DataFrame:
    """lemma, pos, category, tagcount, sensenum of all senses."""
    names = F.create_map(*[F.lit(x) for p in POS.items() for x in p])
    joined = words.join(senses, "wordid").join(synsets, "synsetid").join(domains, "lexdomainid")
    return joined.select("lemma", names[F.col("pos")].alias("pos"), F.col("lexdomainname").alias("category"), "tagcount", "sensenum", "synsetid", "lexdomainid")


def lemma_summary(senses: DataFrame) -> DataFrame:
    """lemma, n_senses, poses, categories, primary_category (the most tagged, then the lowest sense)."""
    return senses.groupBy("lemma").agg(F.count("*").alias("n_senses"), F.sort_array(F.collect_set("pos")).alias("poses"), F.sort_array(F.collect_set("category")).alias("categories"), F.max_by("category", F.struct("tagcount", (-F.col("sensenum")).alias("s"))).alias("primary_category"))


def semantic_links(words: DataFrame, senses: DataFrame, links: DataFrame) -> DataFrame:
    """word, rel, target: links between synsets (synset1id, synset2id, linkid) as links between their words."""
    label = F.create_map(*[F.lit(x) for p in SEMANTIC.items() for x in p])
    left = words.join(senses, "wordid").select(F.col("synsetid").alias("synset1id"), F.col("lemma").alias("word"))
    right = words.join(senses, "wordid").select(F.col("synsetid").alias("synset2id"), F.col("lemma").alias("target"))
    chosen = links.filter(F.col("linkid").isin(*SEMANTIC)).withColumn("rel", label[F.col("linkid").cast("int")])
    return left.join(chosen, "synset1id").join(right, "synset2id").select("word", "rel", "target").distinct()


def lexical_links(words: DataFrame, links: DataFrame, types: DataFrame, kinds=("derivation", "antonym", "pertainym")) -> DataFrame:
    """word, rel, target: links between words."""
    a, b = words.select(F.col("wordid").alias("word1id"), F.col("lemma").alias("word")), words.select(F.col("wordid").alias("word2id"), F.col("lemma").alias("target"))
    return links.join(types, "linkid").filter(F.col("link").isin(*kinds)).join(a, "word1id").join(b, "word2id").select("word", F.col("link").alias("rel"), "target").distinct()


def coordinates(members: DataFrame, hypernyms: DataFrame, freq: DataFrame, most: int = 25) -> DataFrame:
    """word, target, place: words that have, under some parent and in its domain, another synset than one of word's, most
    frequent first, then by name. members: synset, domain, word; hypernyms: synset, parent; freq: word, pm (unknown: 0).

    Synsets aren't paired. Under one parent a word whose only synset is s meets all words but those that have s alone,
    and a word of several synsets meets all. So words are labelled with their only synset, and a parent keeps, in order
    of frequency, its first 2 * most + 2 words after each label keeps its first most + 1: whichever label is taken out,
    and the word itself, `most` words are left, and they are the first ones. Each word is then joined with its parents'
    lists: at most 2 * most + 2 rows for each. Both cuts are made before the shuffle too. Rows with nulls match nothing.
    """
    rated = members.join(freq.select("word", "pm"), "word", "left").withColumn("pm", F.coalesce("pm", F.lit(0.0)))
    under = rated.join(hypernyms, "synset").filter("parent IS NOT NULL AND domain IS NOT NULL AND word IS NOT NULL")
    own = under.groupBy("parent", "domain", "word").agg(F.max("pm").alias("pm"), F.min("synset").alias("a"), F.max("synset").alias("b"))
    own = own.select("parent", "domain", "word", "pm", F.when(F.col("a") == F.col("b"), F.col("a")).alias("only"))
    first = lambda rows, keys, k: rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("pm").desc(), "word"))).filter(F.col("_k") <= k).drop("_k")
    lists = first(first(own, ["parent", "domain", "only"], most + 1), ["parent", "domain"], 2 * most + 2)
    lists = lists.select("parent", "domain", F.col("word").alias("target"), F.col("pm").alias("target_pm"), F.col("only").alias("target_only"))
    # A parent may have a third of all words: its list, of bounded size, goes to each part of them.
    met = own.select("parent", "domain", "word", "only").join(lists, ["parent", "domain"])
    met = met.filter((F.col("word") != F.col("target")) & ~F.coalesce(F.col("only") == F.col("target_only"), F.lit(False)))
    each = met.groupBy("word", "target").agg(F.max("target_pm").alias("pm"))
    place = F.row_number().over(W.partitionBy("word").orderBy(F.col("pm").desc(), "target"))
    return each.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("word", "target", "place")


def relation_page(relations: DataFrame, word: str, in_book: DataFrame, freq: DataFrame, most: int = 120) -> DataFrame:
    """rel, target, in_book, pm: a word's relations in the order of SHOWN, those in the book first, then by frequency."""
    own = relations.filter(F.col("word") == word).select("rel", "target").join(freq.select(F.col("word").alias("target"), "pm"), "target", "left")
    own = own.join(in_book.select(F.col("token").alias("target"), F.lit(True).alias("in_book")), "target", "left").withColumn("in_book", F.coalesce("in_book", F.lit(False)))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, SHOWN)), F.col("rel")), F.lit(99))
    return own.orderBy(order, F.col("in_book").desc(), F.col("pm").desc_nulls_last(), "target").limit(most).select("rel", "target", "in_book", "pm")
