"""Readers of the lexical data sets, catalogues and book files."""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from contextlib import closing
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import phones as P
from wordloom.operators.ranges import numbered
from wordloom.operators.segments import visible_text
from wordloom.sources.pdf import pdf_parts

# Relations of etymology templates, canonical codes of languages, tags of offensive and of derived senses.
ETYMOLOGY = {"bor": "bor", "bor+": "bor", "inh": "inh", "inh+": "inh", "der": "der", "der+": "der", "uder": "der", "lbor": "lbor", "slbor": "slbor", "calque": "calque"}
LANGUAGE = {"LL.": "la", "ML.": "la", "NL.": "la", "EL.": "la", "VL.": "la", "la-med": "la", "la-ecc": "la", "la-cla": "la", "la-vul": "la", "la-new": "la", "fa-cls": "fa", "grc-koi": "grc"}
OFFENSIVE = ("vulgar", "offensive", "derogatory", "pejorative", "ethnic-slur", "slur")
DERIVED = ("form-of", "alt-of", "alternative")

#: Most bytes of one file in an archive, and of all its files.
ENTRY_BYTES, ARCHIVE_BYTES = 32 << 20, 256 << 20
#: Tasks that read the files of zip archives; more files share tasks.
MOST_MEMBERS = 10_000


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """word, variant, arpabet, syllables, rhyme_key, stress of a CMU dictionary file. Comments and entries that begin
    with neither letter nor apostrophe are left out; variants are numbered in file order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    parts = lines.filter("value NOT LIKE ';;;%'").select("line", F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") > 1)
    word = F.lower(F.regexp_replace(F.element_at("p", 1), r"\(\d+\)$", ""))
    rows = parts.select("line", word.alias("word"), F.slice("p", F.lit(2), F.size("p") - 1).alias("phones")).filter(F.col("word").rlike(r"^[\p{L}']"))
    variant = F.row_number().over(W.partitionBy("word").orderBy("line"))
    p = F.col("phones")
    return rows.select("word", variant.alias("variant"), F.array_join(p, " ").alias("arpabet"), P.syllables(p).alias("syllables"), P.rhyme_key(p).alias("rhyme_key"), P.stress(p).alias("stress"))


NGRAM = "token string, year string, match string"


def ngrams(spark: SparkSession, path: str) -> DataFrame:
    """token, year, count of tab-separated shards, plain or gzipped. Lines without a whole number are left out."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 3)
    return _ngram_fields(lines)


def zipped_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """The same of zip archives."""
    return _ngram_fields(zipped_fields(spark, path, ["token", "year", "match"]).select(F.array("token", "year", "match").alias("f")))


def _ngram_fields(lines: DataFrame) -> DataFrame:
    f = F.col("f")
    rows = lines.select(f[0].alias("token"), f[1].try_cast("int").alias("year"), f[2].try_cast("long").alias("count"))
    return rows.filter("year IS NOT NULL AND count IS NOT NULL")


def yearly_total(spark: SparkSession, path: str) -> DataFrame:
    """total of a file with a line 'year<tab>count...' for each year."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter(f[0].rlike(r"^\d+$")).agg(F.sum(F.try_element_at(f, F.lit(2)).try_cast("long")).alias("total"))


def grouped_total(spark: SparkSession, path: str) -> DataFrame:
    """total of a file with tab-separated groups 'year,count,pages,volumes'."""
    groups = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\s+")).alias("g"))
    return groups.agg(F.sum(F.try_element_at(F.split("g", ","), F.lit(2)).try_cast("long")).alias("total"))


WIKTIONARY = "word string, lang_code string, pos string, redirect string, etymology_text string, etymology_templates array<struct<name: string, args: map<string,string>>>, senses array<struct<tags: array<string>, glosses: array<string>, raw_glosses: array<string>, form_of: array<struct<word: string>>, alt_of: array<struct<word: string>>>>"


def wiktionary(spark: SparkSession, path: str) -> DataFrame:
    """The English entries of JSON lines, gzipped or not: word, pos, n_senses, etymologies, gloss, flags and order.
    Redirects, reconstructions and romanisations are left out."""
    raw = spark.read.schema(WIKTIONARY).json(path).withColumn("order", F.monotonically_increasing_id())
    kept = raw.filter((F.col("lang_code") == "en") & F.col("redirect").isNull() & ~F.col("word").startswith("*") & (F.coalesce("pos", F.lit("")) != "romanization"))
    relation = F.create_map(*[F.lit(x) for p in ETYMOLOGY.items() for x in p])
    canonical = F.create_map(*[F.lit(x) for p in LANGUAGE.items() for x in p])
    named = F.filter(F.coalesce("etymology_templates", F.array()), lambda t: relation[t["name"]].isNotNull() & t["args"]["2"].isNotNull() & (t["args"]["2"] != ""))
    etymologies = F.transform(named, lambda t: F.struct(F.coalesce(canonical[t["args"]["2"]], t["args"]["2"]).alias("lang"), relation[t["name"]].alias("relation")))
    senses = F.coalesce("senses", F.array())
    tagged = lambda s, tags: F.arrays_overlap(F.coalesce(s["tags"], F.array().cast("array<string>")), F.array(*map(F.lit, tags)))
    derived = lambda s: tagged(s, DERIVED) | s["form_of"].isNotNull() | s["alt_of"].isNotNull()
    gloss = F.try_element_at(F.flatten(F.transform(senses, lambda s: F.coalesce(s["glosses"], s["raw_glosses"], F.array().cast("array<string>")))), F.lit(1))
    return kept.select(
        F.lower("word").alias("word"), "pos", F.size(senses).alias("n_senses"), etymologies.alias("etymologies"), "etymology_text", gloss.alias("gloss"),
        ((F.size(senses) > 0) & F.forall(senses, derived)).alias("is_form_of"), F.exists(senses, lambda s: tagged(s, OFFENSIVE)).alias("is_offensive"), (F.col("pos") == "name").alias("is_proper"), "order",
    )


def merged_entries(entries: DataFrame) -> DataFrame:
    """One row a word: senses added up, parts of speech joined, flags folded, the first etymology and gloss in file
    order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("order")))
    with_lang = entries.withColumn("etymology_lang", F.try_element_at("etymologies", F.lit(1))["lang"])
    return with_lang.groupBy("word").agg(
        F.sum("n_senses").alias("n_senses"), F.sort_array(F.collect_set("pos")).alias("poses"), F.min("is_form_of").alias("is_form_of"), F.max("is_offensive").alias("is_offensive"),
        F.min("is_proper").alias("is_proper"), first("etymology_lang").alias("etymology_lang"), first("etymology_text").alias("etymology_text"), first("gloss").alias("gloss"),
    )


def word_list(spark: SparkSession, *paths: str, letters: int = 5) -> DataFrame:
    """word: the distinct words of so many letters of some lists."""
    word = F.lower(F.trim("value"))
    return spark.read.text(list(paths)).select(word.alias("word")).filter(F.col("word").rlike(rf"^\p{{L}}{{{letters}}}$")).distinct()


def _opened(path: str):
    """A seekable stream of a file that Spark names by URI: on a shared disk by its path, elsewhere by pyarrow."""
    if path.startswith("file:"):
        return open(unquote(path.removeprefix("file://").removeprefix("file:")), "rb")
    system, own = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(own)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, bytes (unpacked): the files in zip archives. Only the archives' central directories are read, by
    seeks, a task for each archive at most. An archive lies where every executor reaches it."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["path"]:
                with _opened(archive) as f, zipfile.ZipFile(f) as z:
                    own = [(archive, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(own, columns=["archive", "member", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(listed, "archive string, member string, bytes long")


def zipped_fields(spark: SparkSession, path: str, names: list[str] | None = None, separator: str = "\t") -> DataFrame:
    """The lines of the files in zip archives, which Hadoop's codecs don't open: names are the first fields of each line, and
    only these leave the task that reads it; lines with fewer are left out. Without names, value is the whole line.

    Each file is a partition, found by a seek and unpacked as a stream, so neither archives nor files have a largest
    size; one file's lines are one task's. Text is UTF-8; what isn't stands as a replacement character."""
    members = numbered(zip_members(spark, path))
    dealt = members.repartitionByRange(max(1, min(members.count(), MOST_MEMBERS)), "number").select("archive", "member")
    columns = names or ["value"]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, member in zip(batch["archive"], batch["member"], strict=True):
                with _opened(archive) as f, zipfile.ZipFile(f) as z, z.open(member) as m:
                    lines = io.TextIOWrapper(m, "utf-8", "replace", newline="\n")
                    while part := lines.readlines(1 << 20):
                        rows = [x.rstrip("\r\n") for x in part]
                        if names:
                            rows = [x[: len(names)] for x in (r.split(separator, len(names)) for r in rows) if len(x) >= len(names)]
                        yield pd.DataFrame(rows, columns=columns, dtype="str")

    return dealt.mapInPandas(unpack, ", ".join(f"`{c}` string" for c in columns))


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of the files in zip archives; see zipped_fields()."""
    return zipped_fields(spark, path)


def sqlite_rows(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows of a query over SQLite files (read-only), each opened by one task from its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(content)
                    cursor = db.execute(sql)
                    names = [d[0] for d in cursor.description]
                    while rows := cursor.fetchmany(1 << 14):
                        yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


# The tables of the WordNet database that are read.
WORDNET = {
    "words": "wordid long, lemma string", "senses": "wordid long, synsetid long, tagcount long, sensenum long", "synsets": "synsetid long, pos string, lexdomainid long",
    "lexdomains": "lexdomainid long, lexdomainname string", "semlinks": "synset1id long, synset2id long, linkid long", "lexlinks": "word1id long, word2id long, linkid long", "linktypes": "linkid long, link string",
}


def wordnet(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a WordNet database as SQLite, by name; relations and senses are joined by Spark."""
    return {name: sqlite_rows(spark, path, f"SELECT {', '.join(x.split()[0] for x in schema.split(', '))} FROM {name}", schema) for name, schema in WORDNET.items()}


def stored_files(spark: SparkSession, *folders: str) -> DataFrame:
    """book, path: the file of each book, by the extension that comes first (pdf, epub, txt), then by the folder that
    does. The files aren't read."""
    out = None
    for k, folder in enumerate(folders):
        own = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,epub,txt}").load(folder).select("path", F.lit(k).alias("k"))
        out = own if out is None else out.unionByName(own)
    name = F.substring_index("path", "/", -1)
    kind = F.array_position(F.array(F.lit("pdf"), F.lit("epub"), F.lit("txt")), F.substring_index(name, ".", -1))
    return out.withColumn("book", F.regexp_replace(name, r"\.[^.]*$", "")).groupBy("book").agg(F.min_by("path", F.struct("k", kind.alias("e"))).alias("path"))


def vectors(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """word, vector of a text file of vectors, plain or in a zip archive, its header line aside; with wanted (word),
    only those."""
    f = F.split(F.rtrim("value"), " ")
    lines = zipped_lines(spark, path) if path.endswith(".zip") else spark.read.text(path)
    rows = lines.filter(F.size(f) > 2).select(f[0].alias("word"), F.transform(F.slice(f, F.lit(2), F.size(f) - 1), lambda x: x.try_cast("float")).alias("vector"))
    return rows.join(wanted.select("word").distinct(), "word", "left_semi") if wanted is not None else rows


def language_names(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "code string, name string")


def csv_catalog(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """source_id, title, authors, subjects, language of a catalogue as CSV, gzipped or not: English texts only."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    rows = raw.filter((F.col("Type") == "Text") & (F.col("Language") == "en") & F.col("Text#").rlike(r"^\d+$"))
    out = rows.select(F.col("Text#").alias("source_id"), F.regexp_replace("Title", r"\s+", " ").alias("title"), F.col("Authors").alias("authors"), F.col("Subjects").alias("subjects"), F.col("Language").alias("language"))
    return out.limit(most) if most else out


class _Listing(HTMLParser):
    """Reads the books of a listing page that is marked up with RDFa."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.books: list[dict] = []
        self.field: str | None = None
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "li" and a.get("typeof") == "schema:Book":
            self.books.append({"source_id": a.get("about", ""), "title": "", "author": "", "details": "", "tags": []})
            self.depth = 1
        elif self.depth and tag == "li":
            self.depth += 1
            if self.field == "tags":
                self.books[-1]["tags"].append("")
        if self.depth:
            kind = a.get("property") or ""
            if kind == "schema:name":
                self.field = "author" if self.field == "author" or self.books[-1]["title"] else "title"
            elif a.get("class") in ("author", "details", "tags"):
                self.field = a["class"]

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag == "li":
            self.depth -= 1
        if tag in ("p", "ul", "a", "span") and self.field != "tags" or tag == "ul":
            self.field = None

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if not (self.depth and self.field and text):
            return
        if self.field == "tags":
            if self.books[-1]["tags"]:
                self.books[-1]["tags"][-1] += text
        else:
            self.books[-1][self.field] = f"{self.books[-1][self.field]} {text}".strip()


def listing_books(pages: DataFrame, html: str = "html") -> DataFrame:
    """source_id, title, author, details, subjects of the books on listing pages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page in batch[html]:
                parser = _Listing()
                parser.feed(page or "")
                found += [(b["source_id"], b["title"], b["author"], b["details"], "; ".join(t for t in b["tags"] if t)) for b in parser.books]
            yield pd.DataFrame(found, columns=["source_id", "title", "author", "details", "subjects"])

    return pages.select(html).mapInPandas(read, "source_id string, title string, author string, details string, subjects string")


def file_format(path: Column, head: Column) -> Column:
    """epub, pdf or txt, by a file's first bytes, else by its name."""
    name = F.lower(path)
    return F.when(F.substring(head, 1, 4) == F.lit(b"%PDF"), "pdf").when((F.substring(head, 1, 2) == F.lit(b"PK")) | name.endswith(".epub"), "epub").when(name.endswith(".pdf"), "pdf").otherwise("txt")


def decode(raw: bytes) -> str:
    """Bytes as text: UTF-8 without its mark, else Windows text, else Latin-1."""
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


# Names of spine files that aren't reading matter, and the least words of one that is.
NOT_READING = r"\b(cover|copyright|uncopyright|colophon|imprint|dedication|contents|toc|nav|acknowledg\w*|frontmatter|backmatter|halftitle|titlepage|advert\w*)\b|title[\s_-]?page|half[\s_-]?title|front[\s_-]?matter|back[\s_-]?matter|table[\s_-]?of[\s_-]?contents"
LEAST_WORDS = 20
_not_reading = re.compile(NOT_READING, re.I)


def resolve(base: str, href: str) -> str:
    """The path of a link in an archive."""
    parts: list[str] = []
    for p in f"{base.rpartition('/')[0]}/{unquote(href.partition('#')[0])}".split("/"):
        if p == "..":
            del parts[-1:]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def epub_parts(content: bytes) -> list[tuple[str, bool, str]]:
    """(name, kept, text) of an EPUB's reading order. Raises ValueError for one that is locked or too large."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sizes = [i.file_size for i in z.infolist()]
        if max(sizes, default=0) > ENTRY_BYTES or sum(sizes) > ARCHIVE_BYTES:
            raise ValueError("the archive is too large")
        names = set(z.namelist())
        if "META-INF/encryption.xml" in names and re.search(rb'CipherReference\s+URI="[^"]*\.(?:x?html?|opf|ncx)"', z.read("META-INF/encryption.xml"), re.I):
            raise ValueError("the book is locked")
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        tree = ElementTree.fromstring(z.read(package))
        items = {e.get("id"): e for e in tree.iter() if e.tag.endswith("}item") or e.tag == "item"}
        out = []
        for ref in (e for e in tree.iter() if e.tag.endswith("itemref")):
            item = items.get(ref.get("idref"))
            path = resolve(package, item.get("href", "")) if item is not None else ""
            if path not in names:
                continue
            text = visible_text(decode(z.read(path)))
            name = path.rpartition("/")[2].rpartition(".")[0]
            skip = _not_reading.search(f"{name} {ref.get('idref')}") or "nav" in (item.get("properties") or "").split()
            out.append((name, not skip and len(text.split()) >= LEAST_WORDS, text))
        return out


def book_files(spark: SparkSession, path: str) -> DataFrame:
    """path, format, error, segments (label, kept, text) of book files. A file that can't be read has an error and no
    segments."""
    from wordloom.operators.segments import SEGMENT, text_segments

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, kind, content in zip(batch["path"], batch["format"], batch["content"], strict=True):
                try:
                    parts = epub_parts(content) if kind == "epub" else pdf_parts(content) if kind == "pdf" else text_segments(decode(content))
                    rows.append((p, kind, None, [{"label": a, "kept": b, "text": c} for a, b, c in parts]))
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((p, kind, str(e), []))
            yield pd.DataFrame(rows, columns=["path", "format", "error", "segments"])

    files = spark.read.format("binaryFile").load(path)
    typed = files.select("path", file_format(F.col("path"), F.substring("content", 1, 4)).alias("format"), "content")
    return typed.mapInPandas(read, f"path string, format string, error string, segments {SEGMENT}")


def matrix(spark: SparkSession, x: np.ndarray, ids: list) -> DataFrame:
    """id, vector of the rows of an array."""
    return spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, x, strict=True)], "id string, vector array<float>")
