"""Changes to the library, definitions, small functions and sources."""

import sqlite3
import zipfile

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import catalog as C
from wordloom.functions import tags as TF
from wordloom.operators import catalog as CO
from wordloom.operators import graph as G
from wordloom.operators import library as L
from wordloom.operators import pages as P
from wordloom.operators import scoring, trajectory
from wordloom.operators import tags as TG
from wordloom.operators import vectors as V
from wordloom.sources import readers as R
from wordloom.sources import writers as Wr
from wordloom.sources.written import shared_dir, written


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def library(spark):
    books = spark.createDataFrame([("a", "A", "X", 1850, None)], "book string, title string, author string, year int, content_hash string")
    counts = spark.createDataFrame([("a", "old", 3)], "book string, token string, count long")
    return books, counts


def test_imports_refuse_equal_content(spark, library):
    new = spark.createDataFrame([("b", "The sea, the sea.", "B"), ("c", "the SEA the sea", "C"), ("d", "", "D"), ("a", "New text", "A2")], "book string, text string, title string")
    books, counts = L.commit_books(*library, new)
    assert {(r["book"], r["title"], r["author"]) for r in books.collect()} == {("a", "A2", None), ("b", "B", None), ("d", "D", None)}
    assert rows(counts) == [("a", "new", 1), ("a", "text", 1), ("b", "sea", 2), ("b", "the", 2)]
    again = spark.createDataFrame([("x", "the sea the sea"), ("b", "the sea the sea")], "book string, text string")
    assert {(r["book"], r["duplicate_of"]) for r in L.checked_imports(books, again).collect()} == {("x", "b"), ("b", None)}
    assert tuple(L.import_summary(L.checked_imports(books, new)).first()) == (4, 3, 1, 1)
    assert tuple(L.import_summary(L.checked_imports(books, new.limit(0))).first()) == (0, 0, 0, 0)


def test_books_change_and_go(library):
    books, counts = library
    assert rows(L.update_book(books, "a", " T ", "Y", "1900").select("title", "author", "year")) == [("T", "Y", 1900)]
    assert L.update_book(books, "a", "T", "Y", "99").first()["year"] is None and L.update_book(books, "a", "T", "Y", "x").first()["year"] is None
    assert [t.count() for t in L.delete_book("a", books, counts)] == [0, 0]


def test_book_tags(spark, library):
    table = spark.createDataFrame([("a", "shelf", False), ("a", "shelf.sea", False), ("a", "stack", False), ("a", "src:x", True)], "book string, tag string, auto boolean").withColumn("ts", F.current_timestamp())
    assert [r[1] for r in rows(L.rename_book_tag(table, "shelf", "stack"))] == ["src:x", "stack", "stack.sea"]
    assert [r[1] for r in rows(L.delete_book_tag(table, "shelf"))] == ["src:x", "stack"]
    assert L.add_book_tag(table, library[0], "a", "Shelf").count() == 4 and L.add_book_tag(table, library[0], "a", "new").count() == 5
    for bad in (lambda: L.add_book_tag(table, library[0], "a", "src:y"), lambda: L.add_book_tag(table, library[0], "z", "ok"), lambda: L.add_book_tag(table, library[0], "a", "1"), lambda: L.remove_book_tag(table, "a", "src:x"), lambda: L.rename_book_tag(table, "shelf", "shelf.x"), lambda: L.rename_book_tag(table, "src:x", "y"), lambda: L.delete_book_tag(table, "fmt.pdf")):
        with pytest.raises(ValueError):
            bad()
    assert value(spark, TF.sanitize_book_tag(F.lit(" My:Tag "))) == "my:tag" and value(spark, TF.sanitize_book_tag(F.lit("a:b:c"))) is None


def test_old_tags_get_text_keys(spark):
    old = spark.createDataFrame([(1, 1, "t", None, 2), (1, 1, "t", "me", 1), (9, 1, "t", "me", 1)], "book_id long, word_id long, tag string, rater string, ts long")
    named = lambda c: spark.createDataFrame([(1, "n")], f"id long, {c} string")
    assert rows(L.text_keyed(old, named("book"), named("word"))) == [("n", "n", "t", "me", 1)]
    values = spark.createDataFrame([(0,), (1,), (2,), (None,)], "value int")
    assert sorted(str(r[0]) for r in L.legacy_values(values).collect()) == ["0", "2", "None", "None"]


def test_definitions(spark):
    defs = spark.createDataFrame([("star", "interesting", "", 1), ("b", "neutral", "", 0), ("b.c", "uninteresting", "", 0), ("a", "interesting", "", 0)], "name string, interest string, comment string, fav int")
    assert {r["name"] for r in TG.register(defs, "x.y.z").collect()} == {"star", "a", "b", "b.c", "x", "x.y", "x.y.z"}
    assert {r["name"]: (r["interest"], r["fav"]) for r in TG.set_definition(defs, "b", interest="interesting", fav=1).collect()}["b"] == ("interesting", 1)
    with pytest.raises(ValueError):
        TG.set_definition(defs, "b", interest="great")
    assert [r["name"] for r in defs.orderBy(*TG.scope_order("interest")).collect()] == ["star", "a", "b", "b.c"]
    assert TG.is_known(defs, " B ") and not TG.is_known(defs, "q")
    table = spark.createDataFrame([("b", "w")], "tag string, word string")
    assert rows(TG.rename_tag(table, "b", "q", defs=defs)) == [("q", "w")]
    with pytest.raises(ValueError):
        TG.rename_tag(table, "b", "a", defs=defs)
    interest = spark.createDataFrame([("w", "uninteresting")], "word string, interest string")
    assert TG.visible(table, interest, ["word"]).count() == 0


def test_small_functions(spark):
    lit = F.lit
    assert value(spark, C.looks_wrong(lit(b""), lit("txt"))) == "empty response"
    assert "zip" in value(spark, C.looks_wrong(lit(b"<html>"), lit("epub"))) and "HTML" in value(spark, C.looks_wrong(lit(b" \n <html>"), lit("txt")))
    assert value(spark, C.looks_wrong(lit(b"PK12"), lit("epub"))) == "" == value(spark, C.looks_wrong(lit(b"Call me"), lit("txt")))
    assert value(spark, C.title_of_file(lit("/a/b/Moby_Dick.v2.txt"))) == "Moby Dick.v2"
    assert value(spark, C.shortened(lit("abcdef"), 3)) == "abc…" and value(spark, C.shortened(lit("abc"), 3)) == "abc" and value(spark, C.shortened(lit(None).cast("string"), 3)) == ""
    assert value(spark, C.byline(lit("A; B"), lit(1850))) == "A, B · 1850" and value(spark, C.byline(lit(None).cast("string"), lit(1850))) == "1850" and value(spark, C.byline(lit(" "), lit(None).cast("int"))) == ""
    assert C.settings(["# c", "A=1", 'B = "x=y"', "nothing", ""], {"A": "2"}) == {"A": "2", "B": "x=y"}
    for text in ("", "a", "se:jane-austen/emma", "é…" * 40):
        assert value(spark, C.digest(lit(text))) == f"{reduce(lambda h, b: (h ^ b) * C.DIGEST_FACTOR % 2**64, text.encode(), C.DIGEST_START):016x}"
    assert value(spark, C.digest(lit(None).cast("string"))) is None
    assert value(spark, trajectory.era_label(lit("of"))) == "of its time" and value(spark, scoring.reason_label(lit("short"))) == "too short"
    assert value(spark, TF.pos_label(lit("intj"))) == "interjection" and value(spark, TF.pos_label(lit("noun"))) == "noun"
    assert value(spark, TF.valid_scope(lit("book"))) and not value(spark, TF.valid_scope(lit("x"))) and not value(spark, TF.valid_interest(lit(None).cast("string")))
    assert value(spark, TF.valid_source(lit("a"), ("a",))) and value(spark, TF.valid_source_id(lit("/ebooks/a-b/c_1"))) and not value(spark, TF.valid_source_id(lit("a/../b")))


def test_wordnet_from_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "w.sqlite") as db:
        for name, schema in R.WORDNET.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(x.replace(' long', ' INTEGER').replace(' string', ' TEXT') for x in schema.split(', '))}, extra TEXT)")
        db.executemany("INSERT INTO words VALUES (?, ?, NULL)", [(1, "sea"), (2, "ocean")])
        db.executemany("INSERT INTO senses VALUES (?, ?, ?, ?, NULL)", [(1, 10, 5, 1), (2, 10, None, 1)])
        db.execute("INSERT INTO synsets VALUES (10, 'n', 7, NULL)")
        db.execute("INSERT INTO lexdomains VALUES (7, 'noun.object', NULL)")
    db.close()
    t = R.wordnet(spark, str(tmp_path / "w.sqlite"))
    found = G.lemma_senses(t["words"], t["senses"], t["synsets"], t["lexdomains"])
    assert rows(found.select("lemma", "pos", "category", "tagcount")) == [("ocean", "noun", "noun.object", None), ("sea", "noun", "noun.object", 5)]
    assert t["semlinks"].count() == 0


def test_zipped_vectors_and_stored_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("v.vec", "2 3\na 1 2 3\nb 4 5 6 \n")
    assert rows(R.vectors(spark, str(tmp_path / "v.zip"), spark.createDataFrame([("b",)], "word string"))) == [("b", [4.0, 5.0, 6.0])]
    for folder, names in (("one", ("x.txt", "x.epub", "n.md")), ("two", ("x.pdf", "y.txt"))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text("t")
    found = {r["book"]: r["path"].rpartition("/two/" if r["book"] == "y" else "/one/")[2] for r in R.stored_files(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()}
    assert found == {"x": "x.epub", "y": "y.txt"}


def test_plain_list(spark):
    items = spark.createDataFrame([("b", 1, "dog", "dog/dogs", ["x:2"], "nouns"), ("b", 2, "run", "run", None, "verbs"), ("b", 3, "go", None, ["y", "z"], "verbs")], "book string, place int, word string, forms string, tags array<string>, section string")
    assert Wr.plain_list(items).first()["list"] == "# nouns\ndog dog/dogs // #x:2\n# verbs\nrun\ngo // #y #z"
    assert Wr.plain_list(items.select("book", "place", "word"), ",").first()["list"] == "dog, run, go"


def test_job_list_and_text_order(spark):
    jobs = spark.createDataFrame([(1, "done", 9), (2, "queued", 1), (3, "running", 1), (4, "queued", 5)], "id long, state string, updated int")
    assert [r["id"] for r in L.job_list(jobs).orderBy("place").collect()] == [3, 4, 2, 1]
    page = spark.createDataFrame([("b", 1, 2), ("b", 2, 5), ("b", 3, 5)], "book string, place long, in_book long")
    assert [r["place"] for r in P.most_in_text(page).orderBy("text_place").collect()] == [2, 3, 1]


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).round(3)
    x[7] = x[3]  # a tie
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 4), (99, None)], "id long, vector array<double>").repartition(3)
    for block in (4096, 2):
        got = rows(V.top_similar(table.filter("id % 10 = 3"), table, 4, block))
        expected = []
        for q in (3, 13, 23, 33, 43, 53):
            near = sorted((-round(float(x[q] @ x[i]), 6), i) for i in range(60) if i != q)[:4]
            expected += [(q, i, -s, k + 1) for k, (s, i) in enumerate(near)]
        assert got == sorted(expected, key=str)
    assert V.top_similar(table.limit(0), table).count() == 0


def test_written_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    out = written(df)
    assert out.schema == df.schema and rows(out) == rows(df) and out.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file://"))


def test_reingest(spark):
    books = spark.createDataFrame([("a", "A", "x", 1850, "h"), ("b", "B", "y", None, "k")], "book string, title string, author string, year int, content_hash string")
    books, counts = L.commit_books(books, spark.createDataFrame([("b", "old", 3)], "book string, token string, count long"), spark.createDataFrame([("a", "A", "x", 1850, "one sea")], "book string, title string, author string, year int, text string"))
    texts = spark.createDataFrame([("b", "Two, two ships"), ("c", "not there")], "book string, text string")
    after, found = L.reingest(books, counts, texts)
    assert rows(found) == [("a", "one", 1), ("a", "sea", 1), ("b", "ships", 1), ("b", "two", 2)]
    assert rows(after.select("book", "title", "year")) == [("a", "A", 1850), ("b", "B", None)]
    assert rows(after.join(books, ["book", "content_hash"], "left_anti").select("book")) == [("b",)]
    same, unchanged = L.reingest(books, counts, spark.createDataFrame([("b", "One sea")], "book string, text string"))
    assert rows(same) == rows(books) and rows(unchanged) == rows(counts)


def test_synced(spark):
    catalog = spark.createDataFrame([("g", "1", "Old"), ("g", "2", "Two"), ("s", "1", "Other")], "source string, source_id string, title string")
    sync = spark.createDataFrame([("g", 5, 2), ("s", 6, 1)], "source string, synced_at int, n_rows long")
    fresh = spark.createDataFrame([("g", "1", "New"), ("g", "3", "Three")], "source string, source_id string, title string")
    after, stamps = CO.synced(catalog, sync, fresh, "g", F.lit(9))
    assert rows(after) == [("g", "1", "New"), ("g", "2", "Two"), ("g", "3", "Three"), ("s", "1", "Other")]
    assert rows(stamps) == [("g", 9, 2), ("s", 6, 1)]
    with pytest.raises(ValueError):
        CO.synced(catalog, sync, fresh.limit(0), "g", F.lit(9))


def test_visible_page(spark):
    page = spark.createDataFrame([("a", "w1", 1, 4), ("a", "w2", 2, 4), ("a", "w3", 3, 4), ("a", "w4", 4, 4), ("b", "w1", 1, 1)], "book string, word string, place int, total int")
    defs = spark.createDataFrame([("bad", "uninteresting"), ("good", "interesting"), ("plain", "neutral")], "name string, interest string")
    on = [("a", "w1", "bad", None, "me"), ("*", "w2", "bad.sub", 2, "me"), ("a", "w2", "good", None, "me"), ("a", "w3", "bad", 0, "me"), ("*", "w4", "bad", None, "other"), ("b", "w4", "bad", None, "me"), ("*", "w1", "plain", None, "me")]
    tagged = spark.createDataFrame(on, "book string, word string, tag string, value int, rater string")
    assert [r[:2] for r in rows(P.visible_page(page, defs, tagged))] == [("a", "w2"), ("a", "w3"), ("a", "w4"), ("b", "w1")]
    picks = spark.createDataFrame([("a", "w3"), ("a", "w1"), ("a", "w3")], "book string, word string")
    assert rows(P.visible_page(page, defs, tagged, picks)) == [("a", "w3", 3, 4)] and P.visible_page(page, picks=picks).count() == 2


def test_books_and_groups(spark):
    books = spark.createDataFrame([(1, "a", "A"), (2, "b", None), (3, "c", "C"), (4, "d", "D")], "id int, book string, title string")
    tagged = spark.createDataFrame([("a", "src:x", True), ("a", "shelf", False), ("b", "src:x", True), ("c", "fmt:pdf", True), ("gone", "src:x", True), ("gone", "dormant", False)], "book string, tag string, auto boolean")
    assert {(r["tag"], r["n_books"]) for r in TG.book_tag_counts(tagged, books).collect()} == {("src:x", 2), ("shelf", 1), ("fmt:pdf", 1)}
    got = {r["book"]: (r["title"], [(t["name"], t["auto"], t["n_books"]) for t in r["tags"]]) for r in TG.books_with_tags(books, tagged).collect()}
    assert got == {"a": ("A", [("src:x", True, 2), ("shelf", False, 1)]), "b": ("b", [("src:x", True, 2)]), "c": ("C", [("fmt:pdf", True, 1)]), "d": ("D", [])}
    assert rows(TG.grouped_books(books, tagged)) == [("fmt:pdf", 1, 1, "c", 1), ("shelf", 2, 1, "a", 1), ("src:x", 3, 1, "b", 1), ("untagged", 4, 1, "d", 1)]
    assert rows(TG.grouped_books(books, tagged, "src:x", "d")) == [("shelf", 1, 1, "a", 1), ("src:x", 2, 1, "b", 1), ("untagged", 3, 1, "d", 1)]
    assert TG.grouped_books(books.limit(0), tagged).count() == 0
