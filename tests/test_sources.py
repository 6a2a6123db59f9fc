"""Readers and writers on small files."""

import gzip
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from wordloom.sources import readers as R
from wordloom.sources import writers as Wr
from wordloom.sources.pdf import page_texts, pdf_parts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pronunciations(spark, tmp_path):
    (tmp_path / "d").write_text(";;; c\nABACUS  AE1 B AH0 K AH0 S\nREAD  R EH1 D\nREAD(1)  R IY1 D\n!X  EH1\n'TIS T IH1 Z\n")
    out = rows(R.pronunciations(spark, str(tmp_path / "d")).select("word", "variant", "syllables", "rhyme_key", "stress"))
    assert out == [("'tis", 1, 1, "IH Z", "1"), ("abacus", 1, 3, "AE B AH K AH S", "100"), ("read", 1, 1, "EH D", "1"), ("read", 2, 1, "IY D", "1")]


def test_ngrams(spark, tmp_path):
    text = "The\t1900\t3\t1\nthe\t1901\tbad\t1\nthe\t1901\t7\t1\n"
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write(text)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.tsv", text)
    expected = [("The", 1900, 3), ("the", 1901, 7)]
    assert rows(R.ngrams(spark, str(tmp_path / "a.gz"))) == expected == rows(R.zipped_ngrams(spark, str(tmp_path / "b.zip")))
    (tmp_path / "t").write_text("1900\t10\t1\nx\t5\n1901\t20\t2\n")
    (tmp_path / "g").write_text(" 1900,10,1,1\t1901,20,1,1\t")
    assert R.yearly_total(spark, str(tmp_path / "t")).first()[0] == 30 == R.grouped_total(spark, str(tmp_path / "g")).first()[0]


def test_wiktionary(spark, tmp_path):
    (tmp_path / "w.json").write_text(
        '{"word":"Kiosk","lang_code":"en","pos":"noun","etymology_templates":[{"name":"bor","args":{"2":"fa-cls"}}],"senses":[{"glosses":["a stand"]}]}\n'
        '{"word":"kiosk","lang_code":"en","pos":"verb","senses":[{"tags":["slur"],"glosses":["second"]}]}\n'
        '{"word":"kiosks","lang_code":"en","pos":"noun","senses":[{"tags":["form-of"]}]}\n{"word":"x","lang_code":"de","pos":"noun","senses":[]}\n{"word":"*y","lang_code":"en","pos":"noun","senses":[]}\n'
    )
    out = {r["word"]: r for r in R.merged_entries(R.wiktionary(spark, str(tmp_path / "w.json"))).collect()}
    assert set(out) == {"kiosk", "kiosks"} and out["kiosks"]["is_form_of"]
    k = out["kiosk"]
    assert (k["n_senses"], k["poses"], k["etymology_lang"], k["gloss"], k["is_offensive"], k["is_form_of"]) == (2, ["noun", "verb"], "fa", "a stand", True, False)


def test_lists_vectors_and_catalogue(spark, tmp_path):
    (tmp_path / "l").write_text("Crane\nab\nslate\ncrane\n")
    assert rows(R.word_list(spark, str(tmp_path / "l"))) == [("crane",), ("slate",)]
    (tmp_path / "v").write_text("2 3\na 1 2 3\nb 4 5 6 \n")
    assert rows(R.vectors(spark, str(tmp_path / "v"), spark.createDataFrame([("b",)], "word string"))) == [("b", [4.0, 5.0, 6.0])]
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write('Text#,Type,Language,Title,Authors,Subjects\n1,Text,en,"A\nB","X, Y","S; ""T"""\n2,Sound,en,C,D,E\nz,Text,en,C,D,E\n')
    assert rows(R.csv_catalog(spark, str(tmp_path / "c.csv.gz"))) == [("1", "A B", "X, Y", 'S; "T"', "en")]


def test_listing(spark):
    page = '<ol><li typeof="schema:Book" about="/ebooks/a/t"><p><a><span property="schema:name">Title</span></a></p><p class="author"><a><span property="schema:name">Some One</span></a></p><div class="details"><p>1,200 words</p></div><ul class="tags"><li><a>Fiction</a></li><li><a>Sea</a></li></ul></li></ol>'
    out = R.listing_books(spark.createDataFrame([(page,)], "html string")).first()
    assert (out["source_id"], out["title"], out["author"], out["subjects"]) == ("/ebooks/a/t", "Title", "Some One", "Fiction; Sea") and "1,200 words" in out["details"]


def epub(path, locked=False):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c" href="cover.xhtml"/><item id="t" href="text/ch%201.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="t"/></spine></package>')
        z.writestr("O/cover.xhtml", "<p>" + "word " * 30 + "</p>")
        z.writestr("O/text/ch 1.xhtml", "<html><head><title>no</title></head><body><p>" + "sea " * 30 + "</p></body></html>")
        if locked:
            z.writestr("META-INF/encryption.xml", '<x><CipherReference URI="O/cover.xhtml"/></x>')


def test_book_files(spark, tmp_path):
    epub(tmp_path / "a.epub")
    epub(tmp_path / "b.epub", locked=True)
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbfcaf\xc3\xa9")
    (tmp_path / "d.txt").write_bytes(b"caf\xe9 \x93")
    (tmp_path / "e.bin").write_bytes(b"%PDF-1.4")
    (tmp_path / "f.pdf").write_bytes(pdf([b"BT /F 9 Tf (" + b"sea " * 20 + b") Tj ET"]))
    by = {r["path"].rsplit("/", 1)[1]: r for r in R.book_files(spark, str(tmp_path)).collect()}
    assert [(s["label"], s["kept"]) for s in by["a.epub"]["segments"]] == [("cover", False), ("ch 1", True)]
    assert by["b.epub"]["error"] == "the book is locked" and by["e.bin"]["format"] == "pdf" and by["e.bin"]["error"]
    assert [(s["label"], s["kept"]) for s in by["f.pdf"]["segments"]] == [("pages 1–1", True)]
    assert by["c.txt"]["segments"][0]["text"] == "café" and by["d.txt"]["segments"][0]["text"] == "café “"


def pdf(pages, packed=False, locked=False):
    """A PDF whose pages have the given content streams, as objects of their own or in an object stream."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: b"<</Type/Font/Subtype/Type1/Encoding<</Differences[1/fi]>>>>", 4: b"<</Type/Font/Subtype/Type0/ToUnicode 5 0 R>>"}
    kids = range(10, 10 + 2 * len(pages), 2)
    objects[2] = b"<</Type/Pages/Kids[%s]/Resources<</Font<</F 3 0 R/U 4 0 R>>>>>>" % b" ".join(b"%d 0 R" % k for k in kids)
    for k in kids:
        objects[k] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (k + 1)
    names = b"begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <0062> endbfrange"
    streams = {5: (b"", names)} | {k + 1: (b"/Filter/FlateDecode", zlib.compress(p)) for k, p in zip(kids, pages, strict=True)}
    if packed:
        at, body = 0, b""
        head = []
        for k, v in objects.items():
            head.append(b"%d %d" % (k, len(body)))
            body += v + b" "
        head = b" ".join(head) + b" "
        streams[90] = (b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(objects), len(head)), zlib.compress(head + body))
        objects = {}
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in objects.items())
    out += b"".join(b"%d 0 obj\n<<%s/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (k, h, len(v), v) for k, (h, v) in streams.items())
    return out + b"trailer\n<</Root 1 0 R%s>>\nstartxref\n0\n%%%%EOF" % (b"/Encrypt 7 0 R" if locked else b"")


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed):
    """Operators that show text, lines and blanks by position, names of characters, words divided at a line's end."""
    pages = [
        b"BT /F 12 Tf 72 700 Td (One \\(two\\) thr-) Tj 0 -14 Td (ee \001ve) Tj ET",
        b"BT /F 9 Tf 1 0 0 1 72 700 Tm [(He) 20 (llo) -300 (sea)] TJ 1 0 0 1 140 700 Tm (here) Tj 14 TL (next) ' ET",
        b"BT /U 9 Tf <000100020003> Tj ET BI /W 1 ID \x00(\xff EI q Q",
        b"",
    ]
    assert page_texts(pdf(pages, packed)) == ["One (two) three five", "Hello sea here\nnext", "Abc", ""]


def test_pdf_runs():
    full = b"BT /F 9 Tf (" + b"sea " * 20 + b") Tj ET"
    parts = pdf_parts(pdf([full, full, b"BT /F 9 Tf (7) Tj ET", b"", full]))
    assert [(a, b, len(c.split())) for a, b, c in parts] == [("pages 1–2", True, 40), ("pages 3–4 — image-only / blank (no usable text)", False, 1), ("pages 5–5", True, 20)]
    for bad in (pdf([full], locked=True), b"%PDF-1.4", b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >>"[:30]):
        with pytest.raises(ValueError):
            pdf_parts(bad)
    assert pdf_parts(b"%PDF-1.4 1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[2 0 R 9 0 R]>> endobj") == []


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    Wr.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    Wr.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert rows(spark.read.parquet(path).select("k", "v")) == [(1, "a"), (2, "c")]
    for n in (1, 2):
        Wr.append_log(spark, str(tmp_path / "log"), "s", "d", n)
    assert spark.read.parquet(str(tmp_path / "log")).agg(F.sum("rows")).first()[0] == 3
    assert Wr.as_json(spark.createDataFrame([(1,)], "a int")).first()[0] == '{"a":1}'


def test_zip_members_are_partitions(spark, tmp_path):
    lines = {f"shard{k}.tsv": "".join(f"w{k}_{i}\t{1900 + i}\t{i}\tmore\tfields\n" for i in range(200 * k)) for k in range(4)}
    with zipfile.ZipFile(tmp_path / "one file.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", "")
        for name, text in lines.items():
            z.writestr(f"folder/{name}", text, zipfile.ZIP_STORED if name == "shard1.tsv" else zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("x", "a\tb\tc\r\nshort\tline\né\t\tlast without end")
    members = R.zip_members(spark, str(tmp_path / "*.zip"))
    assert sorted(r["bytes"] for r in members.collect()) == sorted(len(t) for t in [*lines.values(), "a\tb\tc\r\nshort\tline\né\t\tlast without end."])
    found = R.zipped_fields(spark, str(tmp_path / "*.zip"), ["token", "year"])
    assert found.rdd.getNumPartitions() == 5 and found.columns == ["token", "year"]
    parts = [p for p in found.rdd.mapPartitions(lambda rows: [sorted({r["token"].split("_")[0] for r in rows})]).collect() if p]
    assert sorted(parts) == sorted([["w1"], ["w2"], ["w3"], sorted(["a", "short", "é"])])
    assert found.count() == 1200 + 3
    assert sorted(r[0] for r in R.zipped_lines(spark, str(tmp_path / "two.zip")).collect()) == ["a\tb\tc", "short\tline", "é\t\tlast without end"]
    assert R.zipped_ngrams(spark, str(tmp_path / "one file.zip")).count() == 1200
