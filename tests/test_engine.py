"""The engine's own operators: oracles on the smallest tables, hand-made cases, properties."""

import io
import math
import os
import zipfile
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import html as H
from tessella.functions import text as T
from tessella.operators import chunking as C
from tessella.operators.store import ChunkStore
from tessella.plans import catalog
from tessella.sources import files
from tessella.sources.pdf import page_texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


#: (line, has the form of a heading, level by pdf, txt and md rules).
HEADINGS = [
    ("1 Introduction", True, 0, 2, 2), ("1.2 Overview", True, 0, 2, 3), ("10.3.7 Deep Dive", True, 0, 2, 4), ("2) Methods", True, 0, 2, 2), ("A) Appendix", True, 1, 1, 1), ("B. Background", True, 0, 2, 0), ("IV) Roman style", True, 1, 1, 1),
    ("Introduction to things", True, 1, 1, 1), ("Chapter 1 Introduction", True, 1, 1, 1), ("Section 10: Results", True, 1, 1, 1), ("section IV – Methods", True, 2, 2, 2), ("Chapter 3.2 Advanced Topics", True, 2, 2, 2), ("Chap 3", True, 1, 1, 1),
    ("Section 2.1 - Scope", True, 2, 2, 2), ("chapter iv: the end", True, 2, 2, 2), ("chapter 12 of a tale with a very long title that goes on", True, 3, 3, 3), ("1.2 Title", True, 0, 2, 3), ("2.3.1 Sub Heading", True, 0, 2, 4), ("A. Appendix", True, 0, 2, 0),
    ("1.", False, 0, 0, 0), ("2)  ", False, 0, 0, 0), ("A)     ", False, 0, 0, 2), ("Heading.", False, 0, 0, 0), ("Heading!", False, 0, 2, 0), ("Heading?", False, 0, 2, 0), ("not capitalized heading", False, 0, 0, 0), ("# Heading", False, 0, 2, 1), ("## lower words", False, 0, 2, 2),
    ("Chapter", True, 1, 1, 1), ("Chapter One", True, 1, 1, 1), ("", False, 0, 0, 0), ("X", False, 0, 0, 0), ("Ab", True, 0, 0, 1), ("1. Start", True, 1, 1, 2), ("1.2.3. Deep", True, 1, 1, 4), ("IV. Part", True, 0, 0, 1), ("IIII. Part", True, 0, 0, 0), ("MMMM. Part", True, 0, 0, 1),
    ("plain words here", False, 0, 0, 0), ("LOUD.", False, 0, 0, 0), ("ÄPFEL", False, 0, 2, 2), ("=== a b ===", False, 0, 1, 0), ("=======", False, 0, 1, 0), ("It ends.", False, 0, 0, 0), ("3.14 is pi", False, 0, 0, 3),
]


def test_headings(spark):
    """Both forms of the classifiers on the same lines: as expressions and on one line at a time."""
    rows = spark.createDataFrame([(h[0],) for h in HEADINGS], "s string")
    line = F.col("s")
    got = rows.select("s", T.is_heading_like(line).alias("like"), *[T.heading_level(line, r).alias(r) for r in ("pdf", "txt", "md")]).collect()
    assert [tuple(r) for r in got] == HEADINGS
    assert [(h[0], h[1], *(C.line_level(h[0], r) for r in ("pdf", "txt", "md"))) for h in HEADINGS] == HEADINGS


@given(st.lists(st.text(alphabet="aZÄ1. )#=-IVXé,!\t", max_size=14), min_size=1, max_size=40))
@settings(max_examples=10, deadline=None)
def test_both_classifiers_agree(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for rules in ("pdf", "txt", "md"):
        got = rows.select("i", T.heading_level(F.col("s"), rules).alias("x")).orderBy("i").collect()
        assert [r["x"] for r in got] == [C.line_level(t, rules) for t in texts]


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    (T.BULLET, ["- item", "• item", "* item", "1. item", "2) item", "  - item", "10. x"], ["-item", "•item", "*item", "1.item", "item", "a) item", "", "–  item"]),
    (r"^\s*$", ["", "   ", "\t", "\r\n", "\t \n  "], [" a ", ".", " - ", "0", " \n x"]),
])
def test_line_patterns(spark, pattern, yes, no):
    assert [one(spark, F.col("s").rlike(pattern), s=s) for s in (*yes, *no)] == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(("lines", "toc"), [
    (["Contents of it"] + [f"Part {i} of the whole . . . . . . . . {i}" for i in range(5)], True),
    (["Table of Contents", "a", "b", "c", "d"], True),
    (["Mục lục", "a", "b", "c", "d"], True),
    (["Table of Contents", "a", "b"], False),
    ([f"a long identifier{i}" for i in range(9)], False),
    ([f"short {i}" for i in range(9)], False),
    ([f"Failure is everywhere {i}" for i in range(5)] + ["words"] * 5, True),
    ([f"Failure is everywhere {i}" for i in range(3)] + ["words"] * 7, False),
    ([f"Failure is everywhere {i}" for i in range(3)] + ["words"] * 5 + ["a........b", "a . . . . . . . . b"], True),
])
def test_contents_pages(spark, lines, toc):
    assert one(spark, T.is_toc_page(F.col("s")), s="\n".join(lines)) is toc


def test_text_functions(spark):
    assert one(spark, T.fix_linebreaks(F.col("s")), s="exam-\nple one\ntwo ,\n\nthree") == "example one two,\n\nthree"
    assert one(spark, T.roman_value(F.col("s")), s="MCMXCIV") == 1994
    assert one(spark, T.roman_value(F.col("s")), s="MX!") == 0
    assert one(spark, T.questions(F.col("s"), ["d1", "d2"], 2), s="1. What?\nno\n- Why?\n1. What?") == ["What?", "Why?"]
    assert one(spark, T.questions(F.col("s"), ["d1", "d2"], 2), s="") == ["d1", "d2"]
    assert one(spark, H.widest(F.col("s")), s="a.png 100w, b.png 300w, c.png 20w") == "b.png"


def test_blocks_and_breadcrumbs(spark):
    text = "# A\nbody\n\n    far\n    more\nback\n\n## B\nx"
    found = one(spark, C.blocks(F.col("s")), s=text)
    assert [(b["indent"], b["text"]) for b in found] == [(0, "# A\nbody"), (4, "    far\n    more"), (0, "back"), (0, "## B\nx")]
    chunks = C.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "w " * 1200)], "doc_id long, text string"), most=6, least=2).collect()
    assert any(list(r["breadcrumbs"]) == ["# A"] for r in chunks if r["doc_id"] == 1)
    under = C.chunk_documents(spark.createDataFrame([(1, "Top\n===\n\nfirst words\n\nlower\n---\n\nmore words")], "doc_id long, text string"), "md", most=3, least=1).collect()
    assert [(r["content"], list(r["breadcrumbs"])) for r in under] == [("Top\n===", []), ("[Context: Top]\n\nfirst words", ["Top"]), ("[Context: Top]\n\nlower\n---", ["Top"]), ("[Context: Top > lower]\n\nmore words", ["Top", "lower"])]
    assert sum(r["content"].count("w") for r in chunks if r["doc_id"] == 3) == 1200


@given(st.lists(st.integers(1, 40), max_size=60), st.lists(st.booleans(), min_size=60, max_size=60))
def test_packing_keeps_order_and_bound(sizes, pieces):
    groups = C.pack(sizes, 5, 30, pieces)
    assert [i for g in groups for i in g] == list(range(len(sizes)))
    assert all(len(g) == 1 or sum(sizes[i] for i in g) <= 30 for g in groups)


@pytest.mark.parametrize(("sizes", "pieces", "groups"), [
    ([20, 10, 5], None, [[0, 1], [2]]),
    ([20, 12, 3, 9], None, [[0], [1], [2, 3]]),  # 12 did not fit and has the least: it stands alone
    ([3, 3, 3, 3], [True] * 4, [[0, 1], [2, 3]]),  # pieces end a group as soon as it has the least
    ([40, 2, 2], None, [[0], [1, 2]]),
])
def test_packing_rules(sizes, pieces, groups):
    assert C.pack(sizes, 5, 30, pieces) == groups


def test_oversized_blocks():
    assert C.split_block("one two. three four.\n- a bullet. stays whole\nfive six", 2, 5) == ["one two.\nthree four.", "- a bullet. stays whole", "five six"]
    assert C.split_block("a. " + "b " * 9 + ". c", 2, 5) == ["a.\n" + " ".join("b" * 9) + " .", "c"]
    assert C.split_block("a a. " + "b " * 9 + ". c", 2, 5) == ["a a.", " ".join("b" * 9) + " .", "c"]


@given(st.text(alphabet="ab \n\t-=#.", max_size=120))
@settings(max_examples=15, deadline=None)
def test_both_block_readers_agree(spark, text):
    row = spark.createDataFrame([(text,)], "s string").select(C.blocks(F.col("s")).alias("b")).first()["b"]
    assert [(b["indent"], b["text"]) for b in row] == C._blocks(text)


@given(st.text(alphabet="ab. \n-", max_size=200))
def test_split_block_loses_nothing(text):
    assert "".join("".join(C.split_block(text, 2, 4)).split()) == "".join(text.split())


def test_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    assert store.read() is None and store.delete_file("a") == 0
    rows = spark.createDataFrame([("a0", "a", 0), ("a1", "a", 1), ("b0", "b", 0)], "id string, file_name string, chunk_index int")
    store.insert(rows)
    store.insert(rows.withColumn("chunk_index", F.lit(9)))
    assert store.read().count() == 3 and store.read().where("chunk_index = 9").count() == 0
    assert store.delete_file("a") == 2 and [r["id"] for r in store.file_chunks("b").collect()] == ["b0"]
    store.insert(rows.withColumn("more", F.lit("m")))
    assert sorted((r["id"], r["more"]) for r in store.read().collect()) == [("a0", "m"), ("a1", "m"), ("b0", None)]
    assert store.delete_file("none") == 0
    before = store.read()
    store.compact()
    assert sorted(r["id"] for r in before.collect()) == ["a0", "a1", "b0"]
    store.vacuum()
    assert sorted(r["id"] for r in store.read().collect()) == ["a0", "a1", "b0"] and len(list((tmp_path / "store" / "parts").iterdir())) == 1
    for n in range(ChunkStore.MOST_NAMED + 2):  # more deleted files than a read names one by one
        store.insert(spark.createDataFrame([(f"x{n}", f"x{n}", 0)], rows.schema))
        assert store.delete_file(f"x{n}") == 1
        if n > 1 and n < ChunkStore.MOST_NAMED:
            state = store.table.state()
            store.table.publish(state | {"gone": [*state["gone"], *([f"y{i}", 0] for i in range(ChunkStore.MOST_NAMED))]})
            break
    assert sorted(r["id"] for r in store.read().collect()) == ["a0", "a1", "b0"]
    state = store.table.state()
    store.clear()
    assert store.read().count() == 0
    with pytest.raises(RuntimeError):
        store.table.publish(state)
    store.insert(rows)
    assert store.read().count() == 3
    store.drop()
    assert store.read() is None


def test_readers(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    docx, xlsx = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><a:blip xmlns:a="a"/></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(xlsx, "w") as z:
        r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Two" r:id="b"/><sheet name="One" r:id="a"/><sheet name="None" r:id="c"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet7.xml"/><Relationship Id="c" Target="worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet7.xml", f'<worksheet xmlns="{s}"><sheetData><row r="3"><c r="A3"><v> </v></c><c r="AB3" t="inlineStr"><is><t>far</t></is></c></row><row r="5"><c r="A5"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet9.xml", f'<worksheet xmlns="{s}"><sheetData/></worksheet>')
    for name, content in {"a.txt": "é".encode("latin-1"), "b.md": b"![x](y) hi", "c.docx": docx.getvalue(), "d.xlsx": xlsx.getvalue(), "e.docx": b"broken", "f.bin": b"x", "g.xls": b"old"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["file_name"]: r for r in files.read(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a.txt", "b.md", "c.docx", "d.xlsx", "e.docx"}
    assert got["a.txt"]["text"] == "é" and got["b.md"]["text"] == " hi"
    assert got["c.docx"]["text"] == "## Top\nBody" and got["d.xlsx"]["text"] == "=== SHEET: Two ===\nRow 1: far\nRow 2: 1\n\n=== SHEET: One ===\nRow 1: x | 5"
    assert got["e.docx"]["text"] is None and got["e.docx"]["error"]
    marked = {r["file_name"]: r["text"] for r in files.read(spark, f"file://{tmp_path}", with_images=True).collect()}
    assert marked["c.docx"] == "## Top\nBody\n[Image-only paragraph]"
    held = files.cells(spark, f"file://{tmp_path}")
    assert ("Two", 2, 27, "far") in [tuple(r)[1:5] for r in held.collect()]
    info = {r["sheet"]: (r["n_rows"], r["n_columns"], r["is_empty"]) for r in files.sheet_info(held).collect()}
    assert info == {"Two": (2, 2, False), "One": (1, 2, False), "None": (0, 0, True)}
    assert {r["file_type"]: r["files"] for r in files.listed(spark, f"file://{tmp_path}").collect()}["unsupported"] == ["f.bin", "g.xls"]


def test_main_text(spark):
    page = "<html><title>t</title><body><nav>menu</nav><main><p>One<p>Two[1] <sup class='reference'>x</sup><img src='/i.png'><div class='toc'>gone</div><ul><li>a<li>b</ul><section><h2>References</h2><p>gone</section><pre>gone</pre><p>last</main><p>after</html>"
    other = "<div id='mw-content-text'>first <b>choice</b></div><main>second</main>"
    docs = "<base href='http://d/x/'><div class='md-content'><article class='md-content__inner md-typeset'><h1>T</h1><p>a <b>b</b></p><ul><li>one<li>two</ul><div class='toc'><p>gone</p></div><img srcset='s.png 1w, w.png 9w'></article></div>"
    rows = spark.createDataFrame([(1, "http://h/p", page), (2, "http://h/q", other), (3, None, None), (4, "http://h/d", docs)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in H.main_texts(rows).collect()}
    assert got[1]["main_text"] == "One\nTwo\na\nb\nlast" and got[1]["image_urls"] == ["http://h/i.png"] and not got[1]["is_article"]
    assert got[2]["main_text"] == "first\nchoice" and got[3]["main_text"] == ""
    site = H.docs_texts(rows).where("page_id = 4").first()
    assert "T" in site["main_text"] and "- one - two" in site["main_text"] and "gone" not in site["main_text"]
    assert site["image_urls"] == ["http://d/x/w.png"]
    assert [H.picture_url(H.Node("img", a), "http://h/") for a in ({"data-lazy-src": "l.png", "src": "s.png"}, {"data-srcset": "a.png 3w, b.png 3w"}, {})] == ["http://h/l.png", "http://h/b.png", None]
    assert H.report(rows).where("page_id = 2").first()["title"] == "(untitled)"


def test_fetching(spark):
    from tessella.sources import web

    png = b"\x89PNG\r\n\x1a\n"

    def fetcher(url):
        if url.endswith("/old"):
            return 301, {"Location": "/new"}, b""
        if url.endswith("/loop"):
            return 302, {"location": "loop"}, b""
        if url.endswith(".png"):
            return 200, {"Content-Type": "image/png"}, png * (4 if "big" in url else 1)
        if url.endswith("/gone"):
            raise OSError("no route")
        return 200, {"Content-Type": "text/html"}, b"<title>New</title><body><img src='a.png'><img src='/b/a.png'><img src='big.png'><img src='page'></body>"

    urls = spark.createDataFrame([(f"http://h/{n}",) for n in ("old", "loop", "gone", "new", "new")], "url string")
    got = {r["url"].rsplit("/", 1)[1]: r for r in web.fetch(urls, fetcher).collect()}
    assert got["old"]["final_url"] == "http://h/new" and got["old"]["redirects"] == ["http://h/old"] and got["loop"]["error"] and "no route" in got["gone"]["error"] and len(got) == 4
    pages = web.pages(web.fetch(urls.where("url like '%new'"), fetcher))
    held = sorted((r["name"], r["url"], r["error"]) for r in web.download(H.main_texts(pages), fetcher, 20).collect())
    assert held == [("a.png", "http://h/a.png", None), ("a_2.png", "http://h/b/a.png", None), ("big.png", "http://h/big.png", "too large"), ("page", "http://h/page", "not an image")]
    assert {r["url"]: r["title"] for r in web.site_report(urls, fetcher).collect()}["http://h/old"] == "New"
    pdf = a_pdf([b"BT /F1 12 Tf 72 700 Td (Some words) Tj 0 -14 Td (References) Tj 0 -14 Td (gone) Tj ET"])
    read = web.pdf_texts(web.fetch(urls.limit(1).selectExpr("explode(array('http://h/a.pdf', 'http://h/b.pdf')) as url"), lambda url: (200, {}, pdf if "a" in url else b"no")))
    assert {r["url"][-5:]: (r["text"], r["error"] is None) for r in read.collect()} == {"a.pdf": ("Some words", True), "b.pdf": (None, False)}
    assert one(spark, web.is_pdf(F.col("u"), F.col("t")), u="http://h/x", t="application/PDF; q") and not one(spark, web.is_pdf(F.col("u"), F.col("t")), u="http://h/x", t="text/html")


def test_prompts(spark):
    from tessella.functions import prompts

    assert prompts.render("summary", file_name="a", contents="b").endswith("\n\nb") and prompts.render("summary", file_name="a") == "" == prompts.render("none")
    assert all(prompts.places(p) for p in prompts.PROMPTS.values())
    assert one(spark, prompts.rendered("$a costs $$${b}!", a=F.col("a"), b=F.col("b")), a="tea", b=3) == "tea costs $3!"
    assert one(spark, prompts.rendered("$a $b", a=F.col("a")), a="tea") == "" == one(spark, prompts.rendered("$a", a=F.lit(None).cast("string")), a="tea")


def test_token_counts_of_a_tokenizer(spark):
    from public_tokenizers import path

    from tokenizers import Tokenizer

    file = path("byte_bpe_50k.json")
    texts = ["", "one two", "naïve 12,5%"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.bpe_count(file)(F.col("s")).alias("n")).collect()
    own = Tokenizer.from_file(file)
    assert {r["s"]: r["n"] for r in rows} == {t: max(1, len(own.encode(t, add_special_tokens=False).ids)) for t in texts}


def test_predicates(spark):
    from tessella.operators.retrieval import matches

    rows = spark.createDataFrame([(1, "x"), (2, "y"), (None, "x")], "a int, b string")
    ids = lambda where: [r["a"] for r in rows.where(matches(where)).collect()]
    assert ids({}) == [1, 2, None] and ids({"a": 1}) == [1] and ids({"a": {"$gte": 1, "$lt": 2}}) == [1] and ids({"$or": [{"a": 2}, {"b": "x"}]}) == [1, 2, None]
    assert ids({"a": {"$nin": [1]}, "b": {"$ne": "x"}}) == [2]
    for bad in ({"$not": []}, {"a": {"$like": "x"}}):
        with pytest.raises(ValueError, match="unknown"):
            matches(bad)


def test_bm25_value(spark):
    from tessella.operators.retrieval import bm25

    got = {r["id"]: r["bm25_score"] for r in bm25(spark.createDataFrame([(1, "a b"), (2, "c"), (3, "c d"), (4, "")], "id long, content string"), "a a").collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1 + 0.5)
    assert got[2] == got[4] == 0 and got[1] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (5 / 3))))


def test_engine(spark, tmp_path):
    from tessella.engine import NO_DOCUMENTS, Engine

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Rivers\n\nThe river runs to the sea.\n\n# Hills\n\nThe hill is green.")
    (docs / "b.txt").write_text("A kettle boils water.")
    (docs / "c.bin").write_bytes(b"x")
    (docs / "d.docx").write_bytes(b"broken")

    def model(name, prompt):
        assert prompt
        return {"validate": "VALID: kettle?" if "Question: kettle" in prompt and "short" in prompt else "IRRELEVANT: no", "answer": "It boils. ['http://h/i.png']", "summary": "short", "suggest": "1. What boils?"}[name]

    engine = Engine(spark, f"file://{tmp_path}/store", model=model)
    assert engine.query("kettle")["response"] == NO_DOCUMENTS and engine.chunks().count() == 0 and engine.suggestions()[1:] == engine.suggestions()[1:4]
    listed = {r["file_type"]: r["files"] for r in engine.list_files(f"file://{docs}").collect()}
    assert listed == {"md": ["a.md"], "txt": ["b.txt"], "docx": ["d.docx"], "unsupported": ["c.bin"]}
    state = {r["file_name"]: r for r in engine.process(f"file://{docs}", 1, 6).collect()}
    assert state["a.md"]["message"].startswith("stored chunks: ") and not state["a.md"]["has_images"] and "not read" in state["d.docx"]["message"]
    assert state["a.md"]["success"] and state["a.md"]["chunks_stored"] >= 2 and not state["d.docx"]["success"] and state["d.docx"]["error"]
    before = engine.chunks().count()
    engine.process(f"file://{docs}", 1, 6)
    assert engine.chunks().count() == before
    hit = engine.hits("the kettle boils water", 1).first()
    assert hit["file_name"] == "b.txt" and engine.hits("  ").count() == 0
    assert "# Rivers" in [r["section_title"] for r in engine.file_chunks("a.md").collect()]
    assert engine.rerank("river sea").count() >= 1
    assert {r["file_name"] for r in engine.search("river", where={"file_type": "txt"}).collect()} == {"b.txt"}
    engine.export_json(f"file://{tmp_path}/json", "a.md")
    assert spark.read.json(f"file://{tmp_path}/json").count() == engine.file_chunks("a.md").count()
    assert engine.query("kettle") == {"success": True, "response": "It boils.", "images": ["http://h/i.png"], "chunks_found": before}
    assert engine.query("other") == {"success": False, "error": "no", "images": [], "chunks_found": 0}
    assert engine.suggestions()[0] == "What boils?" and len(engine.suggestions()) == 4
    assert Engine(spark, f"file://{tmp_path}/store").suggestions()[0].startswith("What are")
    assert engine.delete_file("b.txt") == 1 and engine.stats().first()["files"] == 1
    assert engine.clear() == before - 1 and engine.chunks().count() == 0


@given(st.lists(st.integers(1, 40), max_size=60))
def test_sheets_stay_whole(sizes):
    groups = C.pack_sheets(sizes, 10, 30)
    assert [i for g in groups for i in g] == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) >= 10 for g in groups[:-1])


def test_web_functions(spark):
    assert one(spark, T.techdocs_url(F.col("s")), s="https://h/x/docs/a/b/c/d?q") == "https://h/api/techdocs/static/docs/a/b/c/index.html"
    assert one(spark, T.techdocs_url(F.col("s")), s="https://h/docs/a/b") is None
    assert one(spark, T.cookie_names(F.col("s")), s="a=1; Path=/, b=2, a=3, junk") == ["a", "b"]
    assert one(spark, T.image_ending(F.col("s")), s="Image/PNG; q=1") == ".png" and one(spark, T.image_ending(F.col("s")), s="text/html") == ""
    assert one(spark, T.file_base(F.col("s")), s="é!") == "image" and one(spark, T.file_base(F.col("s")), s="a b.c") == "a_b_c"
    assert one(spark, T.normalize_ws(F.col("s")), s=" a\nb )\r\n\n\n\nc ") == "a b )\n\nc"


def a_pdf(pages, packed=False):
    """A PDF of the given content streams; packed: Flate streams, the page tree in an object stream."""
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange"
    plain = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}/Resources<</Font<</F1 3 0 R/F2 4 0 R>>>>>>".encode(), 3: b"<</Type/Font/Subtype/Type1/Encoding<</Differences[1/fi/uni20AC]>>>>", 4: b"<</Type/Font/Subtype/Type0/ToUnicode 5 0 R>>"}
    streams = {5: cmap}
    for i, content in enumerate(pages):
        plain[10 + 2 * i] = f"<</Type/Page/Parent 2 0 R/Contents {11 + 2 * i} 0 R>>".encode()
        streams[11 + 2 * i] = content
    if packed:
        body, heads = b"", []
        for n, v in plain.items():
            heads.append(f"{n} {len(body)}")
            body += v + b" "
        first = " ".join(heads).encode() + b" "
        streams[50], plain = first + body, {}
    out = b"%PDF-1.5\n"
    for n, v in plain.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, v)
    for n, v in streams.items():
        extra = b"/Type/ObjStm/N %d/First %d" % (len(heads), len(first)) if n == 50 else b""
        data = zlib.compress(v) if packed else v
        out += b"%d 0 obj\n<</Length %d%s%s>>\nstream\n%s\nendstream\nendobj\n" % (n, len(data), b"/Filter/FlateDecode" if packed else b"", extra, data)
    return out + b"%%EOF"


PDF_PAGES = [
    b"BT /F1 12 Tf 72 700 Td (First \\(one\\)) Tj 0 -14 Td [(Sec) -20 (ond) -400 (line)] TJ ET q 1 0 0 1 0 50 cm BT /F1 12 Tf 72 700 Td (On top \\341) Tj ET Q",
    b"",
    b"BT /F2 10 Tf 14 TL 1 0 0 1 72 500 Tm <00010002000300040005> Tj T* /F1 10 Tf (\\001x \\002) Tj ET",
]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed):
    assert page_texts(a_pdf(PDF_PAGES, packed)) == ["On top á\nFirst (one)\nSecond line", "", "Abcd\nfix €"]


def test_pdf_files(spark, tmp_path):
    contents = b"BT /F1 12 Tf 72 700 Td (Table of Contents) Tj " + b" ".join(b"0 -14 Td (Part %d) Tj" % i for i in range(8)) + b" ET"
    for name, data in {"a.pdf": a_pdf([contents, *PDF_PAGES], True), "b.pdf": b"no", "c.pdf": a_pdf(PDF_PAGES).replace(b"%%EOF", b"trailer<</Encrypt 9 0 R>>"), "d.pdf": b"%PDF-1.4"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["file_name"]: r for r in files.read(spark, f"file://{tmp_path}").collect()}
    assert got["a.pdf"]["text"] == "\x1e2\x1e\n\nOn top á\nFirst (one)\nSecond line\n\n\x1e4\x1e\n\nAbcd\nfix €"
    assert "not a PDF" in got["b.pdf"]["error"] and "encrypted" in got["c.pdf"]["error"] and got["d.pdf"]["text"] == ""
    rows = C.chunk_documents(files.read(spark, f"file://{tmp_path}").where("file_name = 'a.pdf'").select("doc_id", "text", "file_type"), most=20).collect()
    assert [(r["page_from"], r["page_to"]) for r in rows] == [(2, 4)] and "\x1e" not in rows[0]["content"] and "Abcd" in rows[0]["content"]


@given(st.lists(st.sampled_from([b"1 0 obj", b"<<", b">>", b"[", b"]", b"(", b")", b"<0a", b">", b"/Type/Catalog", b"/Pages 1 0 R", b"/Kids[1 0 R 1 0 R]", b"/Type/Page/Contents 2 0 R", b"stream\n", b"endstream", b"endobj", b"%x\n", b"BT Tj TJ Tf", b"2 0 obj", b"\\"]), max_size=40))
def test_broken_pdf_ends(parts):
    try:
        assert isinstance(page_texts(b"%PDF " + b" ".join(parts)), list)
    except (ValueError, zlib.error, TypeError, AttributeError, KeyError):
        pass


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"rest"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x03\x00\x04rest"
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/media/b.jpeg", jpeg)
        z.writestr("word/media/a.png", png)
    pdf = b"%PDF-1.4 1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]>> endobj 3 0 obj <</Type/Page/Resources<</XObject<</I 4 0 R>>>>>> endobj 4 0 obj <</Subtype/Image/Width 9/Height 8/Filter/DCTDecode/Length 3>>\nstream\nxyz\nendstream endobj"
    for name, data in {"a.docx": docx.getvalue(), "b.pdf": pdf, "c.xlsx": b"broken", "d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.images(spark, f"file://{tmp_path}")
    got = sorted((r["file_name"], r["page_number"], r["filename"], r["format"], r["width"], r["height"], r["size_bytes"]) for r in found.where("error is null").collect())
    assert got == [("a.docx", None, "a.png", "PNG", 7, 5, len(png)), ("a.docx", None, "b.jpeg", "JPEG", 4, 3, len(jpeg)), ("b.pdf", 1, "I", "JPEG", 9, 8, 3)]
    assert [r["file_name"] for r in found.where("error is not null").collect()] == ["c.xlsx"]
    whole = files.image_summary(found).where("file_name is null and format is null").first()
    assert (whole["images"], whole["bytes"], whole["large"]) == (3, len(png) + len(jpeg) + 3, 0)


def test_stream_ingest(spark, tmp_path):
    from tessella.streaming import ingest

    store, source = ChunkStore(spark, f"file://{tmp_path}/store"), tmp_path / "in"
    schema = "id string, file_name string, chunk_index int"
    for n, rows in enumerate(([("a0", "a", 0), ("a0", "a", 1)], [("a0", "a", 2), ("b0", "b", 0)])):
        spark.createDataFrame(rows, schema).write.json(f"file://{source}/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(f"file://{source}")
        ingest.ingest(stream, store, f"file://{tmp_path}/marks").awaitTermination()
    assert sorted(r["id"] for r in store.read().collect()) == ["a0", "b0"]
