"""Where pictures stand in documents and workbooks, and the texts around them, from files built here."""

import io
import struct
import zipfile

from tessella.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
D = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def png(width):
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", width, 9)


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, data in parts.items():
            book.writestr(name, data)
    return out.getvalue()


def links(**targets):
    return f"<Relationships {P}>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def para(text="", *pictures):
    drawn = "".join(f'<w:r><w:drawing><a:blip r:embed="{p}"/></w:drawing></w:r>' for p in pictures)
    return f"<w:p><w:r><w:t>{text}</w:t></w:r>{drawn}</w:p>"


DOCX = packed({
    "word/document.xml": f"<w:document {W}><w:body>{para('one')}{para('')}{para('two', 'r1')}{para('', 'r2', 'r1')}{para('three')}{para('four', 'r9')}{para('five')}</w:body></w:document>",
    "word/_rels/document.xml.rels": links(r1="media/a.png", r2="/word/media/b.png", r3="http://x/y"),
    "word/media/a.png": png(1), "word/media/b.png": png(2), "word/media/unused.png": png(3),
})
SHEET = "<c t='inlineStr'><is><t>{}</t></is></c>"
XLSX = packed({
    "xl/workbook.xml": f"<workbook {S}><sheets><sheet name='Blank' r:id='s2'/><sheet name='Data' r:id='s1'/></sheets></workbook>",
    "xl/_rels/workbook.xml.rels": links(s1="worksheets/sheet1.xml", s2="worksheets/sheet2.xml"),
    "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>" + "".join(f"<row r='{i}'>{SHEET.format(f'a{i}')}{SHEET.format(f'b{i}')}</row>" for i in range(1, 9)) + "</sheetData><drawing r:id='d1'/></worksheet>",
    "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
    "xl/worksheets/_rels/sheet1.xml.rels": links(d1="../drawings/drawing1.xml"),
    "xl/drawings/drawing1.xml": f"<xdr:wsDr {D}><xdr:oneCellAnchor><xdr:from><xdr:col>0</xdr:col><xdr:row>3</xdr:row></xdr:from><xdr:pic><a:blip r:embed='p1'/></xdr:pic></xdr:oneCellAnchor><xdr:absoluteAnchor><xdr:pic><a:blip r:embed='p2'/></xdr:pic></xdr:absoluteAnchor></xdr:wsDr>",
    "xl/drawings/_rels/drawing1.xml.rels": links(p1="../media/c.png", p2="../media/d.png"),
    "xl/media/c.png": png(4), "xl/media/d.png": png(5),
})


def test_pictures_know_their_places(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "bad.docx": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    folder = f"file://{tmp_path}"
    found = files.images(spark, folder)
    got = [(r["file_name"], r["image_index"], r["filename"], r["width"], r["paragraph_index"], r["sheet"], r["cell_row"]) for r in found.where("error is null").orderBy("file_name", "image_index").collect()]
    assert got == [("a.docx", 0, "a.png", 1, 1, None, None), ("a.docx", 1, "b.png", 2, 2, None, None), ("a.docx", 2, "a.png", 1, 2, None, None), ("a.docx", 3, "unused.png", 3, None, None, None), ("b.xlsx", 0, "c.png", 4, None, "Data", 3), ("b.xlsx", 1, "d.png", 5, None, "Data", None)]
    assert [r["file_name"] for r in found.where("error is not null").collect()] == ["bad.docx"]
    texts = files.paragraphs(spark, folder)
    assert [r["text"] for r in texts.orderBy("paragraph_index").collect()] == ["one", "two", files.IMAGE_ONLY, "three", "four", "five"]
    about = files.picture_contexts(found.where("error is null"), texts, files.sheet_rows(files.cells(spark, folder).where("error is null")))
    held = {(r["file_name"], r["image_index"]): r["context"] for r in about.collect()}
    assert held == {("a.docx", 0): "one\nthree", ("a.docx", 1): "one\ntwo\nthree\nfour", ("a.docx", 2): "one\ntwo\nthree\nfour", ("a.docx", 3): None, ("b.xlsx", 0): "\n".join(f"a{i} | b{i}" for i in range(2, 7)), ("b.xlsx", 1): None}


def test_chunks_carry_their_pictures(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    folder = f"file://{tmp_path}"
    chunks = spark.createDataFrame([("k0", [0, 1]), ("k1", [2, 3]), ("k2", [4, 5])], "id string, places array<int>").join(files.paragraphs(spark, folder).select("doc_id").distinct())
    pictures = files.images(spark, folder).select("doc_id", "paragraph_index", "image_index")
    got = {r["id"]: list(r["pictures"]) for r in files.pictures_of_chunks(chunks, pictures, "doc_id", "id", "places", "paragraph_index", "image_index").collect()}
    assert got == {"k0": [0], "k1": [1, 2], "k2": []}
