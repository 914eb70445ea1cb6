"""Readers of a folder's documents: text, Markdown, PDF, DOCX and XLSX; one row a file, a bad file gives a row with its error."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.text import clean_markdown, is_toc_page, page_mark, row_text
from tessella.sources.pdf import page_images, page_texts

#: Namespaces of the office formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
D = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
#: Fixed value: what stands for a paragraph of pictures alone.
IMAGE_ONLY = "[Image-only paragraph]"

#: Characters below which a page counts as blank.
LEAST_PAGE = 3


def file_type(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ending.isin("pdf", "txt", "md", "docx", "xlsx"), ending)


def decoded(content: Column) -> Column:
    """UTF-8, else Latin-1, which reads any bytes."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def document_id(path: Column) -> Column:
    """A file's name without its ending and a digest of its whole path: files of one name in different folders stay apart."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat_ws("_", stem, F.left(F.md5(path.cast("binary")), F.lit(12)))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("file_name"), document_id(F.col("path")).alias("doc_id"), file_type(F.col("path")).alias("file_type"), "content").where("file_type is not null")


def _own_text(p: ElementTree.Element) -> str:
    """A paragraph's text, without that of text boxes drawn in it."""
    out, open_ = [], [p]
    while open_:
        node = open_.pop()
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag in (f"{W}tab", f"{W}br"):
            out.append("\t" if node.tag == f"{W}tab" else "\n")
        elif node.tag not in (f"{W}txbxContent", f"{W}pPr"):
            open_ += reversed(node)
    return "".join(out).strip()


def _pictured(p: ElementTree.Element) -> list[str]:
    """The relationships of the pictures drawn in an element, in order."""
    marks = ((n, f"{R}embed") if n.tag.endswith("}blip") else (n, f"{R}id") for n in p.iter() if n.tag.endswith(("}blip", "}imagedata")))
    return [n.get(key) or n.get(f"{R}link") or "" for n, key in marks]


def _body_paragraphs(content: bytes, with_images: bool) -> Iterator[tuple[ElementTree.Element, str]]:
    """The body's own paragraphs with text, or with pictures alone, and their text; tables and text boxes are no paragraphs."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")
    for p in body.findall(f"{W}p") if body is not None else []:
        text = _own_text(p) or (IMAGE_ONLY if with_images and _pictured(p) else "")
        if text:
            yield p, text


def docx_paragraphs(content: bytes, with_images: bool = False) -> list[tuple[int, str, str, int, int]]:
    """(index, text, style, heading level or 0, indent in 18-point levels) of the body's own paragraphs with text. with_images: a paragraph
    of pictures alone stands with a placeholder."""
    out = []
    for p, text in _body_paragraphs(content, with_images):
        style, indent = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}pPr/{W}ind")
        name = style.get(f"{W}val", "") if style is not None else ""
        twips = (indent.get(f"{W}left") or indent.get(f"{W}start") or "0") if indent is not None else "0"
        level = int((re.findall(r"\d+", name) or ["1"])[0]) if name.lower().startswith("heading") else 0
        out.append((len(out), text, name, level, int(float(twips) / 20 / 18)))
    return out


def _column(reference: str | None, after: int) -> int:
    """The number of a cell's column, from 0, by its reference; the one after the cell before where it has none."""
    letters = re.match("[A-Z]+", reference or "")
    if not letters:
        return after
    n = 0
    for c in letters.group():
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_cells(content: bytes) -> list[tuple[str, int | None, int | None, str | None]]:
    """(sheet, row, column, value) of every cell that holds something, by the workbook's order of sheets; a sheet without any gives one
    row of nulls. A sheet's file is the one that the workbook's relationships name."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in book.namelist():
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for k, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{S}sheet"), 1):
        target = targets.get(sheet.get(f"{R}id")) or f"worksheets/sheet{k}.xml"
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        found = []
        for i, row in enumerate(ElementTree.fromstring(book.read(path)).iter(f"{S}row") if path in book.namelist() else ()):
            at = -1
            for c in row.iter(f"{S}c"):
                at = _column(c.get("r"), at + 1)
                v, kind = c.find(f"{S}v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
                text = shared[int(text)] if kind == "s" and text else text
                if text.strip():
                    found.append((sheet.get("name"), int(row.get("r") or i + 1) - 1, at, text))
        out += found or [(sheet.get("name"), None, None, None)]
    return out


def xlsx_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number after empty rows went, values) of every sheet."""
    out: list[tuple[str, int, list[str]]] = []
    last = None
    for sheet, row, _, value in xlsx_cells(content):
        if row is None:
            continue
        if last != (sheet, row):
            out.append((sheet, out[-1][1] + 1 if out and out[-1][0] == sheet else 0, []))
        out[-1][2].append(value)
        last = (sheet, row)
    return out


def _marked(pages: list[str], content: bytes) -> list[str]:
    """Pages with a line for each of their pictures."""
    lines: dict[int, list[str]] = {}
    for number, name, _, width, height, _ in page_images(content):
        lines.setdefault(number, []).append(f"[IMAGE: {name} - {width}x{height}]")
    return ["\n".join([p, *lines.get(i, [])]) if lines.get(i) else p for i, p in enumerate(pages, 1)]


def _texts(batches: Iterator[pd.DataFrame], with_images: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, errors, pages = [], [], []
        for kind, content in zip(pdf["file_type"], pdf["content"], strict=True):
            text = error = found = None
            try:
                if kind == "docx":
                    text = "\n".join(f"{'#' * min(level, 6)} {t}" if level else " " * indent + t for _, t, _, level, indent in docx_paragraphs(content, with_images))
                elif kind == "xlsx":
                    sheets: dict[str, list[str]] = {}
                    for sheet, n, values in xlsx_rows(content):
                        sheets.setdefault(sheet, [f"=== SHEET: {sheet} ==="]).append(f"Row {n + 1}: " + " | ".join(v for v in values if v.strip()))
                    text = "\n\n".join("\n".join(rows) for rows in sheets.values())
                else:
                    found = _marked(page_texts(content), content) if with_images else page_texts(content)
            except Exception as problem:  # one bad file must not end the load
                error = f"{type(problem).__name__}: {problem}"
            texts.append(text)
            errors.append(error)
            pages.append(found)
        yield pdf.drop(columns="content").assign(text=texts, error=errors, pages=pages)


def read(spark: SparkSession, folder: str, with_images: bool = False) -> DataFrame:
    """(path, file_name, doc_id, file_type, text, error) of a folder's files. Pages of a PDF begin with their marks; blank and contents
    pages are left out. A paragraph's indent is one space a level. with_images: pictures leave a line in the text where they stand."""
    found = scan(spark, folder)
    plain = decoded(F.col("content"))
    text = found.where("file_type in ('txt', 'md')").select("path", "file_name", "doc_id", "file_type", F.when(F.col("file_type") == "md", clean_markdown(plain)).otherwise(plain).alias("text"), F.lit(None).cast("string").alias("error"))
    office = found.where("file_type not in ('txt', 'md')").mapInPandas(lambda batches: _texts(batches, with_images), "path string, file_name string, doc_id string, file_type string, text string, error string, pages array<string>")
    joined = F.array_join(F.filter(F.transform("pages", lambda p, i: F.when((F.length(p) >= LEAST_PAGE) & ~is_toc_page(p), F.concat(page_mark(i + 1), p))), lambda p: p.isNotNull()), "\n\n")
    return text.unionByName(office.withColumn("text", F.coalesce("text", joined)).drop("pages"))


def picture(data: bytes) -> tuple[str, int, int]:
    """(format, width, height) by an image's first bytes; 0 where they do not say."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM":
        return "BMP", int.from_bytes(data[18:22], "little"), int.from_bytes(data[22:26], "little")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return "JPEG", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return "JPEG", 0, 0
    return "UNKNOWN", 0, 0


def _targets(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The files that a part of an office file names by its relationships."""
    folder, name = posixpath.split(part)
    where = f"{folder}/_rels/{name}.rels"
    if where not in book.namelist():
        return {}
    found = ElementTree.fromstring(book.read(where))
    return {r.get("Id"): posixpath.normpath(posixpath.join("/", folder, r.get("Target") or "")).lstrip("/") for r in found if r.get("TargetMode") != "External"}


def _docx_anchors(book: zipfile.ZipFile, content: bytes) -> Iterator[tuple[str, int | None, str | None, int | None]]:
    """(file, paragraph, null, null) of every picture drawn in a paragraph of the body; paragraphs as docx_paragraphs() numbers them when
    those of pictures alone stand."""
    targets = _targets(book, "word/document.xml")
    for i, (p, _) in enumerate(_body_paragraphs(content, True)):
        yield from ((targets[r], i, None, None) for r in _pictured(p) if r in targets)


def _xlsx_anchors(book: zipfile.ZipFile) -> Iterator[tuple[str, int | None, str | None, int | None]]:
    """(file, null, sheet, row from 0) of every picture that a sheet's drawing fixes to a cell."""
    sheets = _targets(book, "xl/workbook.xml")
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{S}sheet"):
        part = sheets.get(sheet.get(f"{R}id"), "")
        drawings = _targets(book, part) if part in book.namelist() else {}
        for drawing in (d for d in drawings.values() if "/drawings/" in d and d in book.namelist()):
            pictures_ = _targets(book, drawing)
            for anchor in ElementTree.fromstring(book.read(drawing)):
                row = anchor.find(f"{D}from/{D}row")
                yield from ((pictures_[r], None, sheet.get("name"), int(row.text) if row is not None else None) for r in _pictured(anchor) if r in pictures_)


def office_images(content: bytes) -> list[tuple]:
    """(null, name, format, width, height, data, paragraph, sheet, row) of the pictures in a DOCX or XLSX file: a row for each place where
    one is drawn, in the order of the file; pictures drawn nowhere come last, without a place."""
    book = zipfile.ZipFile(io.BytesIO(content))
    held = sorted(n for n in book.namelist() if re.match(r"(?:word|xl)/media/[^/]+$", n))
    anchors = list(_docx_anchors(book, content)) if "word/document.xml" in book.namelist() else list(_xlsx_anchors(book)) if "xl/workbook.xml" in book.namelist() else []
    placed = [a for a in anchors if a[0] in held]
    placed += [(n, None, None, None) for n in held if n not in {a[0] for a in placed}]
    return [(None, posixpath.basename(n), *picture(data), data, *place) for n, *place in placed for data in (book.read(n),)]


IMAGE = "path string, file_name string, doc_id string, file_type string, page_number int, image_index int, filename string, format string, width int, height int, paragraph_index int, sheet string, cell_row int, size_bytes long, digest string, content binary, error string"


def images(spark: SparkSession, folder: str) -> DataFrame:
    """The pictures of a folder's PDF, DOCX and XLSX files, a row each with their data; a bad file gives a row with its error. Written
    as a table they are the store's pictures."""
    names = [c.split()[0] for c in IMAGE.split(", ")]
    numbers = ("page_number", "image_index", "width", "height", "paragraph_index", "cell_row", "size_bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *known, kind, content in zip(*(pdf[c] for c in ("path", "file_name", "doc_id", "file_type", "content")), strict=True):
                rows = []
                try:
                    found = [(*i, None, None, None) for i in page_images(content)] if kind == "pdf" else office_images(content)
                    for i, (page, name, form, width, height, data, *place) in enumerate(found):
                        rows.append((*known, kind, page, i, name, form, width, height, *place, len(data), hashlib.md5(data).hexdigest(), data, None))
                except Exception as problem:  # one bad file must not end the load
                    rows = [(*known, kind, *(None,) * (len(names) - 5), f"{type(problem).__name__}: {problem}")]
                yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(numbers, "Int64"))

    return scan(spark, folder).where("file_type in ('pdf', 'docx', 'xlsx')").mapInPandas(run, IMAGE)


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_id, paragraph_index, text, style, level, indent) of a folder's DOCX files, those of pictures alone with their placeholder;
    a bad file gives no rows here, as images() and read() tell its error."""
    schema = "path string, doc_id string, paragraph_index int, text string, style string, level int, indent int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, doc_id, content in zip(pdf["path"], pdf["doc_id"], pdf["content"], strict=True):
                try:
                    rows += [(path, doc_id, *p) for p in docx_paragraphs(content, True)]
                except Exception:  # told by the readers of the file
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return scan(spark, folder).where("file_type = 'docx'").select("path", "doc_id", "content").mapInPandas(run, schema)


def picture_contexts(pictures_: DataFrame, paragraphs_: DataFrame, rows: DataFrame, distance: int = 2) -> DataFrame:
    """pictures (path, image_index, paragraph_index, sheet, cell_row) with context: of those in a document the texts of at most distance
    paragraphs before and after, of those in a workbook the lines of the rows at most distance away, their own with them; null where
    there is none. paragraphs: (path, paragraph_index, text); rows: (path, sheet, row_idx, line)."""
    about = paragraphs_.select("path", "paragraph_index", "text").where(F.col("text") != IMAGE_ONLY)
    drawn = near_rows(pictures_.where("paragraph_index is not null").select("path", "image_index", "paragraph_index"), about, "path", "paragraph_index", distance)
    told = drawn.where("n_paragraph_index <> paragraph_index").select("path", "image_index", F.col("n_paragraph_index").alias("at"), F.col("n_text").alias("said"))
    place = F.to_json(F.struct("path", "sheet")).alias("place")
    fixed = near_rows(pictures_.where("cell_row is not null").select("path", "image_index", "cell_row", place).withColumnRenamed("cell_row", "row_idx"), rows.select(place, "row_idx", "line"), "place", "row_idx", distance)
    lines = fixed.select("path", "image_index", F.col("n_row_idx").alias("at"), F.col("n_line").alias("said"))
    both = told.unionByName(lines).where(F.trim("said") != "").groupBy("path", "image_index").agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("held"))
    return pictures_.join(both.select("path", "image_index", F.array_join(F.transform("held", lambda h: h["said"]), "\n").alias("context")), ["path", "image_index"], "left")


def sheet_rows(cells_: DataFrame) -> DataFrame:
    """cells() as (path, sheet, row_idx, line): a row's values joined by bars."""
    held = cells_.where("row_idx is not null").groupBy("path", "sheet", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("held"))
    return held.select("path", "sheet", "row_idx", row_text(F.transform("held", lambda c: c["value"])).alias("line"))


def image_summary(found: DataFrame) -> DataFrame:
    """Counts, bytes and pictures above 1 MiB by file, page and format and as a whole, in one pass."""
    counts = [F.count("*").alias("images"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("size_bytes") > 2**20).alias("large")]
    return found.where("error is null").groupingSets([["file_name", "page_number"], ["format"], []], "file_name", "page_number", "format").agg(*counts)


def _bin(position: Column, width: float) -> Column:
    return F.floor(position / width).cast("bigint")


def _bins(first: Column, last: Column, width: float) -> Column:
    """A row for each bin from first to last; none where last is before first or one is null."""
    return F.explode(F.when(first <= last, F.sequence(_bin(first, width), _bin(last, width))))


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in rows.columns])


def near_rows(left: DataFrame, right: DataFrame, group: str, position: str, distance: float) -> DataFrame:
    """Rows of both tables in the same group at most distance apart; columns of right with the prefix n_. Rows meet by group and bin of
    positions, a right row in the at most three bins that it reaches, so one huge group is many tasks."""
    width, at = max(1.0, 2.0 * distance), F.col(f"n_{position}")
    other = _prefixed(right, "n_").withColumn("_bin", _bins(at - distance, at + distance, width))
    near = (F.col(group) == F.col(f"n_{group}")) & (F.col("_at") == F.col("_bin")) & (F.abs(F.col(position) - at) <= distance)
    return left.withColumn("_at", _bin(F.col(position), width)).join(other, near).drop("_at", "_bin")


def grouped_files(paths: DataFrame) -> DataFrame:
    """(file_type, n, files) of paths: names by type, files without a reader as unsupported."""
    kind = F.coalesce(file_type(F.col("path")), F.lit("unsupported"))
    return paths.groupBy(kind.alias("file_type")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.element_at(F.split("path", "/"), -1))).alias("files"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """grouped_files() of a folder. Contents are not read."""
    return grouped_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path"))


def in_range(spans: DataFrame, points: DataFrame, group: str, first: str, last: str, position: str, width: float = 1024.0) -> DataFrame:
    """Every span with each point of its group from first to last; columns of points with the prefix p_. A span is a row in each bin of
    width that it reaches and a point is in one, so a pair meets once and a huge group is many tasks; let width be about a span's length."""
    other = _prefixed(points, "p_").withColumn("_at", _bin(F.col(f"p_{position}"), width))
    held = spans.withColumn("_bin", _bins(F.col(first), F.col(last), width))
    inside = (F.col(group) == F.col(f"p_{group}")) & (F.col("_bin") == F.col("_at")) & F.col(f"p_{position}").between(F.col(first), F.col(last))
    return held.join(other, inside).drop("_at", "_bin")


def surroundings(rows: DataFrame, group: str, position: str, text: str, distance: int = 2, own: bool = False) -> DataFrame:
    """rows with context: the texts of at most distance rows before and after, with or without the row's own, blank ones left out."""
    order = Window.partitionBy(group).orderBy(position)
    before = F.collect_list(text).over(order.rowsBetween(-distance, 0 if own else -1))
    after = F.collect_list(text).over(order.rowsBetween(1, distance))
    return rows.withColumn("context", F.array_join(F.filter(F.concat(before, after), lambda t: F.trim(t) != ""), "\n\n"))


def dealt_images(images: DataFrame, group: str, position: str, paragraphs: Column) -> DataFrame:
    """images (ordered by position in a group) with paragraph: images in equal runs over the group's paragraphs, what is left to the last."""
    every = Window.partitionBy(group)
    each = F.greatest(F.lit(1), F.floor(F.count("*").over(every) / F.size(paragraphs)))
    nth = F.row_number().over(every.orderBy(position)) - 1
    at = F.least(F.floor(nth / each), F.size(paragraphs) - 1).cast("int")
    return images.withColumn("paragraph", F.get(paragraphs, at))


def unique_names(rows: DataFrame, base: str, ending: str, order: str, folder: str | None = None) -> DataFrame:
    """rows with name: base and ending where no row before has that name in the folder, else with the least number from 2 on between
    them that none has. Only bases that are alike up to their trailing numbers can meet: those of a folder stream through one task in
    order, as each name depends on the ones before; of them it holds the names given so far."""
    within = F.col(folder).cast("string") if folder else F.lit("")
    family = F.regexp_replace(F.col(base), r"(?:_[0-9]+)+$", "") if base in rows.columns else F.lit("")
    keys = ["_folder", "_family", "_ending"]
    laid = rows.withColumns({"_folder": within, "_family": family, "_ending": F.coalesce(F.col(ending), F.lit(""))}).repartition(*keys).sortWithinPartitions(*keys, order)
    held = laid.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *keys, F.coalesce(F.col(base), F.lit("")).alias("_base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, last = None, set(), {}
        for pdf in batches:
            names = []
            for key, own in zip(zip(*(pdf[k] for k in keys), strict=True), pdf["_base"], strict=True):
                if key != now:
                    now, taken, last = key, set(), {}
                name = own
                while name in taken:
                    last[own] = last.get(own, 1) + 1
                    name = f"{own}_{last[own]}"
                taken.add(name)
                names.append(name + key[2])
            yield pdf[["row"]].assign(name=names)

    schema = StructType([held.schema["row"], StructField("name", StringType())])
    return held.mapInPandas(run, schema).select("row.*", "name")


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, sheet, row_idx, col_idx, value, error, path) of a folder's workbooks; a sheet without cells has a row of nulls, a bad file its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, name, content in zip(pdf["path"], pdf["file_name"], pdf["content"], strict=True):
                try:
                    rows = [(name, *c, None, path) for c in xlsx_cells(content)]
                except Exception as problem:  # one bad file must not end the load
                    rows = [(name, None, None, None, None, f"{type(problem).__name__}: {problem}", path)]
                yield pd.DataFrame(rows, columns=["file_name", "sheet", "row_idx", "col_idx", "value", "error", "path"]).astype({"row_idx": "Int64", "col_idx": "Int32"})

    held = scan(spark, folder).where("file_type = 'xlsx'").select("path", "file_name", "content")
    return held.mapInPandas(run, "file_name string, sheet string, row_idx long, col_idx int, value string, error string, path string")


def sheet_info(cells: DataFrame) -> DataFrame:
    """cells (sheet, row_idx, col_idx, value): the rows and columns of each sheet that hold something, and whether there are none."""
    row, column = (F.when(F.trim("value") != "", F.col(c)) for c in ("row_idx", "col_idx"))
    return cells.groupBy("sheet").agg(F.countDistinct(row).alias("n_rows"), F.countDistinct(column).alias("n_columns"), (F.count(row) == 0).alias("is_empty"))


def pictures_of_chunks(chunks: DataFrame, pictures: DataFrame, group: str, key: str, places: str, place: str, picture: str) -> DataFrame:
    """chunks with pictures: those of the paragraphs that a chunk covers (the array places), in the order of place and picture."""
    held = pictures.select(F.col(group).alias("_group"), F.col(place).alias("_place"), F.col(picture).alias("_picture"))
    each = chunks.select(group, key, F.explode(F.array_distinct(places)).alias("_at"))
    found = each.join(held, (F.col(group) == F.col("_group")) & (F.col("_at") == F.col("_place")))
    listed_ = found.groupBy(group, key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_picture"))), lambda x: x["_picture"]).alias("pictures"))
    none = F.array().cast(listed_.schema["pictures"].dataType)
    return chunks.join(listed_, [group, key], "left").withColumn("pictures", F.coalesce("pictures", none))


def within_margin(pictures: DataFrame, blocks: DataFrame, group: str, margin: float = 50.0) -> DataFrame:
    """Every picture (top, bottom) with each block of its page that ends less than margin from the picture's top or begins less than
    margin from its bottom; the columns of blocks with the prefix n_, null where there is none. Pictures meet blocks by page and bin, once
    by each of their edges."""
    other, width = _prefixed(blocks, "n_"), max(1.0, 2.0 * margin)
    above, below = F.abs(F.col("n_bottom") - F.col("top")) < margin, F.abs(F.col("n_top") - F.col("bottom")) < margin

    def met(held: DataFrame, edge: str, reach: str, near: Column, how: str) -> DataFrame:
        at = F.col(f"n_{reach}")
        binned = other.withColumn("_bin", _bins(at - margin, at + margin, width))
        same = (F.col(group) == F.col(f"n_{group}")) & (F.col("_at") == F.col("_bin")) & near
        return held.withColumn("_at", _bin(F.col(edge), width)).join(binned, same, how).drop("_at", "_bin")

    over, under = met(pictures, "top", "bottom", above, "inner"), met(pictures, "bottom", "top", below & ~F.coalesce(above, F.lit(False)), "inner")
    alone = met(met(pictures, "top", "bottom", above, "left_anti"), "bottom", "top", below, "left_anti")
    return over.unionByName(under).unionByName(alone, allowMissingColumns=True)
