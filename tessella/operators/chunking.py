"""Lines to blocks, headings and breadcrumbs, greedy packing into chunks. A document is a row, so nothing here shuffles.

blocks(), headings() and breadcrumbs() are expressions, for use in queries; chunk_documents() goes over each document once, in Arrow
batches, with the same rules: folds over growing arrays would copy them for every line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.text import heading_level, indent_width, lines, setext_level, strip

MIN_TOKENS, MAX_TOKENS, INDENT_STEP, TAB = 300, 500, 4, 4
#: Fixed value: what begins and ends fenced code.
FENCE_MARK = "```"
_LINE = re.compile("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")
_PAGE = re.compile("\x1e([0-9]+)\x1e")
_SENTENCES, _BULLET, _NUMBERED, _PLAIN, _CHAPTER, _MARKED, _FENCE, _ROMAN_TITLE, _ROMAN, _COUNTED = (
    re.compile(p) for p in (T.SENTENCE_END, T.BULLET, T.NUMBERED, T.PLAIN_TITLE, T.CHAPTER_TITLE, T.MARKED_TITLE, T.FENCE, T.ROMAN_TITLE, T.ROMAN, T.COUNTED_TITLE)
)
CHUNK = "chunk_index int, content string, token_count int, breadcrumbs array<string>, block_indices array<int>, indent_levels array<int>, page_from int, page_to int"


def blocks(text: Column, step: int = INDENT_STEP) -> Column:
    """array of (block_index, indent, text): a blank line ends a block, a line whose indent differs by step or more from the block's
    first line begins one."""
    kind = "array<struct<indent:int,text:string>>"
    empty = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<indent:int,text:string>").alias("open"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def fold(acc: Column, line: Column) -> Column:
        new = F.struct(indent_width(line).alias("indent"), line.alias("text"))
        more = F.struct(acc["open"]["indent"].alias("indent"), F.concat_ws("\n", acc["open"]["text"], line).alias("text"))
        none = F.lit(None).cast("struct<indent:int,text:string>")
        return (
            F.when(line.rlike(r"^\s*$"), F.struct(closed(acc).alias("done"), none.alias("open")))
            .when(acc["open"].isNull() | (F.abs(indent_width(line) - acc["open"]["indent"]) >= step), F.struct(closed(acc).alias("done"), new.alias("open")))
            .otherwise(F.struct(acc["done"].alias("done"), more.alias("open")))
        )

    return F.transform(F.aggregate(lines(text), empty, fold, closed), lambda b, i: F.struct(i.alias("block_index"), b["indent"].alias("indent"), b["text"].alias("text")))


def headings(blocks_: Column, rules: str = "txt") -> Column:
    """The first heading of each block that has one: (block_index, level, text). In md an underlined line is one, whatever it is else."""
    def level(held: Column, x: Column, i: Column) -> Column:
        plain = heading_level(x, rules)
        under = setext_level(x, F.get(held, i + 1))
        return F.when(under > 0, under).otherwise(plain) if rules == "md" else plain

    def first(b: Column) -> Column:
        every = F.transform(F.array(lines(b["text"])), lambda held: F.transform(held, lambda x, i: F.struct(b["block_index"].alias("block_index"), level(held, x, i).alias("level"), strip(x).alias("text"))))[0]
        return F.slice(F.filter(every, lambda h: h["level"] > 0), 1, 1)

    return F.flatten(F.transform(blocks_, first))


def breadcrumbs(headings_: Column, block_index: Column) -> Column:
    """The headings above a block: each new one ends those of its level or deeper."""
    before = F.filter(headings_, lambda h: h["block_index"] < block_index)
    kind = "array<struct<level:int,text:string>>"
    stack = F.aggregate(before, F.array().cast(kind), lambda acc, h: F.concat(F.filter(acc, lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["text"].alias("text")))))
    return F.transform(stack, lambda x: x["text"])


def line_level(line: str, rules: str = "txt") -> int:
    """heading_level() of one line."""
    t = line.strip()
    marks, short = _MARKED.match(t), len(t) < 80 and not t.endswith(".")
    if rules == "md":
        if len(t) < 2 or marks:
            return len(marks.group(1)) if marks and len(t) >= 2 else 0
        roman, counted = _ROMAN_TITLE.match(t), _COUNTED.match(t)
        if roman and _ROMAN.match(roman.group(1)):
            return 1
        if counted:
            return min(6, counted.group(1).count(".") + 2)
        if short and t.isupper():
            return 2
    elif rules == "docx" and marks:  # the style's level, which stands before every pattern
        return len(marks.group(1))
    elif len(t) < 3:
        return 0
    elif _NUMBERED.match(t):
        return 1
    if _PLAIN.match(t):
        return 1
    if _CHAPTER.match(t):
        return 2 if len(t) < 50 else 3
    if rules == "txt":
        if short and not t.endswith(",") and (t.isupper() or t.istitle()):
            return 2
        if len(t) >= T.FENCED_LENGTH and _FENCE.match(t) and _FENCE.fullmatch(t[-3:]):
            return 1
        return len(marks.group(1)) if marks else 0
    return 0


def _first_heading(text: str, rules: str) -> tuple[int, str] | None:
    held = text.split("\n")
    for line, after in zip(held, [*held[1:], ""], strict=True):
        under = after.strip()
        if rules == "md" and line.strip() and under and under in ("=" * len(under), "-" * len(under)):
            return (1 if under[0] == "=" else 2, line.strip())
        if level := line_level(line, rules):
            return level, line.strip()
    return None


def _blocks(text: str) -> list[tuple[int, str]]:
    """blocks() of one text: (indent, text) each."""
    out: list[tuple[int, list[str]]] = []
    fresh = True
    for line in _LINE.split(text):
        if not line or line.isspace():
            fresh = True
            continue
        lead = line[: len(line) - len(line.lstrip("\t "))]
        indent = len(lead.replace("\t", " " * TAB))
        if fresh or abs(indent - out[-1][0]) >= INDENT_STEP:
            out.append((indent, [line]))
        else:
            out[-1][1].append(line)
        fresh = False
    return [(indent, "\n".join(held)) for indent, held in out]


def tokens(text: str) -> int:
    return max(1, len(text.split()))


def _parts(text: str, fences: bool) -> Iterator[str]:
    """The lines of a block, whole where they are bullets or, with fences, code between lines that begin with ```; others by sentence."""
    code = False
    for line in filter(str.strip, _LINE.split(text)):
        fence = fences and line.lstrip().startswith(FENCE_MARK)
        code ^= fence
        if fence or code or _BULLET.match(line):
            yield line.rstrip()
        else:
            yield from filter(None, map(str.strip, _SENTENCES.split(line)))


def split_block(text: str, least: int = MIN_TOKENS, most: int = MAX_TOKENS, fences: bool = False) -> list[str]:
    """Pieces of an oversized block: bullets and, with fences, lines of fenced code stay whole, other lines go by sentence; parts join
    while they stay within most. A part above most goes with what stands before it where that is below least, else alone; nothing is lost.
    A last piece that fits the one before joins it."""
    parts = list(_parts(text, fences))
    out: list[list[str]] = []
    sizes: list[int] = []
    joins = False
    for part in parts:
        n = tokens(part)
        if joins and (sizes[-1] + n <= most or (n > most and sizes[-1] < least)):
            out[-1].append(part)
            sizes[-1] += n
        else:
            out.append([part])
            sizes.append(n)
        joins = n <= most
    if len(out) > 1 and joins and sizes[-2] + sizes[-1] <= most:
        out[-2] += out.pop()
    return ["\n".join(p) for p in out]


def pack(sizes: list[int], least: int = MIN_TOKENS, most: int = MAX_TOKENS, pieces: list[bool] | None = None) -> list[list[int]]:
    """Groups of neighbours: a unit joins while the sum stays within most. A unit of least or more that began a group because it did not
    fit ends it at once; pieces of a split block end a group as soon as it has least. Nothing is dropped or reordered."""
    groups: list[list[int]] = []
    total, joins = 0, False
    for i, n in enumerate(sizes):
        fits, piece = total + n <= most, bool(pieces and pieces[i])
        if joins and fits:
            groups[-1].append(i)
            total += n
            joins = not (piece and total >= least)
        else:
            groups.append([i])
            joins = n < least or (fits and not joins and not piece)
            total = n
        total = total if joins else 0
    return groups


def grouped(rows: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """rows (doc_id, sizes) as doc_id, chunk_index, units, tokens: how pack() groups each document's units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [(d, k, len(g), sum(int(s[i]) for i in g)) for d, s in zip(pdf["doc_id"], pdf["sizes"], strict=True) for k, g in enumerate(pack(list(s), least, most))]
            yield pd.DataFrame(held, columns=["doc_id", "chunk_index", "units", "tokens"])

    return rows.select("doc_id", "sizes").mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, chunk_index int, units long, tokens long")


def pack_sheets(sizes: list[int], least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> list[list[int]]:
    """Groups of a workbook's sheets, none of them split: a group ends before a sheet that would pass most, once it has least."""
    groups: list[list[int]] = []
    total = 0
    for i, n in enumerate(sizes):
        if not groups or (total + n > most and total >= least):
            groups.append([i])
            total = n
        else:
            groups[-1].append(i)
            total += n
    return groups


def chunks_of(text: str, rules: str = "txt", sheets: bool = False, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> Iterator[tuple]:
    """The chunks of one text, in the order of CHUNK's fields. The headings before a chunk's first block are its breadcrumbs: each new one
    ends those of its level or deeper."""
    page, units, stack = None, [], []  # units: (block, indent, page, headings above, text, whether a piece)
    found = _blocks(text)
    for i, (indent, block) in enumerate(found):
        if mark := _PAGE.fullmatch(block.strip(" ")):
            page = int(mark.group(1))
            continue
        above = [t for _, t in stack]
        split = not sheets and tokens(block) > most
        units += [(i, indent, page, above, p, split) for p in (split_block(block, least, most, rules == "md") if split else [block])]
        if not sheets and len(found) > 1 and (head := _first_heading(block, rules)):
            stack = [h for h in stack if h[0] < head[0]] + [head]
    sizes = [tokens(u[4]) for u in units]
    groups = pack_sheets(sizes, least, most) if sheets else pack(sizes, least, most, [u[5] for u in units])
    for k, group in enumerate(groups):
        held = [units[i] for i in group]
        above, body = held[0][3], "\n".join(u[4] for u in held).strip("\n")
        content = f"[Context: {' > '.join(above)}]\n\n{body}" if above else body
        yield k, content, tokens(content), above, sorted({u[0] for u in held}), sorted({u[1] for u in held}), held[0][2], held[-1][2]


def chunk_documents(docs: DataFrame, rules: str = "txt", least: int = MIN_TOKENS, most: int = MAX_TOKENS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text and the columns of keep) as chunks with breadcrumbs and those columns; documents stream through, each on its own. A
    column file_type, where docs has one, decides by row: md takes the Markdown rules for headings, pdf its own, docx those of pdf after its styles, xlsx packs whole
    sheets. Page marks become page_from and page_to."""
    kind = F.coalesce("file_type", F.lit("")) if "file_type" in docs.columns else F.lit("")
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), CHUNK])
    names = [*keep, *(c.split()[0] for c in CHUNK.split(", "))]
    by_kind = {"md": "md", "docx": "docx", "pdf": "pdf"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = zip(*(pdf[f"_{i}"] for i in range(len(keep))), strict=True)
            rows = [(*k, *c) for k, sort, text in zip(kept, pdf["_kind"], pdf["_text"], strict=True) for c in chunks_of(text or "", by_kind.get(sort, rules), sort == "xlsx", least, most)]
            yield pd.DataFrame(rows, columns=names).astype({"page_from": "Int32", "page_to": "Int32"})

    held = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], kind.alias("_kind"), F.col("text").alias("_text"))
    return held.mapInPandas(run, schema)
