"""Text functions as Column expressions: tokens, sentences, cleaning, headings, URLs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_tokenizers: dict = {}

#: Marks that end a sentence, patterns of bullets and headings. Java, Python and RE2 read them alike: a hyphen comes first in
#: its class, where none takes it for a range, and case is ignored by a flag, as the patterns are also used within SQL.
SENTENCE_END = r"(?<=[.?!…])\s+"
BULLET = r"^\s*(?:[-*•]|[0-9]+[.)])\s+"
NUMBERED = r"^\s*(?:[0-9]+\.)+\s+\S"
#: What the heading classifiers accept, apart by form: an item's number or letter before a capital, a line that starts with a
#: capital and has no end mark, a chapter or section with its number.
ENUMERATED_TITLE = r"^\s*(?:[0-9]+(?:\.[0-9]+)*[.)]?|[A-Z]+[.)])\s+[A-Z][^.]*$"
PLAIN_TITLE = r"^\s*[A-Z][^.!?]*[^.!?\s]$"
CHAPTER_TITLE = r"(?i)^\s*(?:chapter|section)\s+(?:[0-9]+|[ivxlcdm]+)(?:(?:[.:-]\s*|\s+)[^.!?]+[^.!?\s])?$"
MARKED_TITLE = r"^(#{1,6})\s+\S"
FENCED_TITLE = r"^[=\-#*]{3,}\s*.+\s*[=\-#*]{3,}$"
ROMAN_TITLE = r"^([IVXLCDM]+)[.\s]+."
ROMAN = r"^(?=.)M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"
COUNTED_TITLE = r"^([0-9]+(?:\.[0-9]+)*)[.)\s]+."
#: The same for Java's regex, which repeats a plain group by recursion: possessive, as nothing that may follow a repetition is part of it.
NUMBERED_ONCE = r"^\s*(?:[0-9]++\.)++\s+\S"
ENUMERATED_ONCE = r"^\s*(?:[0-9]+(?:\.[0-9]++)*+[.)]?|[A-Z]+[.)])\s+[A-Z][^.]*$"
#: The two ends of a fenced title, which is at least two fences and a character long.
FENCE, FENCED_LENGTH = r"[=\-#*]{3}", 7
TOC_TITLES = ("table of contents", "mục lục")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def token_count(text: Column, mode: str = "words") -> Column:
    """words: white-space words, at least 1; chars4: a quarter of the characters, at least 1."""
    if mode == "chars4":
        return F.greatest(F.lit(1.0), F.length(text) / 4)
    return F.greatest(F.lit(1), F.size(words(text)))


def bpe_count(path: str) -> Callable[[Column], Column]:
    """A counter of a byte-pair tokenizer's tokens, at least 1; path: the tokenizer's file, which every executor can read."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if path not in _tokenizers:
            from tokenizers import Tokenizer

            _tokenizers[path] = Tokenizer.from_file(path)
        return pd.Series([max(1, len(e.ids)) for e in _tokenizers[path].encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return count


def bm25_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words without punctuation; stopwords are left out one by one, so repeats keep their number."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w++"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stopwords)) if stopwords else found


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, r"\R")


def clean_whitespace(text: Column) -> Column:
    """LF line ends, at most one blank line, single spaces in trimmed lines, no archive or retrieval notes."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n")
    tidy = F.transform(F.split(unix, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.trim(F.array_join(F.filter(tidy, lambda x: ~x.rlike("^(?:Archived from the original|Retrieved)")), "\n"))


def fix_linebreaks(text: Column, closing: bool = True) -> Column:
    """Words split at a line's end are joined, single line breaks become spaces, spaces before punctuation go."""
    joined = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    flowed = F.regexp_replace(joined, r"(?<!\n)\n(?!\n)", " ")
    return F.regexp_replace(F.regexp_replace(flowed, "[ \t]{2,}", " "), rf" +([,.;:!?{')' if closing else ''}])", "$1")


def normalize_ws(text: Column) -> Column:
    """fix_linebreaks without closing brackets; then at most one blank line, no white space at the ends."""
    return strip(F.regexp_replace(fix_linebreaks(F.regexp_replace(text, "\r\n?", "\n"), closing=False), r"\n{3,}", "\n\n"))


def strip_citations(text: Column) -> Column:
    """Numbers in brackets go with the white space before them; '^' and '(link)' become a space; white space of two or more is one space."""
    for pattern, by in ((r"(?U)\s*\[\d+\]", ""), (r"(?U)\s*\^\s*", " "), (r"(?Ui)\s*\(link\)\s*", " "), (r"(?U)\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, by)
    return text


def without_references(text: Column) -> Column:
    """A text up to the first line that names references alone."""
    return F.split(text, r"(?i)\n(?:References|Bibliography|Notes|Footnotes)\n", 2)[0]


def clean_markdown(text: Column) -> Column:
    """Images of all three notations go, then runs of blank lines."""
    for pattern in (r"!\[[^\]]*\]\([^)]*\)", r"!\[[^\]]*\]\[[^\]]*\]", r"(?i)<img[^>]*>"):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(r"(?<=[\p{Lu}\p{Ll}\p{Lt}])[\p{Lu}\p{Lt}]|(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")


def is_heading_like(line: Column) -> Column:
    """Whether a line has the form of a heading at all: enumerated, capitalised without an end mark, or a numbered chapter."""
    return line.rlike(ENUMERATED_ONCE) | line.rlike(PLAIN_TITLE) | line.rlike(CHAPTER_TITLE)


def is_fenced(title: Column) -> Column:
    """FENCED_TITLE of one line, by its ends: the pattern itself tries every length of both fences."""
    return title.rlike(f"^{FENCE}") & title.rlike(f"{FENCE}$") & (F.length(title) >= FENCED_LENGTH)


def counted_dots(title: Column) -> Column:
    """Dots in the number that COUNTED_TITLE finds, -1 where it finds none: of dotted numbers without a mark or space behind them, the last
    dot is the mark."""
    run = r"^[0-9]++(?:\.[0-9]++)*+"
    number = F.regexp_extract(title, run, 0)
    dots = F.length(number) - F.length(F.replace(number, F.lit(".")))
    return F.when(title.rlike(rf"{run}[.)\s]+."), dots).otherwise(dots - 1)


def heading_level(line: Column, rules: str = "txt") -> Column:
    """0 for no heading, else its level; the first rule that holds decides.

    pdf, from three characters on: dotted numbers 1, capitalised lines without an end mark 1, chapters and sections 2 (3 from 50
    characters on). docx: '#' marks, which stand for styles, by their number, then as pdf. txt: as pdf, then short capitals or title case 2, fenced titles 1, '#' marks by their number. md, from two characters
    on: '#' marks by their number, Roman numerals 1, numbers by their dots from 2 to 6, short capitals 2, then capitalised lines and
    chapters as pdf."""
    t = strip(line)
    marks = F.length(F.regexp_extract(t, MARKED_TITLE, 1))
    short = (F.length(t) < 80) & ~F.endswith(t, F.lit("."))
    chapter = F.when(F.length(t) < 50, 2).otherwise(3)
    if rules == "md":
        roman, dots = F.regexp_extract(t, ROMAN_TITLE, 1), counted_dots(t)
        level = F.when(F.length(t) < 2, 0).when(marks > 0, marks).when(roman.rlike(ROMAN), 1).when(dots >= 0, F.least(F.lit(6), dots + 2)).when(is_upper(t) & short, 2)
        return level.when(t.rlike(PLAIN_TITLE), 1).when(t.rlike(CHAPTER_TITLE), chapter).otherwise(0)
    styled = F.when(marks > 0, marks) if rules == "docx" else F
    level = styled.when(F.length(t) < 3, 0).when(t.rlike(NUMBERED_ONCE), 1).when(t.rlike(PLAIN_TITLE), 1).when(t.rlike(CHAPTER_TITLE), chapter)
    if rules == "txt":
        level = level.when(short & ~F.endswith(t, F.lit(",")) & (is_upper(t) | is_title(t)), 2).when(is_fenced(t), 1).when(marks > 0, marks)
    return level.otherwise(0)


def setext_level(line: Column, following: Column) -> Column:
    """The level of a line that the following one underlines: 1 by '=', 2 by '-'; else 0."""
    full = line.rlike(r"\S")
    return F.when(full & following.rlike(r"^\s*=+\s*$"), 1).when(full & following.rlike(r"^\s*-+\s*$"), 2).otherwise(0)


def indent_width(line: Column, tab: int = 4) -> Column:
    return F.length(F.replace(F.regexp_extract(line, r"^[\t ]*", 0), F.lit("\t"), F.lit(" " * tab)))


def is_toc_page(text: Column) -> Column:
    """A contents page: titled so near its start, or many of its lines end in page numbers, fewer where others have dot leaders."""
    full = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")

    def judged(full: Column) -> Column:
        n = F.size(full)
        ends = F.size(F.filter(full, lambda x: (F.length(x) > 15) & x.rlike(r"\s[0-9]{1,4}$")))
        dots = F.size(F.filter(full, lambda x: F.length(x) - F.length(F.replace(x, F.lit("."))) >= 8))
        titled = F.exists(F.slice(full, 1, 15), lambda x: F.lower(x).rlike("|".join(TOC_TITLES)))
        return (n >= 5) & (titled | ((ends / n > 0.2) & (dots / n > 0.1)) | (ends / n > 0.4))

    return F.transform(F.array(full), judged)[0]


def url_folder(url: Column) -> Column:
    """Host and path as a folder name of at most 150 characters."""
    joined = F.concat(F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit("")), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))
    return F.left(F.regexp_replace(F.regexp_replace(joined, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), F.lit(150))


def docs_suffix(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/docs/(.*)", 1)


def techdocs_url(url: Column) -> Column:
    """The static page behind a documentation URL with at least three segments after docs; else null."""
    segments = F.filter(F.split(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)

    def page(held: Column) -> Column:
        at = F.array_position(held, "docs").cast("int")
        named = F.array_join(F.slice(held, at + 1, F.lit(3)), "/")
        return F.when((at > 0) & (F.size(held) >= at + 3), F.concat(host, F.lit("/api/techdocs/static/docs/"), named, F.lit("/index.html")))

    return F.transform(F.array(segments), page)[0]


def cookie_names(header: Column) -> Column:
    """The distinct names that a Set-Cookie header gives, first seen first."""
    each = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda p: F.regexp_extract(p, r"^\s*([^=;\s]+)=", 1))
    return F.array_distinct(F.filter(each, lambda n: n != ""))


#: Endings of image files by their content type.
IMAGE_ENDINGS = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif",
    "image/svg+xml": ".svg", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico",
}


def image_ending(content_type: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in IMAGE_ENDINGS.items() for x in pair])
    return F.coalesce(F.element_at(kinds, F.trim(F.substring_index(F.lower(content_type), ";", 1))), F.lit(""))


def file_base(name: Column) -> Column:
    """A name of ASCII letters, digits, '_' and '-'; image where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "image").otherwise(bare)


def row_text(values: Column) -> Column:
    """A table row's cells joined by bars; null and blank cells are left out."""
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), " | ")


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def roman_value(text: Column) -> Column:
    """The value of a Roman numeral; 0 where another letter occurs."""
    value = F.create_map(*[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair])
    digits = F.transform(F.filter(F.split(F.reverse(F.upper(text)), ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(value, c), F.lit(-1)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))
    total = F.aggregate(digits, start, lambda a, d: F.struct((a["sum"] + F.when(d < a["most"], -d).otherwise(d)).alias("sum"), F.greatest(a["most"], d).alias("most")), lambda a: a["sum"])
    return F.when(F.exists(digits, lambda d: d < 0), 0).otherwise(total)


def page_mark(number: Column) -> Column:
    """A line of its own that says which page follows; chunks take their pages from it and leave it out."""
    return F.concat(F.lit("\x1e"), number.cast("string"), F.lit("\x1e\n\n"))


def page_range(first: Column, last: Column) -> Column:
    return F.when(first.isNull() | last.isNull(), None).when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))


def with_context(payload: Column, breadcrumbs: Column) -> Column:
    return F.when(F.size(breadcrumbs) > 0, F.concat(F.lit("[Context: "), F.array_join(breadcrumbs, " > "), F.lit("]\n\n"), payload)).otherwise(payload)


def answer_and_urls(text: Column) -> Column:
    """(text, urls) of an answer that ends in a list of quoted links."""
    listed = F.regexp_extract(text, r"(?s)\[\s*['\"]https?://[^\]]*\]\s*$", 0)
    return F.struct(F.trim(F.left(text, F.length(text) - F.length(listed))).alias("text"), F.regexp_extract_all(listed, F.lit(r"https?://[^'\"\s,\]]+"), F.lit(0)).alias("urls"))


def questions(text: Column, defaults: list[str], most: int = 4) -> Column:
    """The distinct questions or list items of a reply, without their marks, filled up from the defaults."""
    listed = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.rlike(r"\?|^[0-9]+[.)]|^[-*•]"))
    bare = F.filter(F.transform(listed, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[0-9]+[.)]\s*", ""), r"[-*•]", ""))), lambda x: x != "")
    kept = F.slice(F.array_distinct(bare), 1, most)
    return F.concat(kept, F.slice(F.array(*map(F.lit, defaults)), F.size(kept) + 1, F.greatest(F.lit(0), F.lit(most) - F.size(kept))))


def route(reply: Column) -> Column:
    """Where a validator's reply sends a question: its first word, or unknown."""
    return F.coalesce(*[F.when(reply.startswith(p), p.lower()) for p in ("VALID", "IRRELEVANT", "SUGGESTION")], F.lit("unknown"))
