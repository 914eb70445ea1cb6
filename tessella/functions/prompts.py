"""Prompt texts with named places, filled strictly: a place without a value makes the whole prompt empty."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

PROMPTS = {
    "answer": "Answer the question from the passages alone. If they do not hold the answer, say so.\n\nPassages:\n$contents\n\nQuestion: $question\nEnd with the image links of the passages you used, as a list of quoted links.",
    "summary": "Summarise the document $file_name in a few sentences, naming its subjects.\n\n$contents",
    "suggest": "Write $most questions that these summaries can answer, one a line.\n\n$summaries",
    "validate": "Summaries of the documents at hand:\n$summaries\n\nQuestion: $question\nReply VALID: and its key words where the documents can answer it, SUGGESTION: and a better question where it is unclear, else IRRELEVANT: and why.",
    "plan": "Split the request into steps, one a line, each with what it needs.\n\nRequest: $question",
    "combine": "Combine the partial answers into one.\n\nQuestion: $question\n\nPartial answers:\n$contents",
}


def places(template: str) -> list[str]:
    """The names of a template's places, first seen first."""
    return list(dict.fromkeys(m.group("named") or m.group("braced") for m in string.Template.pattern.finditer(template) if m.group("named") or m.group("braced")))


def render(name: str, **values: object) -> str:
    """A prompt with its values; empty where a value is missing or no such prompt exists."""
    try:
        return string.Template(PROMPTS[name]).substitute(values)
    except (KeyError, ValueError):
        return ""


def rendered(template: str, **values: Column) -> Column:
    """A template filled by row; empty where a value is null or no column is given for a place."""
    if set(places(template)) - set(values):
        return F.lit("")
    out, at = [], 0
    for m in string.Template.pattern.finditer(template):
        if m.group("invalid") is not None:
            return F.lit("")
        out += [F.lit(template[at : m.start()]), F.lit("$") if m.group("escaped") else values[m.group("named") or m.group("braced")].cast("string")]
        at = m.end()
    return F.coalesce(F.concat(*out, F.lit(template[at:])), F.lit(""))
