"""Pages and pictures by address, through a fetcher that the caller gives: addresses are rows, fetched where they lie.

A fetcher takes an address and returns (status, headers, body), redirects not followed; an error of one address is a value of its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import html as H
from tessella.functions import text as T
from tessella.sources.files import unique_names
from tessella.sources.pdf import page_texts

Fetcher = Callable[[str], tuple[int, dict[str, str], bytes]]
#: Redirects that are followed, and bytes of a picture that are kept.
MOST_STEPS, MOST_BYTES = 10, 25 * 2**20


def is_pdf(url: Column, content_type: Column) -> Column:
    return F.lower(url).endswith(".pdf") | F.lower(F.coalesce(content_type, F.lit(""))).contains("application/pdf")


def followed(url: str, fetcher: Fetcher, most: int = MOST_STEPS) -> tuple[int, str, list[str], dict[str, str], bytes]:
    """(status, last address, the addresses before it, headers by lower-case name, body)."""
    chain: list[str] = []
    while True:
        status, headers, body = fetcher(url)
        low = {k.lower(): v for k, v in headers.items()}
        if status not in (301, 302, 303, 307, 308) or "location" not in low:
            return status, url, chain, low, body
        chain.append(url)
        url = urljoin(url, low["location"])
        if url in chain or len(chain) > most:
            raise ValueError(f"redirects do not end: {url}")


def fetch(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """urls (url) with status, final_url, redirects, content_type, body, error; each distinct address is fetched once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    status, final, chain, headers, body = followed(url, fetcher)
                    rows.append((url, status, final, chain, headers.get("content-type"), body, None))
                except Exception as problem:  # one bad address must not end the load
                    rows.append((url, None, None, None, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["url", "status", "final_url", "redirects", "content_type", "body", "error"]).astype({"status": "Int32"})

    distinct = urls.select("url").where("url is not null").distinct()
    return distinct.mapInPandas(run, "url string, status int, final_url string, redirects array<string>, content_type string, body binary, error string")


def pages(fetched: DataFrame) -> DataFrame:
    """(page_id, url, html) of what was fetched as a page: page_id numbers by a hash of the address."""
    kept = fetched.where(F.col("error").isNull() & ~is_pdf(F.col("final_url"), F.col("content_type")))
    return kept.select(F.xxhash64("url").alias("page_id"), F.col("final_url").alias("url"), F.decode("body", "UTF-8").alias("html"))


def pdf_texts(fetched: DataFrame) -> DataFrame:
    """(url, text, error) of what was fetched as a PDF: its pages, cleaned, up to the references."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, body in zip(pdf["url"], pdf["body"], strict=True):
                try:
                    rows.append((url, "\n\n".join(page_texts(bytes(body))), None))
                except Exception as problem:  # one bad file must not end the load
                    rows.append((url, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["url", "text", "error"])

    kept = fetched.where(F.col("error").isNull() & is_pdf(F.col("final_url"), F.col("content_type"))).select("url", "body")
    return kept.mapInPandas(run, "url string, text string, error string").withColumn("text", T.without_references(T.clean_whitespace(F.col("text"))))


def download(found: DataFrame, fetcher: Fetcher, most_bytes: int = MOST_BYTES) -> DataFrame:
    """found (page_id, image_urls): each picture with a name unique in its page's folder, its content and digest. A picture above
    most_bytes, not an image, or not fetched has its error and no content."""
    each = found.select("page_id", F.posexplode("image_urls").alias("nth", "url"))
    got = fetch(each.select("url"), fetcher)
    ending = T.image_ending(F.coalesce("content_type", F.lit("")))
    error = F.coalesce("error", F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))), F.when(ending == "", "not an image"), F.when(F.length("body") > most_bytes, "too large"))
    held = each.join(got, "url").withColumns({"ending": ending, "error": error})
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1), r"\.[^.]*$", "")
    base = T.file_base(name)
    named = held.withColumn("base", base).select("page_id", "nth", "base", "ending")
    named = unique_names(named, "base", "ending", "nth", "page_id").select("page_id", "nth", "name")
    content = F.when(F.col("error").isNull(), F.col("body"))
    return held.join(named, ["page_id", "nth"]).select("page_id", "nth", "url", "name", content.alias("content"), F.md5(content).alias("digest"), "error")


def site_report(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """What each address leads to: status, redirects and, for pages, what H.report() says of them."""
    got = fetch(urls, fetcher)
    known = H.report(pages(got)).drop("url")
    return got.withColumn("page_id", F.xxhash64("url")).join(known, "page_id", "left").drop("body", "page_id")
