"""HTML to Markdown, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .tables import table

# Elements that carry no content, and those that start a new block.
DROPPED = {"script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "form", "input", "button", "select", "textarea", "nav", "header", "footer", "aside", "head"}
VOID = {"input", "embed"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "figure"}
LEAST_MAIN = 500


class _Writer(HTMLParser):
    def __init__(self, only: str | None = None):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.only, self.inside, self.links = 0, only, 0, []

    def put(self, text: str) -> None:
        if not self.skip and (not self.only or self.inside):
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == self.only:
            self.inside += 1
        if tag in DROPPED:
            self.skip += tag not in VOID
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.put("\n- ")
        elif tag == "br":
            self.put("\n")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.put("[")
        elif tag in BLOCKS:
            self.put("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - (tag not in VOID))
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "a" and self.links:
            self.put(f"]({self.links.pop()})")
        elif tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            self.put("\n\n")
        if tag == self.only:
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data: str) -> None:
        self.put(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str | None:
    """Content of <main> where that has at least LEAST_MAIN characters, else of the page; at most one blank line in a row."""
    if html is None:
        return None
    for only in ("main", None):
        if only and "<main" not in html.lower():
            continue
        writer = _Writer(only)
        writer.feed(html)
        writer.close()
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(writer.out))).strip()
        if not only or len(text) >= LEAST_MAIN:
            return text
    return ""


def markdown(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([to_markdown(h) for h in part.column("html").to_pylist()], pa.string())], ["page_id", "markdown"])

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(run, "page_id long, markdown string")


def q_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(table(spark, sf_dir, "pages"))


def q_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html").cast("long")).alias("chars"))


QUERIES = {"a19_html_to_markdown": q_markdown, "a19_pages_by_host": q_hosts}
ORACLES = {"a19_pages_by_host": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1"}
