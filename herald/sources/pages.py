"""Fetched pages: notices, links, attachments and visible text from HTML, one Arrow job over the page table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herald.functions.text import ZONE, clean_title
from herald.functions.urls import official_host

# --- Fixed values -------------------------------------------------------------
DATE = re.compile(r"\b\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}\b")
NOTICE_PATH = re.compile(r"/Thongbao/id/(\d+)", re.IGNORECASE)
STOP_MARKERS = ("CÁC THÔNG TIN KHÁC", "TUYỂN SINH & ĐÀO TẠO", "CÁC LIÊN KẾT KHÁC")
ATTACHMENT_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip")
ATTACHMENT_HOSTS = ("drive.google.com", "docs.google.com")
MEDIA_TYPES = ("text/html", "text/plain", "application/xhtml+xml")
MOST_BYTES, MOST_CHARS = 2 * 1024 * 1024, 24_000
LIST_CONTAINER = ("wd-list-content", "wd-list-report")
# ------------------------------------------------------------------------------
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "noscript"}


class _Events(HTMLParser):
    """The page as events in document order: ("open", tag, attributes, path), ("text", data, tag)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set[str]]] = []
        self.events: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        inside = [c for _, c in self.stack]
        self.events.append(("open", tag, a, inside))
        if tag not in _VOID:
            self.stack.append((tag, set(a.get("class", "").split())))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.events.append(("open", tag, {k: v or "" for k, v in attrs}, [c for _, c in self.stack]))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                self.events.append(("close", tag))
                return

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, {t for t, _ in self.stack}))


def events_of(html: str) -> list[tuple]:
    parser = _Events()
    parser.feed(html)
    parser.close()
    return parser.events


def _clean(text: str) -> str:
    return " ".join(text.split())


def parse_page(html: str, url: str) -> dict:
    """Title, date, text and links of one page.

    The first text with a date and time is the anchor. The heading before it,
    else the page title, names the notice; what follows it up to a stop
    marker, without the title, bare dates and repeats of the line before, is
    its text. Under 20 characters only the title is left.
    """
    events = events_of(html)
    anchor = next((i for i, e in enumerate(events) if e[0] == "text" and DATE.search(e[1])), None)
    heading, page_title, within = "", [], []
    for i, e in enumerate(events):
        if e[0] == "open" and e[1] in ("h1", "h2", "h3") and anchor is not None and i < anchor:
            within, heading = [e[1]], ""
        elif e[0] == "close" and within and e[1] == within[0]:
            within = []
        elif e[0] == "text":
            if within and (anchor is None or i < anchor):
                heading = f"{heading} {e[1]}"
            if "title" in e[2]:
                page_title.append(e[1])
    title = _clean(heading) if anchor is not None and _clean(heading) else (_clean(" ".join(page_title)) or "Untitled notice")
    lines: list[str] = []
    for e in events[anchor:] if anchor is not None else []:
        if e[0] != "text" or e[2] & _HIDDEN:
            continue
        text = _clean(e[1])
        if any(m in text.upper() for m in STOP_MARKERS):
            break
        if text and text != title and not DATE.fullmatch(text) and not (lines and lines[-1] == text):
            lines.append(text)
    links, attachments = [], {}
    listed = any(e[0] == "open" and _in_list(e[3]) for e in events)
    for e in events:
        if e[0] != "open":
            continue
        raw = e[2].get("href") or e[2].get("src") or e[2].get("data")
        if not raw or e[1] not in ("a", "iframe", "embed", "object"):
            continue
        try:
            target = urljoin(url, raw)
            parts = urlsplit(target)
        except ValueError:
            continue
        if e[1] == "a" and e[2].get("href") and (not listed or _in_list(e[3])):
            links.append(target)
        if (parts.hostname or "").lower() in ATTACHMENT_HOSTS or parts.path.lower().endswith(ATTACHMENT_ENDINGS):
            attachments[target] = None
    body = "\n".join(lines)
    date = DATE.search(events[anchor][1])[0] if anchor is not None else None
    enough = len(body) >= 20
    return {
        "title": title, "date_text": date and _clean(date), "raw_text": body if enough else title,
        "parse_mode": "body" if enough else "title_only", "links": links, "attachments": list(attachments)
    }


def _in_list(inside: list[set[str]]) -> bool:
    outer = next((i for i, c in enumerate(inside) if LIST_CONTAINER[0] in c), None)
    return outer is not None and any(LIST_CONTAINER[1] in c for c in inside[outer + 1:])


def visible(html: str) -> tuple[str | None, str]:
    """Title and text of a page without scripts, styles and templates; the title comes first in the text too."""
    title, body = [], []
    hidden = _HIDDEN | {"template"}
    for e in events_of(html):
        if e[0] == "text":
            if "title" in e[2]:
                title.append(e[1])
            if not e[2] & hidden:
                body.append(e[1])
    name = _clean(" ".join(title))
    return name or None, _clean(" ".join([name, *body]))


def parse_notices(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, publication_date, raw_text, parse_mode, links, attachments) of rows (page_id, url, html).

    Null or empty pages give the title "Untitled notice". Dates are local.
    """
    schema = "page_id long, url string, title string, date_text string, raw_text string, parse_mode string, links array<string>, attachments array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"page_id": i, "url": u, **parse_page(h or "", u or "")} for i, u, h in zip(pdf.page_id, pdf.url, pdf.html)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "title", "date_text", "raw_text", "parse_mode", "links", "attachments"])

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, schema)
    at = F.to_utc_timestamp(F.try_to_timestamp("date_text", F.lit("dd/MM/yyyy HH:mm")), ZONE)
    return out.withColumns({"title": clean_title("title"), "publication_date": at}).drop("date_text")


def discover_links(parsed: DataFrame, domain: str, pattern: str = NOTICE_PATH.pattern, limit: int | None = None) -> DataFrame:
    """(page_id, link, position, external_id) of official notice links, the first of equal ones, ``limit`` a page."""
    rows = parsed.select("page_id", F.posexplode("links").alias("at", "link")).filter(official_host("link", domain))
    rows = rows.withColumn("external_id", F.regexp_extract("link", f"(?i){pattern}", 1)).filter("external_id != ''")
    first = rows.groupBy("page_id", "link", "external_id").agg(F.min("at").alias("at"))
    out = first.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy("at")))
    return (out.filter(F.col("position") <= limit) if limit else out).drop("at")


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, title, text, status) of rows (page_id, html, media_type): OK, CONTENT_TRUNCATED at 24000 characters, EMPTY_CONTENT, UNSUPPORTED_CONTENT_TYPE or TOO_LARGE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(None, _clean(h or "")) if m == "text/plain" else visible(h or "") for h, m in zip(pdf.html, pdf.media_type)]
            yield pd.DataFrame(
                {"page_id": pdf.page_id, "title": [t for t, _ in found], "text": [x for _, x in found], "refused": pdf.refused}
            )

    kind = F.lower(F.trim(F.split_part(F.coalesce("media_type", F.lit("")), F.lit(";"), F.lit(1))))
    refused = F.when(~kind.isin(*MEDIA_TYPES), "UNSUPPORTED_CONTENT_TYPE").when(F.octet_length("html") > MOST_BYTES, "TOO_LARGE")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.when(refused.isNull(), F.col("html")).alias("html"), kind.alias("media_type"),
        refused.alias("refused")
    )
    out = rows.mapInPandas(run, "page_id long, title string, text string, refused string")
    status = F.coalesce(
        "refused", F.when(F.col("text") == "", "EMPTY_CONTENT").when(F.length("text") > MOST_CHARS, "CONTENT_TRUNCATED").otherwise("OK")
    )
    return out.select("page_id", "title", F.substring("text", 1, MOST_CHARS).alias("text"), status.alias("status"))


def marker_gate(listings: DataFrame, marker: str | Column) -> tuple[DataFrame, DataFrame]:
    """Listings that hold their marker, in any case, and those that do not: the dead letters."""
    has = F.coalesce(F.contains(F.lower("html"), F.lower(marker if isinstance(marker, Column) else F.lit(marker))), F.lit(False))
    return listings.filter(has), listings.filter(~has)


def dead_letters(rows: DataFrame, stage: str, error_type: str, message: Column, at: Column) -> DataFrame:
    """What could not be taken in, for an append-only table: (source_id, url, stage, error_type, message, failed_at)."""
    return rows.select(
        "source_id", "url", F.lit(stage).alias("stage"), F.lit(error_type).alias("error_type"), message.cast("string").alias("message"),
        at.alias("failed_at")
    )
