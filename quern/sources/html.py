"""Pages to sectioned text and links: an Arrow function parses, Spark does the rest."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADINGS = ("h1", "h2", "h3", "h4")
BLOCKS = {*HEADINGS, "p", "li"}
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form"}
ELEMENT = "array<struct<pos:int, tag:string, text:string, links:int>>"


class _Blocks(HTMLParser):
    """Headings, paragraphs and list items in document order, with the number of links in each, and all link targets."""

    def __init__(self, skip: set[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.hidden = skip, 0
        self.out: list[dict] = []
        self.open: list[dict] = []
        self.hrefs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED or self.hidden and tag not in ("br", "img", "input", "hr", "meta", "link"):
            self.hidden += 1
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.hrefs.append(a["href"])
            for b in self.open:
                b["links"] += 1
        if tag in BLOCKS and not self.hidden and not (set((a.get("class") or "").split()) & self.skip):
            b = {"pos": len(self.out), "tag": tag, "text": "", "links": 0}
            self.out.append(b)
            self.open.append(b)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and tag not in ("br", "img", "input", "hr", "meta", "link"):
            self.hidden -= 1
        if self.open and self.open[-1]["tag"] == tag:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden and self.open:
            self.open[-1]["text"] += data


def _parsed(html: str | None, skip: set[str]) -> _Blocks:
    p = _Blocks(skip)
    if html:
        p.feed(html)
        p.close()
    return p


def elements(html: Column, skip_classes: list[str] = ()) -> Column:
    """Headings, paragraphs and list items of a page as an array in document order; null gives an empty array."""
    skip = set(skip_classes)

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([[b | {"text": " ".join(b["text"].split())} for b in _parsed(h, skip).out] for h in pages])

    return F.pandas_udf(run, ELEMENT)(html)


def links(df: DataFrame, url: str, html: str, same_host: bool = True) -> DataFrame:
    """Distinct absolute ``link`` targets of all pages, without fragments; other schemes than http are left out."""

    def run(urls: pd.Series, pages: pd.Series) -> pd.Series:
        out = []
        for u, h in zip(urls, pages):
            own = []
            for x in _parsed(h, set()).hrefs:
                try:
                    full = urljoin(u or "", x.strip()).split("#")[0]
                    parts = urlsplit(full)
                except ValueError:
                    continue
                if parts.scheme in ("http", "https") and (not same_host or parts.netloc == urlsplit(u or "").netloc):
                    own.append(full)
            out.append(own)
        return pd.Series(out)

    return df.select(F.explode(F.pandas_udf(run, "array<string>")(F.col(url), F.col(html))).alias("link")).distinct()


#: Phrases of navigation and promotion; an element with one of them is left out where asked for.
SKIP_PHRASES = [
    "mayo clinic", "request appointment", "find a doctor", "patient portal", "giving to mayo", "contact us", "locations", "careers", "sign up", "newsletter", "book", "advertisement",
    "privacy policy", "terms", "follow mayo clinic", "get the app", "site map", "manage cookies",
]


def content(els: Column, phrases: list[str] = SKIP_PHRASES, least: int = 10) -> Column:
    """The elements without navigation: no skip phrase, ``least`` characters or more, and of paragraphs and items none with more links than half their words."""
    said = lambda e: F.lower(e["text"])
    clean = lambda e: ~F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(said(e), p)) if phrases else F.lit(True)
    linked = lambda e: e["tag"].isin("p", "li") & (e["links"] > F.floor(F.size(F.split(e["text"], " ")) / 2))
    return F.filter(els, lambda e: clean(e) & (F.length(e["text"]) >= least) & ~linked(e))


def sectioned(els: Column, least: int = 10) -> Column:
    """Text of a page: each heading that has content as ``--- Heading ---`` before its paragraphs and ``• `` items, parts a blank line apart.

    Paragraphs of ``least`` characters or fewer, and elements with more links than half their words, are left out. What stands
    before the first heading is lost, as in the crawlers; a page that gives nothing falls back to all its paragraphs and items.
    """
    is_h = lambda e: e["tag"].isin(*HEADINGS)
    keep = F.filter(els, lambda e: is_h(e) | ((e["tag"] == "li") | (F.length(e["text"]) > least)) & (e["links"] <= F.size(F.split(e["text"], " ")) / 2) & (e["text"] != ""))
    line = lambda e: F.when(e["tag"] == "li", F.concat(F.lit("• "), e["text"])).otherwise(e["text"])
    kind = "struct<head:string,out:array<string>>"
    start = F.struct(F.lit(None).cast("string").alias("head"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        heading = F.struct(e["text"].alias("head"), acc["out"].alias("out"))
        lost = acc
        title = F.when(acc["head"] != "", F.array(F.concat(F.lit("--- "), acc["head"], F.lit(" ---")))).otherwise(F.array().cast("array<string>"))
        body = F.struct(F.lit("").alias("head"), F.concat(acc["out"], title, F.array(line(e))).alias("out"))
        return F.when(is_h(e), heading).when(acc["head"].isNull(), lost).otherwise(body).cast(kind)

    parts = F.aggregate(keep, start.cast(kind), step)["out"]
    plain = F.transform(F.filter(els, lambda e: ~is_h(e) & (e["text"] != "")), line)
    return F.array_join(F.when(F.size(parts) > 0, parts).otherwise(plain), "\n\n")


def merged_pages(df: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """``key, text``: sub-pages of one page in order of ``part``, each under a banner with its name. A page has a bounded number of parts."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.col(text).alias("t"))))
    return df.where(F.length(text) > 0).groupBy(key).agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("=== "), r["p"], F.lit(" ===\n\n"), r["t"])), "\n\n").alias("text"))
