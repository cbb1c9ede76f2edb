"""Operator 4: main text of web pages by a site style tree.

Pages of a host are merged into one tree: a node is a path of elements with their class names. A
node's presentation importance is the entropy of the child sequences its pages show there; a
text node's content importance is the entropy of the texts its pages show there. A branch's
importance joins its own presentation importance with the mean content importance of its leaves,
the more leaves the more of the former. Branches of low importance (the same on most pages) are
removed from each page, as are elements whose very presentation marks them as noise: navigation,
headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments. Branches
in a marked article and beside it are judged alike, but an article of which more than half would be
removed stays whole: an article that is copied many times still is each page's text.

Entropy alone can't do: menus, adverts and footers may differ on every page, like articles do.

Text between block elements is one block: its white space becomes single spaces, and blocks are
joined by one space in page order. A null or empty page has the empty text. A page
of any length is read whole. Null urls are one host. Repeated rows are pages of their own; other columns don't matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmeter.llm.store import ship, stored

#: Element names of HTML and names that sites give to parts of a page.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_ELEMENTS = frozenset(
    "nav footer aside form script style noscript template iframe svg canvas object audio video head title button select "
    "textarea menu dialog search".split()
)
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget footer comment comments disqus reply replies share sharing social related "
    "recommended pagination pager toolbar masthead skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ARTICLE_ELEMENTS = frozenset(("article", "main"))
NOISE, PLAIN, ARTICLE = 0, 1, 2
#: Steps of a path that tell nodes apart; deeper elements share their ancestor's node.
DEPTH = 40

#: A branch below this importance is removed, if the host shows it on enough pages to tell.
LEAST_IMPORTANCE, LEAST_PAGES, DAMPING = 0.2, 8, 0.9
_NAME = re.compile(r"[a-z]+[0-9]*")


class PageTree(HTMLParser):
    """Blocks of a page and what its nodes look like."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, int]] = [("", "", PLAIN)]  # element, path, kind
        self.blocks: list[tuple[str, int, str]] = []
        self.children: dict[str, list[str]] = {}
        self.text: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            _, path, kind = self.stack[-1]
            self.blocks.append((path, kind, text))

    def _close(self, size: int) -> None:
        self._flush()
        del self.stack[size:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            # A block ends inline elements and paragraphs that were left open; a line break ends none.
            size = len(self.stack)
            while tag not in EMPTY and size > 1 and (self.stack[size - 1][0] not in BLOCKS or self.stack[size - 1][0] == "p"):
                size -= 1
            if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and self.stack[size - 1][0] == tag:
                size -= 1
            del self.stack[size:]
        if tag in EMPTY:
            return
        _, path, kind = self.stack[-1]
        given = dict(attrs)
        names = _NAME.findall(f"{given.get('class') or ''} {given.get('id') or ''}".lower())
        if kind != NOISE:
            in_article = kind == ARTICLE
            if (
                tag in NOISE_ELEMENTS
                or not NOISE_NAMES.isdisjoint(names)
                or (given.get("role") or "").lower() in NOISE_ROLES
                or (not in_article and (tag == "header" or "header" in names))
                or "hidden" in given
            ):
                kind = NOISE
            elif tag in ARTICLE_ELEMENTS or (given.get("role") or "").lower() in ARTICLE_ELEMENTS:
                kind = ARTICLE
        step = tag + "".join("." + n for n in sorted(set((given.get("class") or "").lower().split()))[:3])
        if path.count("/") < DEPTH:
            shown = self.children.setdefault(path, [])
            if not shown or shown[-1] != step:  # repeated siblings are one
                shown.append(step)
            path = f"{path}/{step}"
        self.stack.append((tag, path, kind))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for size in range(len(self.stack) - 1, 0, -1):
            if self.stack[size][0] == tag:
                if tag in BLOCKS or any(t in BLOCKS for t, *_ in self.stack[size + 1 :]):
                    self._close(size)
                else:  # text of an inline element stays in its block
                    del self.stack[size:]
                return
        if tag in BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.stack[-1][2] == NOISE and self.stack[-1][0] in ("script", "style"):
            return
        self.text.append(data)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(html: str | None) -> tuple[list[tuple[str, int, str]], list[tuple[str, int, int | None]]]:
    """(blocks as (path, kind, text), nodes as (path, digest of the child sequence, digest of the text or None))."""
    page = PageTree()
    page.feed(html or "")
    page.close()
    page._close(1)
    texts: dict[str, list[str]] = {}
    for path, _, text in page.blocks:
        texts.setdefault(path, []).append(text)
    nodes = [
        (path, _digest(" ".join(page.children.get(path, ()))), _digest("\n".join(texts[path])) if path in texts else None)
        for path in {*page.children, *texts}
    ]
    return page.blocks, nodes


_BLOCK = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.int32()), ("text", pa.string())]))
_NODE = pa.list_(pa.struct([("path", pa.string()), ("style", pa.int64()), ("content", pa.int64())]))


def trees(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks that may be main text, nodes of every page."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    names = ["page_id", "url", "host", "blocks", "nodes"]
    schema = (
        f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, "
        "blocks array<struct<path:string,kind:int,text:string>>, nodes array<struct<path:string,style:bigint,content:bigint>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                blocks, nodes = [], []
                for html in part.column(3):
                    b, n = parse(html.as_py())
                    blocks.append([{"path": p, "kind": k, "text": t} for p, k, t in b if k != NOISE])
                    nodes.append([{"path": p, "style": s, "content": c} for p, s, c in n])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(blocks, _BLOCK), pa.array(nodes, _NODE)], names
                )

    return pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(run, schema)


def importance(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance of every node of every host's style tree."""
    nodes = pages.select("host", F.explode("nodes").alias("n")).select("host", "n.*")

    def entropy(kind: str) -> DataFrame:
        seen = nodes.where(F.col(kind).isNotNull()).groupBy("host", "path", kind).agg(F.count("*").alias("c"))
        # -sum p log_m p, with p = c/m, from sums over the different looks.
        m = F.sum("c")
        value = F.when(m > 1, (F.log(m) - F.sum(F.col("c") * F.log("c")) / m) / F.log(m)).otherwise(F.lit(1.0))
        return seen.groupBy("host", "path").agg(m.alias(f"{kind}_pages"), value.alias(f"{kind}_entropy"))

    leaves = entropy("content")
    step_ends = F.filter(
        F.sequence(F.lit(1), F.length("path")), lambda i: (i == F.length("path")) | (F.substring("path", i + 1, F.lit(1)) == "/")
    )
    under = leaves.select("host", "content_pages", "content_entropy", F.explode(F.transform(step_ends, lambda i: F.substring("path", F.lit(1), i))).alias("path"))
    content = under.groupBy("host", "path").agg(
        F.count("*").alias("leaves"), (F.sum(F.col("content_entropy") * F.col("content_pages")) / F.sum("content_pages")).alias("inner"),
    )
    weight = F.pow(F.lit(DAMPING), F.col("leaves"))
    return entropy("style").join(content, ["host", "path"]).select(
        "host", "path", F.col("style_pages").alias("pages"),
        ((1 - weight) * F.col("style_entropy") + weight * F.col("inner")).alias("importance"),
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = stored(trees(pages), "page-trees")
    low = importance(parsed).where((F.col("importance") < LEAST_IMPORTANCE) & (F.col("pages") >= LEAST_PAGES))
    low = stored(low.groupBy(F.col("host").alias("low_host")).agg(F.collect_set("path").alias("low")), "page-noise")
    joined = parsed.join(low, parsed["host"] == low["low_host"], "left")
    same = lambda b: F.coalesce(F.exists("low", lambda p: (b["path"] == p) | F.startswith(b["path"], F.concat(p, F.lit("/")))), F.lit(False))
    marked = joined.withColumn("blocks", F.transform("blocks", lambda b: b.withField("low", same(b))))
    size = lambda of: F.aggregate(F.filter("blocks", of), F.lit(0), lambda n, b: n + F.length(b["text"]))
    in_article = lambda b: b["kind"] == ARTICLE
    # An article that is mostly the same as others is a copy: it stays whole.
    copied = size(in_article) > 2 * size(lambda b: in_article(b) & ~b["low"])
    joined = marked.withColumn("copied", copied)
    chosen = F.filter("blocks", lambda b: ~b["low"] | (in_article(b) & F.col("copied")))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
