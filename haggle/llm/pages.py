"""Main text of web pages: structure names the article, and a suffix array of each host finds what its pages repeat.

A page is cut into blocks of text, each inside an article, inside something that is
never main text, or plain. Where a page marks its article, that is the text. Where
it marks none, the plain blocks are held against the other pages of the host: the
tokens that a run of the host's suffix order repeats on another page are taken out,
and the unique runs are the text."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.llm.arrays import span_hashes
from haggle.session import scratch_path

#: Tokens of a repeated run at least; a shorter block counts as repeated when all of it is.
RUN = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
NEVER = RAW | frozenset("head nav footer aside form button select dialog menu".split())
ARTICLE = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An element that starts ends an open one of these.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"p", "option", "body", "html"}
#: Scopes that an implied end does not leave.
SCOPE = frozenset("table ul ol dl div section article main aside nav footer body td th blockquote".split())

_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|notification|alert|popup|modal|sidebar|comments?|replies|disqus|"
    r"newsletter|subscri\w+|share|sharing|social|related|recommend\w*|breadcrumbs?|menu|nav|navbar|navigation|footer|masthead|pagination|toolbar|widget|skip)"
    r"(?:$|[\s_-])",
    re.IGNORECASE,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(hidden)\b")

CORE, PLAIN, CHROME = "core", "plain", "chrome"


def _kind(name: str, attrs: str, in_article: bool) -> str | None:
    """What an element makes of its text, or None if it changes nothing."""
    if name in NEVER or (name == "header" and not in_article):
        return CHROME
    if attrs:
        for m in _ATTR.finditer(attrs):
            if m[5]:
                return CHROME
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id") and name not in ("body", "html", "article", "main") and _NAMES.search(value):
                return CHROME
            if key in ("class", "id") and name == "article" and re.search(r"(?i)comment|related|promo|teaser", value):
                return CHROME
            if key == "role" and value.lower() in _ROLES or key == "aria-hidden" and value.lower() == "true":
                return CHROME
            if key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value == "articleBody":
                return CORE
    return CORE if name in ARTICLE else None


def blocks(html: str) -> list[tuple[str, str]]:
    """(kind, text) of the page's blocks in order, references decoded, white space one space."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str | None]] = []
    kind, held = PLAIN, []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((kind, text))

    def now() -> str:
        kinds = [k for _, k in stack if k]
        return CHROME if CHROME in kinds else CORE if kinds else PLAIN

    def close(names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                del stack[at:]
                return
            if stack[at][0] in scope:
                return

    at, low = 0, None
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK or any(n == name and k for n, k in stack):
                flush()
            if any(n == name for n, _ in stack):
                close({name}, frozenset())
                kind = now()
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            held.append(" ")
        if name in CLOSES:
            close(CLOSES[name], SCOPE)
        if name in ENDS_P:
            close({"p"}, SCOPE)
        if name in VOID:
            continue
        own = _kind(name, m[3], any(k == CORE for _, k in stack))
        if name in RAW and not m[3].endswith("/"):
            if low is None:
                low = html.lower()
            end = low.find(f"</{name}", at)
            if name in ("script", "style", "textarea", "title"):
                at = len(html) if end < 0 else html.find(">", end) + 1 or len(html)
                continue
        if m[3].endswith("/") and name not in BLOCK:
            continue
        if own:
            flush()
        stack.append((name, own))
        kind = now()
    flush()
    return out


OUTSIDE = "row bigint, page_id bigint, url string, host string, marked boolean, place int, chrome boolean, text string"


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _marked_text(found: list[tuple[str, str]]) -> str | None:
    core = [t for k, t in found if k == CORE]
    return "\n".join(core) if core else None


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the pages that mark their article."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            some = batch.slice(i, 500)
            texts = [_marked_text(blocks(h or "")) for h in some.column("html").to_pylist()]
            keep = pa.array([t is not None for t in texts])
            rows = pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])
            yield rows.filter(keep)


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks outside the articles, and for a page without an article one row at place -1."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            out = []
            for r in batch.slice(i, 500).to_pylist():
                found = blocks(r["html"] or "")
                marked, host = any(k == CORE for k, _ in found), _host(r["url"])
                own = (r["row"], r["page_id"], r["url"], host, marked)
                if not marked:
                    out.append((*own, -1, False, None))
                out.extend((*own, p, k == CHROME, t) for p, (k, t) in enumerate(found) if k != CORE)
            if out:
                names = ["row", "page_id", "url", "host", "marked", "place", "chrome", "text"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _grams(text: str, run: int) -> tuple[list[str], np.ndarray]:
    """A block's tokens and the hash of the first `run` tokens of each suffix that has so many; a shorter block is one."""
    tokens = text.split()
    data = np.frombuffer(" ".join(tokens).encode(), np.uint8)
    lengths = np.array([len(t.encode()) for t in tokens], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = max(1, len(tokens) - run + 1)
    last = np.minimum(np.arange(n) + run, len(tokens)) - 1
    return tokens, span_hashes(data, starts[:n], starts[last] + lengths[last])


def _suffixes(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                some = batch.slice(i, 2000)
                grams = [_grams(t, run)[1].view(np.int64) for t in some.column("text").to_pylist()]
                if grams:
                    at = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))
                    columns = [some.column("host").take(at), pa.array(np.concatenate(grams)), some.column("first").take(at), some.column("last").take(at)]
                    yield pa.RecordBatch.from_arrays(columns, ["host", "gram", "first", "last"])

    return go


def _unique_runs(run: int):
    """What is left of each block without its covered tokens; `repeated` holds hashes of the host."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, repeated in zip(batch.column("text").to_pylist(), batch.column("repeated").to_pylist()):
                tokens, grams = _grams(text, run)
                covered = np.zeros(len(tokens) + 1, np.int64)
                hit = np.flatnonzero(np.isin(grams.view(np.int64), np.array(repeated or [], np.int64)))
                np.add.at(covered, hit, 1)
                np.add.at(covered, np.minimum(hit + run, len(tokens)), -1)
                texts.append(" ".join(t for t, c in zip(tokens, np.cumsum(covered[:-1])) if c == 0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("place"), pa.array(texts, pa.string())], ["row", "place", "text"])

    return go


def main_text(pages: DataFrame, run: int = RUN, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page: the main text, blocks joined by one line feed.

    Nothing of a marked article is dropped but what stands in menus, forms, notices
    and the like inside it. A page without a mark keeps what no other page of its
    host repeats in `run` tokens or more. The suffix order is kept to the first `run`
    tokens, which is enough to know what is covered, and each host's equal blocks
    are one, so a host with a third of all pages has no task of its own. Null html
    gives an empty text; a null or broken url is of the empty host. Repeated rows
    keep a result each; other columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    path = scratch_path(spark, "outside")
    rows.mapInArrow(_outside, OUTSIDE).write.parquet(path)
    outside = spark.read.parquet(path)
    marked = rows.select("page_id", "url", "html").mapInArrow(_articles, "page_id bigint, url string, text string")
    open_ = outside.where(~F.col("marked"))

    # suffixes of each host in the order of their first tokens: neighbours on different pages repeat them
    texts = outside.where("text IS NOT NULL").groupBy("host", "text").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    suffixes = texts.mapInArrow(_suffixes(run), "host string, gram bigint, first bigint, last bigint")
    repeated = suffixes.groupBy("host", "gram").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last")
    own = open_.where("text IS NOT NULL AND NOT chrome").select("row", "host", "place", "text")
    mine = own.select(F.col("row").alias("first"), F.col("place").cast("long").alias("last"), "host", "text").mapInArrow(_suffixes(run), "host string, gram bigint, first bigint, last bigint")
    hits = mine.distinct().join(repeated.select("host", "gram"), ["host", "gram"]).groupBy(F.col("first").alias("row"), F.col("last").alias("place")).agg(F.collect_list("gram").alias("repeated"))
    left = own.join(hits, ["row", "place"], "left").select("row", "place", "text", "repeated").mapInArrow(_unique_runs(run), "row bigint, place int, text string").where("text <> ''")
    joined = left.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    plain = open_.where("place = -1").select("row", "page_id", "url").join(joined, "row", "left").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    return marked.unionByName(plain)
