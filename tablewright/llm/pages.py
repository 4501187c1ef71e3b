"""Main text of web pages with a site style tree.

Each page is read into blocks of text, each with the path of its elements (tag, class
and id words, and the region they stand for).  Elements that say what they are decide
by themselves: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comments are of no importance, an article or main element is of full importance.
Inside one, only a container whose class (a div also its id) is such a name as a whole goes:
headings, inline elements and ids of sections say what a text is about.  An article named as a comment is one.

Every page goes into the style tree of its host: the paths of all pages
of the host are merged, a path's presentation nodes are the sequences of child
elements found there, and its content nodes the texts.  A content node that k of m pages share has entropy
log k / log m, a path whose presentation differs from page to page has a high
one.  A branch counts with 1 - entropy of its content and with the entropy of its
presentation, and goes if that is below a threshold.  Where the article or main elements hold most of a page's text,
their role is a part of the importance: what stands beside them has none, what stands inside goes only if nine
of ten pages of a host of some size share it (a notice that no name tells).  Elsewhere (a page without
them, or with articles that are mere teasers) the tree alone decides, for every block.  Equal pages of a host are one page
of the tree.  Counts leave a task pre-aggregated, so a host with a third of all pages is no
single task; only the unimportant nodes go back to the pages that hold them.

Defined results
* null or empty html: empty text; an unfinished tag or comment at the end is dropped
* character references are decoded as browsers do; white space inside a block
  becomes one space, blocks are joined by a line break
* a null url belongs to the host ""; rows of equal id, url and html get equal results
* an empty table gives an empty result; other columns are left alone
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.work import Work

IMPORTANT = 0.3  # a branch below this goes
CONTENT_SHARE = 0.9  # weight of content against presentation
PAGES = 3  # a host of fewer pages tells nothing about its branches
ROLE = 0.25  # weight of a main region against the style tree …
MAIN_PAGES = 10  # … which a host of fewer pages says nothing against,
MAIN_SHARE = 0.9  # nor a text that fewer of its pages hold

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset(("br", "td", "th"))
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
NOISE_TAGS = frozenset("nav aside footer form head title menu dialog button search".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner sponsor sponsored promo sidebar sidebars nav navbar navigation breadcrumb "
    "breadcrumbs menu menus header masthead topbar footer cookie cookies consent notice notices alert popup modal comment comments disqus "
    "replies share sharing social related newsletter subscribe login search widget pagination pager toolbar".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
MAIN_TAGS = frozenset(("article", "main"))
COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
TEASER_NAMES = frozenset("card cards excerpt preview teaser teasers".split())  # articles that stand for others
# in a main region whole words of a container's class decide, never one part of a word; these may stand beside a name
PART_NAMES = frozenset("area bar block body box buttons container content inner item items link links list section unit wrap wrapper".split())
TOPIC_NAMES = frozenset("alert banner header masthead notice notices related search social".split())  # alone they may be titles or topics
CONTAINERS = frozenset("div section ul ol dl table p".split())
NEUTRAL, NOISE, MAIN = 0, 1, 2


def _named(word: str, names: frozenset, telling: frozenset) -> bool:
    """Whether all parts of a word are ``names`` or parts of a page, one of them a ``telling`` name."""
    parts = set(NAME.findall(word))
    return bool(parts & telling) and parts <= names | PART_NAMES


def _region(tag: str, attributes: str, above: int) -> tuple[int, str]:
    """What an element stands for, and its name in a path."""
    names, classes, role = [], [], ""
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values).lower()
        if key.lower() == "role":
            role = value.strip()
        else:
            names.append(value)
            if key.lower() == "class" or tag == "div":
                classes.extend(value.split())
    name = f"{tag}.{' '.join(names)}" if names else tag
    if above == NOISE:
        return NOISE, name
    if tag in NOISE_TAGS or role in NOISE_ROLES or tag == "header" and above != MAIN:
        return NOISE, name
    if tag == "article":
        if any(_named(word, COMMENT_NAMES, COMMENT_NAMES) for word in classes):
            return NOISE, name
        if any(_named(word, TEASER_NAMES, TEASER_NAMES) for word in classes):
            return above, name
    elif above == MAIN:
        if tag in CONTAINERS and any(_named(word, NOISE_NAMES, NOISE_NAMES - TOPIC_NAMES) for word in classes):
            return NOISE, name
    elif tag not in ("main", "html", "body") and set(NAME.findall(" ".join(names))) & NOISE_NAMES:
        return NOISE, name
    return (MAIN if tag in MAIN_TAGS or role in ("main", "article") else above), name


def blocks(html: str | None) -> list[tuple[int, str, str, tuple[str, ...]]]:
    """(region, path, text, child elements) of every block with text, in page order."""
    out: list[tuple] = []
    stack = [("", NEUTRAL, "", [])]  # tag, region, path, children
    parts: list[str] = []

    def flush() -> None:
        if parts:
            _, region, path, children = stack[-1]
            if region != NOISE and (text := " ".join(unescape("".join(parts)).split())):
                out.append((region, path, text, tuple(children)))
            parts.clear()

    at, html = 0, html or ""
    for m in TAG.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in SPACED:
            parts.append(" ")
        block = tag in BLOCKS
        if m[2]:
            if any(s[0] == tag for s in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            elif block:
                flush()
            continue
        if tag in VOID:
            if block:
                flush()
            continue
        region, name = _region(tag, m[4], stack[-1][1])
        if not block and region == stack[-1][1] and region != NOISE:
            continue  # inline: its text belongs to the block around it
        flush()
        if block and stack[-1][0] == "p":
            stack.pop()
            region, name = _region(tag, m[4], stack[-1][1])
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in CLOSED_BY.get(tag, ()):
                del stack[i:]
                break
            if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                break
        _, above, path, children = stack[-1]
        children.append(name)
        region, name = _region(tag, m[4], above)
        stack.append((tag, region, f"{path}>{name}", []))
    parts.append(html[at:])
    flush()
    return out


def _digest(*values: str) -> int:
    return int.from_bytes(blake2b("\0".join(values).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _undecided(found: list[tuple]) -> bool:
    """Article and main elements hold less than half of the text, so the style tree alone decides."""
    inside = sum(len(text) for region, _, text, _ in found if region == MAIN)
    return 2 * inside < sum(len(text) for _, _, text, _ in found) or not inside


def host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the style tree: (page, host, path, kind, feature)."""
    for batch in batches:
        out = ([], [], [], [], [])
        for where, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = blocks(html.as_py())
            page = _digest(*(text for _, _, text, _ in found))
            rows = {(_digest(path), "text", _digest(text)) for _, path, text, _ in found}
            rows |= {(_digest(path), "style", _digest(*children)) for _, path, _, children in found}
            for column, values in zip(out, zip(*((page, where, *r) for r in rows))):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["page", "host", "path", "kind", "feature"])


def unimportant(rows: DataFrame, work: Work) -> DataFrame:
    """(host, path, feature, steady) of the content nodes that the style tree of the host gives up; ``steady`` ones go from main regions too."""
    nodes = work.save(rows.mapInArrow(_nodes, "page bigint, host string, path bigint, kind string, feature bigint").distinct(), "nodes")
    sizes = nodes.groupBy("host").agg(F.count_distinct("page").alias("m")).where(F.col("m") >= PAGES)
    counts = nodes.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("k"))
    styles = counts.where("kind = 'style'").groupBy("host", "path").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log(F.col("k").cast("double"))).alias("klogk"))
    entropy = F.log("n") - F.col("klogk") / F.col("n")  # of the presentations, in nats
    weighed = counts.where("kind = 'text'").join(sizes, "host").join(styles, ["host", "path"]).select(
        "host", "path", "feature", ((F.col("m") >= MAIN_PAGES) & (F.col("k") >= MAIN_SHARE * F.col("m"))).alias("shared"),
        (CONTENT_SHARE * (1 - F.log("k") / F.log("m")) + (1 - CONTENT_SHARE) * entropy / F.log("m")).alias("importance"),
    )
    steady = F.col("shared") & (ROLE + (1 - ROLE) * F.col("importance") < IMPORTANT)
    return work.save(weighed.where(F.col("importance") < IMPORTANT).select("host", "path", "feature", steady.alias("steady")), "unimportant")


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, host, path, feature, main) of the content nodes that a page may keep; ``main`` tells whether its main regions decide."""
    for batch in batches:
        out = ([], [], [], [], [])
        for key, where, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = blocks(html.as_py())
            main = not _undecided(found)
            for path, text in {(_digest(path), _digest(text)) for region, path, text, _ in found if region == MAIN or not main}:
                for column, value in zip(out, (key, where, path, text, main)):
                    column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["key", "host", "path", "feature", "main"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, gone in zip(batch.column(2), batch.column(3).to_pylist()):
            found = blocks(html.as_py())
            if not _undecided(found):
                found = [block for block in found if block[0] == MAIN]
            drop = {(g["path"], g["feature"]) for g in gone or ()}
            kept = [text for _, path, text, _ in found if not drop or (_digest(path), _digest(text)) not in drop]
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"]
        )


def main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    work = Work(pages.sparkSession, "pages")
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    low = unimportant(slim.select(host("url").alias("host"), "html"), work)
    key = F.xxhash64("id", "url", F.xxhash64("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    if low.isEmpty():
        marked = slim.withColumn("gone", F.lit(None).cast("array<struct<path:bigint,feature:bigint>>"))
    else:
        held = slim.select(key.alias("key"), host("url").alias("host"), "html").mapInArrow(_holders, "key bigint, host string, path bigint, feature bigint, main boolean")
        gone = held.join(low, ["host", "path", "feature"]).where("steady OR NOT main").groupBy("key").agg(F.collect_set(F.struct("path", "feature")).alias("gone"))
        marked = slim.withColumn("key", key).join(work.save(gone, "gone"), "key", "left").select("id", "url", "html", "gone")
    rows = marked.mapInArrow(_texts, f"id {kind}, url string, text string, n_chars bigint")
    return rows.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
