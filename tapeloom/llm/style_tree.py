"""Main text of web pages by a site style tree.

Pages are parsed to their text blocks; each block hangs on a style node, the chain of tags, classes and ids above it. Blocks under
presentation that is never article (menus, headers, footers, forms, adverts, scripts and so on, by tag or by a whole class, id or
role) go at once. The pages of a host are merged by style node: a node's importance is the entropy, over the host's different pages, of what
stands there and of how many blocks it has. Nodes that say the same on nearly every page are the site's furniture and are removed
from each page. On hosts of few pages a node leans on what its style is worth elsewhere. Inside an article or main element headings,
paragraphs and ids made from headings drop nothing at once; whatever else may be furniture there is left to the tree.
"""
from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import small_batches, staged, without

LEAST_PAGES = 5             # different pages of a host before its tree judges a node by itself
LOW_IMPORTANCE = 0.2
MOST_SENT_NODES = 50_000    # with more low nodes than this, they are joined by a shuffle

# Tags whose text is never the article's, tags that break blocks, tags without content, words of class, id and role.
NOISE_TAGS = frozenset("head nav header footer aside form script style template noscript iframe object svg canvas button select datalist dialog menu audio video map applet".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer colophon comment comments discussion disqus replies respond share sharing social related recommended widget pagination pager search toolbar complementary contentinfo".split())
KEPT_TAGS = frozenset(("article", "main"))
# Inside an article or main: tags whose text may be the article's, ids (often made from headings) whose words drop content, tags that no name drops.
DOUBTFUL_TAGS = frozenset("header footer aside".split())
COMMENT_IDS = frozenset("comment comments disqus".split())
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
# Words that may stand beside one of the above in one class or id, with numbers; other words say what the content is.
LAYOUT_WORDS = frozenset("site global top bottom left right primary secondary list lists box block wrap wrapper container inner outer bar bars links slot unit panel area holder".split())
COMMENT_PARTS = frozenset("user reader thread section item count form body text content author meta post posts title header reply".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select html body article main section div td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_WORD = re.compile(r"[^\W_]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I) for tag in RAW_TAGS}


def _marks(token: str, words: frozenset) -> bool:
    """Whether a class, id or role says that its content is furniture: one of the words, alone or beside words of layout only."""
    parts = _WORD.findall(token)
    said = words.intersection(parts)
    if not said:
        return False
    beside = LAYOUT_WORDS | (COMMENT_PARTS if said & COMMENT_WORDS else frozenset())
    return all(part in words or part in beside or part.isdigit() for part in parts)


@lru_cache(maxsize=20_000)
def _names(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """Class, id and role of a start tag as one text, and whether they mark its content as not the article's; `inside`: in an article or main."""
    named, noise = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            noise = True
        elif name in ("class", "id", "role"):
            named.append(value)
            if not inside or tag not in TEXT_TAGS:
                words = COMMENT_IDS if inside and name == "id" else NOISE_WORDS
                noise = noise or any(_marks(token, words) for token in value.split())
    return " ".join(named), noise


def _style(parent: str, tag: str, names: str) -> str:
    """Hash of the chain of tags and names."""
    return hashlib.blake2b(f"{parent}/{tag}.{names}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def parse(page: str) -> list[tuple[str, bool, str]]:
    """Text blocks in page order: style node, whether inside an article or main element, and the text."""
    out: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]     # tag, style node, noise, in article
    pieces: list[str] = []
    owner = stack[0]

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((owner[1], owner[3], text))
            pieces.clear()

    def drop(index: int) -> None:
        nonlocal owner
        if any(entry[0] in BLOCK_TAGS or entry[2] != stack[index - 1][2] for entry in stack[index:]):
            flush()
        del stack[index:]

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at and not stack[-1][2]:
            if not pieces:
                owner = next((entry for entry in reversed(stack) if entry[0] in BLOCK_TAGS), stack[-1])
            pieces.append(page[at:stop])
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            for index in range(len(stack) - 1, 0, -1):
                if stack[index][0] == tag:
                    drop(index)
                    break
                if stack[index][0] in SCOPES and tag not in SCOPES and tag not in NOISE_TAGS and tag not in BLOCK_TAGS:
                    break
            continue
        attributes = found[3] or found[6] or ""
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            for index in range(len(stack) - 1, 0, -1):
                if stack[index][0] == "p":
                    drop(index)
                    break
                if stack[index][0] in BLOCK_TAGS:
                    break
        if tag in CLOSES:
            for index in range(len(stack) - 1, 0, -1):
                if stack[index][0] in CLOSES[tag]:
                    drop(index)
                elif stack[index][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID_TAGS:
            continue
        parent = stack[-1]
        names, noise = _names(tag, attributes, parent[3])
        # A body or article marked with such a word is still the page's content.
        noise = parent[2] or tag in NOISE_TAGS and not (parent[3] and tag in DOUBTFUL_TAGS) or noise and tag not in ("html", "body", "article", "main")
        if tag in RAW_TAGS:
            close = _RAW_END[tag].search(page, at)
            if not noise and tag in ("textarea", "title"):
                noise = True
            at = close.end()
            at = page.find(">", at) + 1 if at < end else end
            at = at or end
            continue
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if noise and not parent[2] and tag not in BLOCK_TAGS and pieces:
            pieces.append("")
        stack.append((tag, _style(parent[1], tag, names), noise, parent[3] or tag in KEPT_TAGS))
    flush()
    return out


def host_of(url: Column) -> Column:
    """Between :// and the next /, ? or #, lower-cased; empty without a scheme."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


BLOCKS = "array<struct<style:string,text:string>>"


def page_blocks(pages: DataFrame, html: str) -> DataFrame:
    """Append the text blocks of each page; a null html has none."""
    small_batches(pages.sparkSession)
    base = without(pages, ["__blocks"])
    position = base.columns.index(html)
    kind = pa.list_(pa.struct([("style", pa.string()), ("text", pa.string())]))
    columns = [c for c in base.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"style": s, "text": t} for s, _, t in parse(page)] if page else [] for page in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, kind)], names=[*columns, "__blocks"])

    rest = base.select(*[F.col(f"`{c}`") for c in columns])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields], f"__blocks {BLOCKS}"])
    return base.mapInArrow(run, schema)


def _entropies(nodes: DataFrame, by: str, name: str) -> DataFrame:
    """host, style, m (pages) and the entropy of a column over them, with m as the base of the logarithm; 1 for a single page."""
    counts = nodes.groupBy("__host", "style", by).agg(F.count(F.lit(1)).cast("double").alias("c"))
    merged = counts.groupBy("__host", "style").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    known = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    return merged.select("__host", "style", "m", known.alias(name))


def _sent(rows: DataFrame) -> DataFrame:
    kept = staged(rows)
    return F.broadcast(kept) if kept.count() <= MOST_SENT_NODES else kept


def low_nodes(blocks: DataFrame) -> DataFrame:
    """(host, style) of the nodes whose importance is low over the different pages of the host.

    Importance is the larger of two entropies, with the number of pages as the base of the logarithm: of the node's content and
    of its number of blocks. Copies of a page count once. With fewer than LEAST_PAGES pages it is averaged, by pages, with a prior
    that counts as LEAST_PAGES pages: the share of the hosts with so many pages on which a node of the same style is not low (1 if
    there are none). Block counts are looked at only where the content leaves it open.
    """
    texts = F.transform("__blocks", lambda b: F.struct(b["style"].alias("style"), F.xxhash64(b["text"]).alias("content")))
    pages = blocks.select("__host", F.xxhash64(texts).alias("page"), texts.alias("b")).dropDuplicates(["__host", "page"])
    nodes = pages.select("__host", "page", F.explode("b").alias("b")).groupBy("__host", "page", F.col("b.style").alias("style"))
    nodes = nodes.agg(F.sum(F.col("b.content").cast("decimal(38,0)")).alias("content"), F.count(F.lit(1)).alias("size"))
    content = staged(_entropies(nodes, "content", "by_content"))
    m, many = F.col("m"), F.col("m") >= LEAST_PAGES
    most = F.when(many, LOW_IMPORTANCE).otherwise(LOW_IMPORTANCE * (m + LEAST_PAGES) / m)
    open_nodes = _sent(content.filter((m > 1) & (F.col("by_content") < most)))
    sizes = _entropies(nodes.join(open_nodes.select("__host", "style"), ["__host", "style"], "left_semi"), "size", "by_size").drop("m")
    judged = staged(sizes.join(open_nodes, ["__host", "style"]).select("__host", "style", "m", F.greatest("by_content", "by_size").alias("importance")))
    own = judged.filter(many & (F.col("importance") < LOW_IMPORTANCE)).select("__host", "style")
    low_hosts = own.groupBy("style").agg(F.count(F.lit(1)).alias("low"))
    hosts = content.filter(many).groupBy("style").agg(F.count(F.lit(1)).alias("hosts"))
    prior = _sent(hosts.join(low_hosts, "style").select("style", (1 - F.col("low") / F.col("hosts")).alias("prior")))
    few = content.filter(m == 1).select("__host", "style", "m", F.lit(1.0).alias("importance")).unionByName(judged.filter(~many))
    shrunk = (m * F.col("importance") + LEAST_PAGES * F.col("prior")) / (m + LEAST_PAGES)
    return own.unionByName(few.join(prior, "style").filter(shrunk < LOW_IMPORTANCE).select("__host", "style"))


def extract_main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The pages without `html`, with `text` (blocks in page order, joined by two newlines; empty if none) and `n_chars` (long).

    A null or empty html has an empty text; a null url belongs to a host of its own; repeated rows get equal texts; an empty
    table gives an empty result; columns named text or n_chars are replaced. Texts are whole.
    """
    base = without(pages, ["text", "n_chars"])
    columns = [c for c in base.columns if c != html]
    blocks = staged(page_blocks(base.withColumn("__host", host_of(F.col(url))), html))
    low = staged(low_nodes(blocks))
    by_host = low.groupBy("__host").agg(F.collect_set("style").alias("__low"))
    by_host = F.broadcast(by_host) if low.count() <= MOST_SENT_NODES else by_host
    joined = blocks.join(by_host, "__host", "left")
    left = F.filter("__blocks", lambda b: F.col("__low").isNull() | ~F.array_contains(F.col("__low"), b["style"]))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n\n")
    return joined.select(*[F.col(f"`{c}`") for c in columns], text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
