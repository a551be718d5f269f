"""Main text of web pages by consensus paths per host.

Each page's containers are scored (paragraph text that isn't links, as the container's own or its children's); the best one votes for its
generalised path of tags and classes (digits become one mark). Votes are counted per host in Spark; paths with a tenth of a host's votes
win. Every page is then read again: the elements on the winning path with the most votes that the page has (its own best container if it has none) give the
blocks, without menus, headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. Blocks that half of a host's pages share go, too, where they
are the smaller part of a container that isn't an article or main element. A class, id or role marks an element as one of those, but never one that holds the
page's article or main element or, on pages without one, most of the paragraph text; words for a header don't mark anything inside an article.

Defined cases: null or empty html gives an empty text; a page without any container gives the blocks that aren't dropped; a null url or one
without a host shares the empty host; repeated rows vote and are read one by one; of paths with equally many votes the smaller hash wins, of containers with equal scores
the first; an empty table gives an empty table; other columns are ignored, and a kept one named like a result is replaced by it; bytes that aren't UTF-8 count as U+FFFD; a very long or deep
page takes time and memory in proportion to its size.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sluice.llm.batches import map_batches, texts_of
from sluice.llm.scratch import Scratch

COMMON = 5  #: least pages on which a block is common
SHARE = 0.1  #: least share of its host's votes for a path to win: at most ten paths a host
# Possessive, and a tag ends before the next "<" outside of a quoted value: no place is read more than a few times.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^<>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# Elements of HTML that begin a block, that have no end, whose content isn't text, and that never hold the article.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OPAQUE = frozenset("script style template textarea title noscript iframe object svg canvas select option audio video".split())
APART = frozenset("nav aside footer form dialog menu button head fieldset".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
MARKED = re.compile(r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ads?|advert|adverts|advertisement|advertising|banner|promo|promoted|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|comment|comments|commentlist|respond|disqus|replies|social|share|sharing|related|recommended|breadcrumb|breadcrumbs|pagination|pager|widget|toolbar|skip|search|contentinfo|complementary)(?:$|[^a-z])")
MODIFIER = re.compile(r"(?:^|\s)(?:has|have|no|non|not|with|without|is|hide|show|enable|disable)[-_]+\S*")  # "has-sidebar" tells about the page, it isn't a sidebar
HEADINGS = re.compile(r"(?:^|(?<=[^a-z]))(?:header|masthead)(?=$|[^a-z])")
OWN_HEADINGS = re.compile(r"(?:^|(?<=[^a-z]))(?:entry|post|article|story|content|page|title)[-_]+header(?=$|[^a-z])")  # the article's, not the site's
SALTS = 16  #: parts of a host's pages in the join with its paths
COMMENTS = re.compile(r"(?:^|[^a-z])(?:comment|comments|commentlist|respond|disqus|replies)(?:$|[^a-z])")
_TITLES = frozenset(f"h{k}" for k in range(1, 7))
_CLOSES_P = BLOCKS - {"html", "head", "body"}
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class _Element:
    __slots__ = ("tag", "path", "parent", "dropped", "marked", "comment", "text", "links", "points")

    def __init__(self, tag: str, path: int, parent: int, dropped: bool, marked: bool = False, comment: bool = False):
        self.tag, self.path, self.parent, self.dropped, self.marked, self.comment = tag, path, parent, dropped, marked, comment
        self.text = self.links = 0
        self.points = 0.0


def _name(tag: str, attributes: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """Generalised name (tag and classes), whether the element is hidden, whether class, id or role mark it as not part of the article, and as reader comments."""
    if not attributes.strip():
        return tag, False, False, False
    found = {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(attributes)}
    classes = [re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()]
    marks = MODIFIER.sub(" ", " ".join([*classes, found.get("id", "").lower(), found.get("role", "").lower()]))
    marks = (HEADINGS if inside or tag in _TITLES else OWN_HEADINGS).sub("", marks)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "").lower()) is not None
    marked = MARKED.search(marks) is not None and (tag not in ("html", "body", "article", "main", "header") or tag == "article" and "comment" in marks or tag == "header" and not inside)
    return ".".join([tag, *sorted(set(classes))]), hidden, marked, marked and COMMENTS.search(marks) is not None


def _drop_marked(elements: list[_Element]) -> None:
    """Drop the marked elements and what they hold, save those around the page's article."""
    if not any(e.marked for e in elements):
        return
    prose, text, titles = [0] * len(elements), [e.text for e in elements], [e.tag == "h1" for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        if e.text >= 25 and e.links < 0.5 * e.text:
            prose[i] += e.text
        prose[e.parent] += prose[i]
        text[e.parent] += text[i]
        titles[e.parent] |= titles[i]
    main = max((i for i, e in enumerate(elements) if e.tag in ("article", "main") and text[i] and not e.dropped and not e.marked), key=lambda i: (not elements[i].comment, prose[i], text[i]), default=None)
    if main is None:
        total = prose[0]
        for i, e in enumerate(elements):
            if e.marked and 2 * prose[i] > total and (titles[i] or not e.comment):
                e.marked = False
    while main:
        elements[main].marked = False
        main = elements[main].parent
    for e in elements[1:]:
        e.dropped = e.dropped or e.marked or elements[e.parent].dropped
        if e.dropped:
            e.text = e.links = 0


@functools.lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^<>]*+>?", re.I)


def parse(source: str) -> tuple[list[_Element], list[tuple[int, str]]]:
    """Block elements in page order and the page's blocks as (element, text); what is dropped stays out of the blocks."""
    elements, blocks = [_Element("", 0, -1, False)], []
    stack, parts, link, at = [0], [], 0, 0
    opened, unended = Counter(), set()  # open elements by tag; tags that no end follows any more
    linked = False

    def flush() -> None:
        nonlocal link, linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                e = elements[stack[-1]]
                if not e.dropped:
                    blocks.append((stack[-1], text))
                    e.text += len(text)
                    e.links += min(link, len(text))
        link = 0

    def close(tag: str) -> None:
        while opened[tag]:
            top = elements[stack.pop()].tag
            opened[top] -= 1
            if top == tag:
                return

    size = len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        raw = source[at : m.start() if m else size]
        if raw and not elements[stack[-1]].dropped:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if linked:
                link += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag, ends = tag.lower(), m[1]
        if tag in OPAQUE:
            if not ends and not m[3].endswith("/"):
                stop = None if tag in unended else _end_of(tag).search(source, at)
                if not stop:
                    unended.add(tag)
                at = stop.end() if stop else size if tag in ("script", "style", "title", "textarea") else at
            continue
        if tag == "a":
            linked = not ends
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS and tag != "button":
            continue
        flush()
        linked = False
        if ends:
            close(tag)
        elif tag not in VOID:
            top = elements[stack[-1]]
            if tag in _CLOSES_P and top.tag == "p" or tag == top.tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                opened[elements[stack.pop()].tag] -= 1
                top = elements[stack[-1]]
            inside = opened["article"] + opened["main"] > 0
            name, hidden, marked, comment = _name(tag, m[3], inside)
            apart = tag in APART or tag == "header" and not inside
            path = xxhash.xxh3_64_intdigest(name.encode(errors="replace"), top.path)  # of all names from the page's root down
            elements.append(_Element(tag, path, stack[-1], top.dropped or hidden or apart, marked, top.comment or comment))
            stack.append(len(elements) - 1)
            opened[tag] += 1
    flush()
    _drop_marked(elements)
    return elements, [b for b in blocks if not elements[b[0]].dropped]


def best_container(elements: list[_Element]) -> int:
    """Index of the container with the best score, or of the page (0); an article or main element around it stands for it."""
    text, links = [e.text for e in elements], [e.links for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        if e.dropped:
            continue
        if e.text >= 25 and e.links < 0.5 * e.text:
            points = 1 + e.text / 100
            up = e.parent if e.tag not in CONTAINERS else i
            elements[up].points += points
            if elements[up].parent >= 0:
                elements[elements[up].parent].points += points / 2
        text[e.parent] += text[i]
        links[e.parent] += links[i]
    best, most = 0, 0.0
    for i, e in enumerate(elements):
        if e.tag in CONTAINERS and not e.dropped and e.points:
            score = e.points * (1 - links[i] / max(1, text[i])) * (1.5 if e.tag in ("article", "main") else 1.0)
            if score > most:
                best, most = i, score
    k = best
    while k > 0:
        if elements[k].tag in ("article", "main"):
            best = k
        k = elements[k].parent
    return best


def _block_hash(path: int, text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode(errors="replace"), path))


def extract(source: str, paths: list[int], common: frozenset[int] = frozenset()) -> str:
    """Text of the elements on the first of ``paths`` that the page has, else of its own best container.

    Blocks in ``common`` (of most pages of the host) are left out where they are the smaller part of a container that isn't marked up as the article.
    """
    elements, blocks = parse(source)
    there = {_signed(e.path) for e in elements if not e.dropped}
    path = next((p for p in paths if p in there), None)
    if path is None:
        chosen = {best_container(elements)}
    else:
        chosen = {i for i, e in enumerate(elements) if _signed(e.path) == path and not e.dropped}
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = i in chosen or i > 0 and inside[e.parent]
    kept = [(i, t) for i, t in blocks if inside[i]]
    if common and not any(elements[i].tag in ("article", "main") for i in chosen):
        own = [(i, t) for i, t in kept if _block_hash(elements[i].path, t) not in common]
        if 2 * sum(len(t) for _, t in own) > sum(len(t) for _, t in kept):
            kept = own
    return "\n\n".join(t for _, t in kept)


def _signed(path: int) -> int:
    return path - (path >> 63 << 64)


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def votes(df: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, block, n): votes of the pages' best containers (block false), and on how many pages a block is that lies in one without article or main element."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter()
        for host, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            if raw:
                elements, blocks = parse(raw.decode(errors="replace"))
                best = elements[best_container(elements)]
                found[host, _signed(best.path), False] += 1
                if best.tag not in ("article", "main"):
                    for h in {_block_hash(elements[i].path, t) for i, t in blocks}:
                        found[host, h, True] += 1
        rows = sorted(found.items())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["host", "path", "block", "n"])

    counted = map_batches(df.select(host_of(F.col(url)).alias("host"), F.col(html)), run, "host string, path long, block boolean, n long")
    return counted.groupBy("host", "path", "block").agg(F.sum("n").alias("n"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, paths, common): the winning paths, those with the most votes first, at most ten a host; and the blocks that at least ``COMMON`` and half of its pages have,
    fewer than twice as many as a page has blocks."""
    total = counted.where("not block").groupBy("host").agg(F.sum("n").alias("total"))
    rows = counted.join(total, "host")
    won = rows.where(~F.col("block") & (F.col("n") >= SHARE * F.col("total")) & (F.col("path") != 0))
    won = won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "path"))), lambda x: x["path"]).alias("paths"))
    most = rows.where(F.col("block") & (F.col("n") >= COMMON) & (2 * F.col("n") >= F.col("total"))).groupBy("host").agg(F.collect_list("path").alias("common"))
    return won.join(most, "host", "left")


def main_text(df: DataFrame, *, url: str = "url", html: str = "html", keep: list[str], scratch: Scratch | None = None) -> DataFrame:
    """``keep`` columns plus text and n_chars.

    The winners are a written table with one short row a host, so Spark broadcasts it if it is small; else a host's pages meet its paths in ``SALTS`` parts.
    """
    scratch = scratch or Scratch(df.sparkSession, "pages")
    keep = [c for c in keep if c.lower() not in ("text", "n_chars")]
    won = scratch.table(winners(scratch.table(votes(df, url=url, html=html), "votes")), "winners")
    won = won.select(F.col("host").alias("__h"), F.col("paths").alias("__paths"), F.col("common").alias("__common"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__part"))
    rows = df.withColumns({"__host": host_of(F.col(url)), "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))})
    rows = rows.join(won, (F.col("__host") == F.col("__h")) & (F.col("__salt") == F.col("__part")), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths, common, raw = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), texts_of(batch.column(batch.num_columns - 1))
        texts = [extract(r.decode(errors="replace"), p or [], frozenset(c or [])) if r else "" for r, p, c in zip(raw, paths, common, strict=True)]
        more = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-3], *more], names=[*keep, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)
    return map_batches(rows.select(*keep, "__paths", "__common", F.col(html).alias("__html")), run, fields + "text string, n_chars long")
