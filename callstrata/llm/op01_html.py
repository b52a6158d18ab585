"""Main text of web pages by equivalence-class template deduction.

Every page becomes tokens: its element paths and its blocks of text under their paths. Over the pages of a host each token has an
occurrence vector, kept as a fingerprint that is combined page by page. Tokens with equal vectors are a class; classes that are
large and frequent enough are valid and nest by their paths into the host's template. Text inside the template is furniture of the site. What
remains are slots. The region that holds a page's article is the lowest element around all its article and main elements, or
without them around all its text outside of links. Each page gives the blocks of that region.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are left out by element, role and the words of their class
or id, in any host. A host with few pages has no template; there the page's own elements decide.

Defined results: null or empty html gives an empty text; a page without any main block gives an empty text; a null url is a host
of its own; repeated rows give repeated result rows and count once as evidence, as do pages with equal html.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.llm.text import staged

#: A host's template needs so many different pages; a valid class occurs in so large a share of them and has so many tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 4, 0.8, 2
#: Elements that are blocks of a text and no region.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote".split())
SMALL = 200_000

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head script style noscript template title textarea iframe object svg canvas audio video map nav footer aside form button select option dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name parts beside the article; words that deny it ("with-sidebar"); words of a header that is the article's own.
SIDE_WORDS = frozenset("""
ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar
widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments
disqus respond reply replies share sharing social related recommended recommendations footer copyright pagination pager toolbar topbar masthead search
""".split())
DENYING_WORDS = frozenset("with has no without".split())
OWN_WORDS = frozenset("article entry post".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section main aside div body td th form nav header footer".split())


@dataclass
class Element:
    tag: str
    label: str
    out: bool
    main: bool


@dataclass
class Block:
    path: str
    text: str
    links: int
    out: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    paths: Counter = field(default_factory=Counter)


def element(tag: str, raw: str, parent: Element | None) -> Element:
    """An element below its parent: its label in paths, and whether it lies outside of any article text."""
    attrs = {m[0].lower(): (m[1] or m[2] or m[3]) for m in ATTR.findall(raw)} if raw.strip(" /") else {}
    named = WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    role = attrs.get("role", "").lower()
    main = bool(parent and parent.main) or tag in ("article", "main") or role in ("main", "article")
    out = bool(parent and parent.out)
    if not out and tag not in ("html", "body"):
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        side = bool(SIDE_WORDS.intersection(named)) and not DENYING_WORDS.intersection(named)
        head = (tag == "header" or "header" in named) and not main and not OWN_WORDS.intersection(named)
        out = tag in DROPPED or role in DROPPED_ROLES or hidden or head or side and tag != "main"
    label = tag + "".join(f".{w}" for w in sorted(set(named))) + (f"[{role}]" if role else "")
    return Element(tag, label, out, main)


def parse(html: str) -> Page:
    """Blocks and element paths of a page, tolerant of tags that are missing or out of place."""
    page, stack, buffer = Page(), [], []
    in_link, links, pos = 0, 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            page.blocks.append(Block("/".join(e.label for e in stack), text, min(links, len(text)), bool(stack and stack[-1].out)))
        links = 0

    def text_run(raw: str) -> None:
        nonlocal links
        if raw:
            raw = html_lib.unescape(raw) if "&" in raw else raw
            buffer.append(raw)
            if in_link:
                links += len(raw)

    def close(tags: tuple[str, ...], stop: frozenset) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while (m := TAG.search(html, pos)) is not None:
        text_run(html[pos:m.start()])
        pos = m.end()
        end, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if end else 1
            continue
        if tag in VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        if end:
            in_link = 0
            if any(e.tag == tag for e in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, pos)
            pos = stop.end() if stop else len(html)
            continue
        if tag == "body":
            close(("head",), frozenset())
        close(("p",), SCOPES)
        if tag in CLOSES:
            close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table")))
        if re.fullmatch("h[1-6]", tag):
            close(("h1", "h2", "h3", "h4", "h5", "h6"), SCOPES)
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        stack.append(element(tag, raw, stack[-1] if stack else None))
        page.paths["/".join(e.label for e in stack)] += 1
    text_run(html[pos:])
    flush()
    return page


def hashed(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def held(blocks: list[Block]) -> dict[str, list[int]]:
    """Per path the characters of text that count as article text below it, and all characters."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for b in blocks:
        steps = b.path.split("/")
        plain = 0 if b.out else max(0, len(b.text) - 2 * b.links)
        for k in range(1, len(steps) + 1):
            cell = out["/".join(steps[:k])]
            cell[0] += plain
            cell[1] += len(b.text)
    return out


def is_main(path: str) -> bool:
    last = path.rsplit("/", 1)[-1]
    return re.match(r"(?:article|main)(?![a-z])", last) is not None or last.endswith(("[main]", "[article]"))


def region(chars: dict[str, int]) -> str | None:
    """The path that holds the article ("" for all blocks), given the article characters below every path: the lowest common
    ancestor of the article and main elements, or else of all blocks; never a block itself."""
    chars = {p: n for p, n in chars.items() if n > 0}
    own = dict(chars)
    for p, n in chars.items():
        if "/" in p and (above := p.rpartition("/")[0]) in own:
            own[above] -= n
    paths = [p.split("/") for p in chars if is_main(p)] or [p.split("/") for p, n in own.items() if n > 0]
    if not paths:
        return None
    low, high = min(paths), max(paths)
    steps = low[:next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))]
    while steps and re.split(r"[.\[]", steps[-1], maxsplit=1)[0] in BLOCKS:
        steps.pop()
    return "/".join(steps)


def deduce(tokens: list[dict], n_pages: int) -> dict:
    """Template of a host from its frequent tokens: the region, furniture texts, and the nested valid classes."""
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in tokens:
        classes[t["pages"], t["vector"]].append(t)
    valid = {k: v for k, v in classes.items() if len(v) >= LEAST_TOKENS}
    chars = {t["path"]: t["plain"] for ts in valid.values() for t in ts if t["path"] is not None}
    roots = {k: min((t["path"] for t in ts if t["path"]), key=lambda p: (p.count("/"), p), default=None) for k, ts in valid.items()}

    def parent(k: tuple) -> str | None:
        above = [r for o, r in roots.items() if r and roots[k] and o != k and o[0] >= k[0] and roots[k].startswith(r + "/")]
        return max(above, key=len, default=None)

    nested = sorted(f"{parent(k) or ''} > {roots[k]} ({len(ts)} tokens, {k[0]} pages)" for k, ts in valid.items() if roots[k])
    return {"region": region(chars), "furniture": sorted({t["token"] for ts in valid.values() for t in ts if t["path"] is None}), "classes": nested, "pages": n_pages}


TOKENS = "host string, token long, html long, n int, path string, plain long"
TEMPLATE = "host string, pages long, region string, furniture array<long>, classes array<string>"
PAGE = "#page"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64())
    names = ["host", "token", "html", "n", "path", "plain"]
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page, key = parse(html), hashed(html)
            chars = held(page.blocks)
            rows.append((host, hashed(PAGE), key, 1, PAGE, 0))
            rows += [(host, hashed(p), key, n, p, chars[p][0] if p in chars else 0) for p, n in page.paths.items()]
            texts = Counter(hashed(b.path, b.text) for b in page.blocks)
            rows += [(host, t, key, n, None, 0) for t, n in texts.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = batch.column("host").to_pylist()
        made = [deduce(t, n) for t, n in zip(batch.column("tokens").to_pylist(), batch.column("pages").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array([m["pages"] for m in made], pa.int64()), pa.array([m["region"] for m in made], pa.string()),
             pa.array([m["furniture"] for m in made], pa.list_(pa.int64())), pa.array([m["classes"] for m in made], pa.list_(pa.string()))],
            ["host", "pages", "region", "furniture", "classes"])


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, host (never null), html (never null)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def templates(hosted: DataFrame) -> DataFrame:
    """One row per host with enough pages: number of pages, region path, furniture texts, nested classes.

    Occurrence vectors are combined by hash over the different pages of the host, so no page list is ever gathered. Only tokens on
    most pages of a host come together, about as many as a page has.
    """
    rows = hosted.filter("html <> ''").select("host", "html").mapInArrow(_tokens, TOKENS)
    once = rows.groupBy("host", "token", "html").agg(F.max("n").alias("n"), F.max("path").alias("path"), F.max("plain").alias("plain"))
    seen = staged(once.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("html", "n")).alias("vector"), F.max("path").alias("path"), F.sum("plain").alias("plain")).filter(F.col("pages") >= LEAST_PAGES))
    totals = seen.filter(F.col("path") == PAGE).select("host", F.col("pages").alias("total"))
    frequent = seen.join(totals, "host").filter((F.col("pages") >= LEAST_SHARE * F.col("total")) & (F.coalesce(F.col("path"), F.lit("")) != PAGE))
    grouped = frequent.groupBy("host").agg(F.max("total").alias("pages"), F.collect_list(F.struct("token", "pages", "vector", "path", "plain")).alias("tokens"))
    return staged(grouped.mapInArrow(_deduce, TEMPLATE))


def main_text(html: str, template: str | None, furniture: frozenset) -> str:
    """Blocks of the article joined by line breaks: those of the page's own region, or without any those of the template's."""
    page = parse(html)
    kept = [b for b in page.blocks if not b.out and hashed(b.path, b.text) not in furniture] if furniture else [b for b in page.blocks if not b.out]
    for root in (region({p: c[0] for p, c in held(kept).items()}), template):
        if root is not None and (own := [b.text for b in kept if not root or b.path == root or b.path.startswith(root + "/")]):
            return "\n".join(own)
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, known = [], {}
        for i, html in enumerate(batch.column("html").to_pylist()):
            host = batch.column("host")[i].as_py()
            if host not in known:
                known[host] = frozenset(batch.column("furniture")[i].as_py() or ())
            texts.append(main_text(html, batch.column("region")[i].as_py(), known[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    hosted = with_host(pages)
    made = templates(hosted).select("host", "region", "furniture")
    few = F.broadcast(made) if made.count() <= SMALL else made
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return hosted.join(few, "host", "left").select("page_id", "url", "host", "html", "region", "furniture").mapInArrow(_extract, f"{kinds}, text string, n_chars long")


def op1_template_classes(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
