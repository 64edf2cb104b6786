"""Main text of web pages by deducing the template of each host's pages.

Tokens are a page's containers, told apart by their path of elements, classes
and ids, with or without text of their own. Tokens with the same occurrence
vector over a host's pages form an equivalence class. A class is valid if it
occurs often enough and its tokens come in the same order on every page; a token
whose place among the others changes is a class of its own. Valid classes nest by
their paths into the host's template. A slot is what lies directly in a token,
behind one of the inner tokens of the same class or ahead of them all: it is
content or not by its place, by how much of it is links and by whether its text
ever changes. A page's text is that of its content slots, or what they hold inside
article or main where that is most of the page's text; markup that the template
lacks goes with the slot around it.

Occurrence vectors are never gathered: their xor of (page, count) hashes tells
them apart and is summed ahead of the shuffle. A template holds paths of a
tenth of the host's pages at least, so its size follows that of a page. Pages are
read four times: for the vectors, the order, the slots and the texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import chunks_of, table_of
from larder.session import settled

#: Share of a host's pages that a valid class occurs in.
SUPPORT = 0.1
#: Pages from which a text that never changes counts as part of the template.
LEAST_PAGES = 3
#: Share of a slot's characters in links from which it is a menu.
LINKS = 0.6
SLICE = 4 << 20
#: Templates that a task keeps at hand.
MOST_HELD = 200

# Elements of HTML, and words in classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object select textarea button canvas math head title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form dialog menu fieldset details ul ol dl table".split())
NOISE_TAGS = frozenset("nav footer aside form dialog menu".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer sidebar aside widget widgets related recommended ad ads advert adverts "
    "advertisement banner sponsor sponsored promo cookie cookies consent notice notices notification popup modal newsletter subscribe signup login share "
    "sharing social comment comments commentlist respond reply replies disqus search toolbar skip masthead topbar complementary contentinfo".split())
PAGE_WORDS = frozenset("header".split())
MAIN = frozenset("article main".split())
CODE = frozenset("script style".split())
BODY = re.compile(r"<body[\s>]", re.I)

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LETTERS = re.compile(r"[a-z]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"


def step_of(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    """A container's step in a path, numbers left out of its names, and the words in them."""
    names = [next(filter(None, m.groups()[1:]), "") for m in ATTRIBUTE.finditer(attributes)] if attributes.strip() else []
    words = sorted({w for n in names for w in LETTERS.findall(n.lower())})
    return tag + "".join("." + w for w in words), frozenset(words)


def noises(steps: list[tuple[str, str, frozenset[str]]]) -> tuple[bool, list[int]]:
    """Whether a path of (tag, step, words) leads to something beside the article by its tags, and the depths of the steps that say so by their words.

    Words on article or main, or on what is around them, say nothing, and nor
    does a form or header around them; an article in another is a comment or the like.
    """
    tags = [tag for tag, _, _ in steps]
    first = tags.index("article") if "article" in tags else -1
    last = len(tags) - 1 - tags[::-1].index("main") if "main" in tags else -1
    main, beside, named = max(first, last), False, []
    for k, (tag, _, words) in enumerate(steps):
        if tag in NOISE_TAGS and tag != "form":
            beside = True
        elif tag in ("html", "body") or k <= main:
            continue
        elif tag == "form" or words & NOISE_WORDS or main < 0 and (tag == "header" or words & PAGE_WORDS):
            named.append(k)
    return beside, named


def events_of(html: str) -> list[tuple]:
    """What a page holds, in its order: (path,) where a container opens, () where one closes, and (beside the article, inside article or main, text, characters in links) for a text block."""
    steps: list[tuple[str, str, frozenset[str]]] = []
    opened: list[str] = []
    out: list[tuple] = [("",)]
    numbers: list[int] = []  # of the open containers; 0 is the page
    held_by: Counter = Counter()  # characters outside links and menus by container
    endless: set[str] = set()
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            beside, named = noises(steps)
            inside = any(t in MAIN for t, _, _ in steps)
            if not beside:
                chars = len(text) - min(linked, len(text))
                for n in {0, *numbers}:
                    held_by[n] += chars
            out.append((beside, inside, text, linked, [numbers[k] for k in named]))
        held.clear()
        linked = 0

    def close(upto: int) -> None:
        for tag in reversed(opened[upto:]):
            if tag in CONTAINERS:
                steps.pop()
                numbers.pop()
                out.append(())
        del opened[upto:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            held.append(text)
            if "a" in opened:
                linked += len(text.strip())

    at = 0
    while m := TAG.search(html, at):
        add(html[at:m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        if m.group(1) or m.group(4):
            if tag in opened:
                if tag not in INLINE:
                    flush()
                close(len(opened) - 1 - opened[::-1].index(tag))
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            if not (m.group(3) or m.group(6) or "").endswith("/") and tag not in endless:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                body = BODY.search(html, at) if tag in ("head", "title") else None
                if end and not (body and body.start() < end.start()):
                    at = end.end()
                elif body:
                    at = body.start()
                elif tag in CODE:
                    at = len(html)
                else:
                    # Never closed: what follows is read as if the tag were not there.
                    endless.add(tag)
            continue
        if tag in VOID:
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            # A new block ends an open paragraph, a new list item, cell or row the one before.
            last = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
            for k in range(len(opened) - 1, -1, -1):
                if opened[k] in last.get(tag, ()) or opened[k] == "p":
                    close(k)
                    break
                if opened[k] in CONTAINERS:
                    break
        opened.append(tag)
        if tag in CONTAINERS:
            step, words = step_of(tag, m.group(3) or m.group(6) or "")
            steps.append((tag, step, words))
            numbers.append(len(out))
            out.append(("/".join(s for _, s, _ in steps),))
    add(html[at:])
    flush()
    # What holds most of the page's text is not beside it, whatever its name.
    most = {n for n, chars in held_by.items() if 2 * chars > held_by[0]}
    return [(e[0] or not most.issuperset(e[4]), *e[1:4]) if len(e) > 1 else e for e in out]


def tokens(pages: DataFrame) -> DataFrame:
    """(page, host, path, count) per page and path of its containers; the page itself has the empty path."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of(batch, "html", SLICE):
                rows = []
                for page, host, html in zip(*(part.column(c).to_pylist() for c in ("page", "host", "html"))):
                    count = Counter(e[0] for e in events_of(html or "") if len(e) == 1)
                    rows += [(page, host, path, n) for path, n in count.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page", "host", "path", "count"])

    return pages.mapInArrow(of, "page long, host string, path string, count long")


def classes(pages: DataFrame) -> DataFrame:
    """(host, tokens): tokens are (path, class) of the host's classes with enough support, their order not looked at."""
    by_path = settled(tokens(pages).groupBy("host", "path").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "count")).alias("vector")), "paths")
    # The page itself is a token of every page.
    hosts = by_path.where("path = ''").select("host", F.col("pages").alias("all"))
    held = by_path.join(hosts, "host").where(F.col("pages") >= F.col("all") * SUPPORT)
    own = held.groupBy("host", "vector").agg(F.min("path").alias("class"), F.collect_list("path").alias("paths"))
    each = own.select("host", "class", F.explode("paths").alias("path"))
    return each.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "class"))).alias("tokens"))


def per_page(part: pa.RecordBatch, name: str, held: dict) -> Iterator[tuple[str, str, dict]]:
    """(host, html, template) of the pages; a host's template is read from the column once."""
    column = part.column(name)
    for i, (host, html) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist())):
        if host not in held:
            if len(held) > MOST_HELD:
                held.clear()
            held[host] = {tuple(v for k, v in t.items() if k in ("path", "behind")): [v for k, v in t.items() if k not in ("path", "behind")] for t in column[i].as_py() or ()}
        yield host, html or "", held[host]


def ordered(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, tokens): the classes, those tokens a class of their own whose place among the others of their class is not the same on every page."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for part in chunks_of(batch, "html", SLICE):
                places: dict[tuple[str, str, str], tuple[int, int]] = {}
                for host, html, template in per_page(part, "tokens", held):
                    seen: Counter = Counter()
                    for path in dict.fromkeys(e[0] for e in events_of(html) if len(e) == 1):
                        if (path,) in template:
                            own = template[path,][0]
                            low, high = places.get((host, path, own), (seen[own], seen[own]))
                            places[host, path, own] = min(low, seen[own]), max(high, seen[own])
                            seen[own] += 1
                if places:
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c, pa.string()) for c in zip(*places)], *[pa.array(c, pa.int64()) for c in zip(*places.values())]], ["host", "path", "class", "low", "high"])

    placed = pages.join(found, "host").select("host", "html", "tokens").mapInArrow(of, "host string, path string, class string, low long, high long")
    each = placed.groupBy("host", "path", "class").agg((F.min("low") == F.max("high")).alias("stays"))
    own = F.when(F.col("stays"), F.concat(F.lit("="), "class")).otherwise(F.concat(F.lit("~"), "path")).alias("class")
    return each.select("host", "path", own).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "class"))).alias("tokens"))


def slots_of(html: str, template: dict) -> Iterator[tuple[tuple[str, str], bool, bool, str, int]]:
    """((path, token behind which it lies), beside, inside, text, characters in links) of the text blocks, in page order."""
    around: list[list[str]] = []  # path and last inner token of the template's tokens that are open
    opened: list[bool] = []  # whether an open container is in the template
    for e in events_of(html):
        if len(e) == 1:
            own = template.get(e)
            opened.append(own is not None)
            if own is not None:
                if around and template[around[-1][0],] == own:
                    around[-1][1] = e[0]
                around.append([e[0], ""])
        elif e:
            yield (*around[-1],) if around else ("", ""), *e
        elif opened.pop():
            around.pop()


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, slots): tokens are (path, class) of the valid classes, slots (path, behind, content) of what they leave open."""
    found = settled(ordered(pages, settled(classes(pages), "classes")), "tokens")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for part in chunks_of(batch, "html", SLICE):
                rows = []
                for host, html, template in per_page(part, "tokens", held):
                    slots: dict[tuple[str, str], list] = defaultdict(lambda: [True, False, 0, 0, 0])
                    for key, beside, inside, text, linked in slots_of(html, template):
                        s = slots[key]
                        s[0], s[1] = s[0] and beside, s[1] or inside
                        s[2] += len(text)
                        s[3] += linked
                        s[4] = crc32(text.encode("utf-8", "replace"), s[4])
                    rows += [(host, *key, *s) for key, s in slots.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["host", "path", "behind", "beside", "inside", "chars", "linked", "text"])

    seen = pages.join(found, "host").select("host", "html", "tokens").mapInArrow(
        of, "host string, path string, behind string, beside boolean, inside boolean, chars long, linked long, text long")
    by_slot = settled(seen.groupBy("host", "path", "behind").agg(
        F.count("*").alias("pages"), F.min("beside").alias("beside"), F.max("inside").alias("inside"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (F.min("text") != F.max("text")).alias("varies")), "slots")
    # What holds for a host as a whole: does any slot beside menus change.
    text = ~F.col("beside") & (F.col("inside") | (F.col("linked") < F.col("chars") * LINKS))
    whole = by_slot.groupBy("host").agg(F.max(text & F.col("varies")).alias("changes"))
    fixed = F.col("changes") & ~F.col("varies") & (F.col("pages") >= LEAST_PAGES)
    content = text & (F.col("inside") | ~fixed)
    slots = by_slot.join(whole, "host").select("host", "path", "behind", content.alias("content"))
    return found.join(slots.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "behind", "content"))).alias("slots")), "host", "left")


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Blocks come in page order, each on a line of its own; white space inside a
    block is one space, character references are decoded. Null and empty pages
    give an empty text, as do pages without any content slot. Pages without a
    host in their url share one template. Repeated rows each give their row; a
    null page_id or url stays null. No page gives no row.
    """
    own = table_of(pages, "page_id", "url", "html").select(
        F.monotonically_increasing_id().alias("page"), "page_id", "url", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"), "html")
    found = settled(templates(own.select("page", "host", "html")), "templates")
    kind = pages.schema["page_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        decided: dict = {}
        for batch in batches:
            for part in chunks_of(batch, "html", SLICE):
                texts = []
                for (_, html, template), (_, _, slots) in zip(per_page(part, "tokens", held), per_page(part, "slots", decided)):
                    kept = [(inside, text) for key, beside, inside, text, _ in slots_of(html, template) if not beside and (inside or slots.get(key, [True])[0])]
                    # An article or main with most of the page's text is the text; a smaller one is a part of it.
                    own = sum(len(text) if inside else -len(text) for inside, text in kept) >= 0
                    article = own and any(inside for inside, _ in kept)
                    texts.append("\n".join(text for inside, text in kept if inside or not article))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.join(found, "host", "left").select("page_id", "url", "host", "html", "tokens", "slots").mapInArrow(of, f"page_id {kind}, url string, text string, n_chars long")
