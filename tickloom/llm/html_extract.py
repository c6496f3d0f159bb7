"""Main text of web pages by deducing the template of each host.

The tokens of a page are its elements, told apart by their place in the document: the place of the parent, the name, and the
number among siblings of that name. Tokens of a host with the same occurrence vector, that is with equally many occurrences
on each page, form an equivalence class. A class is valid if it is on enough pages and equally often on each of them; valid classes nest along
the places and make up the host's template. What stands in a template token and in no deeper one is a slot. The article is what
remains in the deepest token that holds nearly all of the host's text, less furniture and slots that say the same on every page.
Names and attributes that mark furniture (menus, forms, notices) only take blocks away, and marks of the article
only narrow what the template has found, or stand in on pages without the host's article token.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.session import settle

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*(?:>|$)", re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
# Fixed values of HTML: elements by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select canvas audio video".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FURNITURE = frozenset("nav footer aside form button menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words in class and id values that mark furniture, and those that mark the text.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header login masthead menu"
    " modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related replies reply search share sharing sidebar signup skip"
    " social sponsor sponsored subscribe subscription toolbar tracking widget".split()
)
TEXT_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
# Fixed values of HTML: headings, and elements that hold a piece of a text and never all of it.
HEADINGS = frozenset("h1 h2 h3".split())
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd caption figcaption".split())
#: A class is valid if it occurs on this share of its host's pages.
SUPPORT = 0.5
#: The article's token has this share of the host's characters outside furniture.
SHARE = 0.75
#: Slots that say the same on every page belong to the template on hosts with so many different pages.
PAGES = 3
#: Longer paths are told apart by their hash.
PATH = 4096
#: The rows of a host are dealt into so many parts for joins.
PARTS = 16

FURNITURE_SLOT, PLAIN_SLOT, TEXT_SLOT = 0, 1, 2
#: Beside the kind of its slot a block tells whether it is a heading, whether it is a piece of a text, and how many levels above it the mark of the article is.
SLOT, HEADING, PIECE, LEVEL = 3, 4, 8, 4
_SIBLING = 0x1E3779B97F4A7C15


def _role(name: str, tag: str, inside_text: bool) -> int:
    """What an element makes of the slots in it."""
    if name in FURNITURE or name == "header" and not inside_text:
        return FURNITURE_SLOT
    marked = TEXT_SLOT if name in ("article", "main") else PLAIN_SLOT
    for kind, *values in _MARKS.findall(tag):
        value = next(filter(None, values), "")
        if kind.lower() == "role":
            if value.lower() in ROLES:
                return FURNITURE_SLOT
            marked = max(marked, TEXT_SLOT if value.lower() in ("main", "article") else PLAIN_SLOT)
            continue
        words = {w.lower() for w in _SPLIT.split(value)} if kind.lower() != "itemprop" else {value.lower()}
        if words & FURNITURE_WORDS and name not in ("html", "body"):
            return FURNITURE_SLOT
        if words & TEXT_WORDS and name not in ("html", "body"):
            marked = TEXT_SLOT
    return marked


def _id(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) >> 1


def _place(token: int, number: int) -> int:
    """The place of the sibling with this number, from 0, among those of a token; the first has the token's own id."""
    return (token + number * _SIBLING) & 0x7FFFFFFFFFFFFFFF


_ROOT = _id("")


def parse(html: str) -> tuple[dict[str, list[int]], list[tuple[int, int, str]]]:
    """Tokens of a page with (id, place of the parent, occurrences), and the blocks (place, kind, text), both in page order.

    Character references are decoded, white space inside a block is one blank; scripts, styles and comments give no text.
    """
    tokens: dict[str, list[int]] = {}
    blocks: list[tuple[int, int, str]] = []
    # name, path, place, kind of slot, depth, depth of the outermost mark of an article
    stack: list[tuple[str, str, int, int, int, int]] = [("", "", _ROOT, PLAIN_SLOT, 0, -1)]
    pieces: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            name, _, place, kind, depth, mark = next(x for x in reversed(stack) if x[0] not in INLINE)
            flags = (HEADING if name in HEADINGS else 0) | (PIECE if name in PIECES else 0)
            blocks.append((place, kind | flags | (depth - mark << LEVEL if kind == TEXT_SLOT else 0), text))

    def close(name: str, until: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        if not found:
            pieces.append(html[at:])
            break
        pieces.append(html[at : found.start()])
        tag, at = found[0], found.end()
        named = _NAME.match(tag)
        if not named:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if name not in INLINE:
                flush()
            close(name)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                close("p", frozenset({"button", "table", "td", "th", "div", "article", "section", "body", "li"}))
            if name in ("li", "dd", "dt", "option", "tr", "td", "th"):
                close(name, frozenset({"ul", "ol", "dl", "select", "table", "tr"} - {name}))
        _, path, place, role, depth, mark = stack[-1]
        if role != FURNITURE_SLOT:
            own = _role(name, tag, role == TEXT_SLOT)
            role = own if own == FURNITURE_SLOT else max(role, own)
        if name not in INLINE:
            path, depth = f"{path}/{name}", depth + 1
            if len(path) > PATH:
                path = f"~{xxhash.xxh3_128_hexdigest(path)}"
            token = tokens.setdefault(path, [0, place, 0])
            if not token[2]:
                token[0] = _id(path)
            place = _place(token[0], token[2])
            token[2] += 1
            if token[2] > 1:
                path = f"{path}[{token[2]}]"
        if role == TEXT_SLOT and mark < 0:
            mark = depth
        if name in RAW:
            if not tag.endswith("/>"):
                closing = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = closing.end() if closing else end
            continue
        if name not in VOID and not tag.endswith("/>"):
            stack.append((name, path, place, role, depth, mark))
    flush()
    return tokens, blocks


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, blocks = [], []
        for html in batch.column("html").to_pylist():
            found, texts = parse(html or "")
            tokens.append([{"path": t, "parent": p, "n": n} for t, p, n in found.values()])
            blocks.append([{"path": p, "kind": k, "text": t} for p, k, t in texts])  # a slot is what a block stands in
        token = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("n", pa.int64())]))
        block = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("text", pa.string())]))
        names = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(tokens, token), pa.array(blocks, block)], [*names, "tokens", "blocks"])


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, path, class): the tokens of each host's template, from parsed pages (host, page, tokens).

    The occurrence vector of a token is summed up as the sum of a hash of (page, occurrences) over the pages, so classes
    come from partial sums and no host is gathered. A class is valid if it is on at least ``support`` of the pages of the host and
    equally often on each of them. A token can only be nested in the template if its parent is in it; pages tell that when they walk the template from the top.
    """
    seen = pages.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)"))
    tokens = seen.groupBy("host", "path").agg(vector.alias("vector"), F.count(F.lit(1)).alias("on"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    valid = tokens.join(sizes, "host").where((F.col("on") >= support * F.col("pages")) & (F.col("least") == F.col("most")))
    return valid.select("host", "path", F.xxhash64("vector").alias("class"))


def _lists(column: pa.Array, *fields: str) -> Iterator[tuple]:
    """The rows of a column of lists of structs, or of longs, as tuples of python lists; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.flatten(), [0]
    for n in column.value_lengths().fill_null(0).to_pylist():
        offsets.append(offsets[-1] + n)
    flat = [values.field(f) for f in fields] if fields else [values]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield tuple(x.slice(a, b - a).to_pylist() for x in flat)


def weigh(tokens: tuple, blocks: tuple, template: set[int]) -> list[tuple[int, int, int, bool, int | None]]:
    """The template places of a page: (place, depth, characters inside, closed, what the slot says).

    A place is closed if it is a piece of a text, or below a heading's parent or a marked article: the article is never less than those.
    """
    parent_of, depth, inside = {_ROOT: _ROOT}, {_ROOT: 0}, {_ROOT: 0}
    for token, parent, n in zip(*tokens, strict=True):
        for i in range(n):
            place = _place(token, i)
            parent_of[place] = parent
            if token in template and parent in depth:
                depth[place], inside[place] = depth[parent] + 1, 0
    whole, pieces, says = set(), set(), {}
    for place, kind, chars, said in zip(*blocks, strict=True):
        if not kind & SLOT:
            continue
        if kind & PIECE:
            pieces.add(place)
        if kind & HEADING:
            whole.add(parent_of[place])
        if kind & SLOT == TEXT_SLOT:
            marked = place
            for _ in range(kind >> LEVEL):
                marked = parent_of[marked]
            whole.add(marked)
        if place in depth:
            says[place] = hash((says.get(place), said))
        while place not in depth:
            place = parent_of[place]
        inside[place] += chars
    closed: dict[int, bool] = {}
    for place in depth:  # parents stand before their children
        above = parent_of[place]
        closed[place] = place in pieces or place != _ROOT and (closed[above] or above in whole)
    for place in reversed(depth):
        if place != _ROOT:
            inside[parent_of[place]] += inside[place]
    return [(place, depth[place], inside[place], closed[place], says.get(place)) for place in depth if inside[place]]


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, rows = [], []
        lists = zip(_lists(batch.column("tokens"), "path", "parent", "n"), _lists(batch.column("blocks"), "path", "kind", "chars", "said"), _lists(batch.column("template")), strict=True)
        for host, (tokens, blocks, (template,)) in zip(batch.column("host").to_pylist(), lists, strict=True):
            found = weigh(tokens, blocks, set(template))
            hosts += [host] * len(found)
            rows += found
        place, depth, chars, closed, says = zip(*rows, strict=True) if rows else ([],) * 5
        columns = [pa.array(hosts, pa.string()), pa.array(place, pa.int64()), pa.array(depth, pa.int32()), pa.array(chars, pa.int64()), pa.array(closed, pa.bool_()), pa.array(says, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "place", "depth", "chars", "closed", "says"])


def choose(tokens: tuple, blocks: tuple, article: int | None, shared: set[int]) -> list[int]:
    """Numbers of the blocks of a page that are its text: those in the place of the article, on a page without such text all outside furniture.

    Where some of them are marked as the article they alone count; where none is, slots that say the same on every page go.
    """
    under = {_ROOT: article in (None, _ROOT)}
    for token, parent, n in zip(*tokens, strict=True):
        for i in range(n):
            place = _place(token, i)
            under[place] = under[parent] or place == article
    usable = [(i, place, kind & SLOT) for i, (place, kind) in enumerate(zip(*blocks, strict=True)) if kind & SLOT]
    usable = [x for x in usable if under[x[1]]] or usable
    marked = [i for i, _, kind in usable if kind == TEXT_SLOT]
    return marked or [i for i, place, _ in usable if place not in shared]


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        lists = zip(_lists(batch.column("tokens"), "path", "parent", "n"), _lists(batch.column("blocks"), "path", "kind", "text"), _lists(batch.column("shared")), strict=True)
        for article, (tokens, (places, kinds, texts), (shared,)) in zip(batch.column("article").to_pylist(), lists, strict=True):
            out.append(" ".join(texts[i] for i in choose(tokens, (places, kinds), article, set(shared))))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def article_places(parsed: DataFrame, template: DataFrame) -> DataFrame:
    """(host, article, shared): where the hosts have their text, and which slots say the same on all pages, from parsed pages and ``templates``.

    Closed places are never taken, so headings stay with their text. Places are weighed per page and summed up, no host is gathered;
    a row of the result is no longer than a page.
    """
    tokens = template.groupBy("host").agg(F.collect_list("path").alias("template"))
    light = F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["kind"].alias("kind"), F.char_length(b["text"]).alias("chars"), F.xxhash64(b["text"]).alias("said")))
    pages = join_hosts(parsed.select("host", "page", "tokens", light.alias("blocks")), tokens)
    places = pages.select("host", "tokens", "blocks", "template").mapInArrow(_weighed, "host string, place long, depth int, chars long, closed boolean, says long")
    summed = places.groupBy("host", "place").agg(
        F.max("depth").alias("depth"),
        F.sum("chars").alias("chars"),
        F.max("closed").alias("closed"),
        F.count("says").alias("on"),
        (F.min("says") == F.max("says")).alias("same"),
    )
    sizes = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("body").alias("bodies"), F.sum(F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.when(b["kind"].bitwiseAND(SLOT) > 0, F.char_length(b["text"])).otherwise(0))).alias("all"))
    weighed = summed.join(sizes, "host")
    fits = ~F.col("closed") & (F.col("chars") >= SHARE * F.col("all"))
    alike = F.col("same") & (F.col("on") >= SUPPORT * F.col("pages")) & (F.col("bodies") >= PAGES)
    return weighed.groupBy("host").agg(F.max_by("place", F.when(fits, F.col("depth"))).alias("article"), F.collect_list(F.when(alike, F.col("place"))).alias("shared"))


def join_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` with the row of their host; the pages of a host are dealt into parts, each with a copy of the row."""
    dealt = hosts.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return pages.withColumn("part", F.pmod("page", F.lit(PARTS)).cast("int")).join(dealt, ["host", "part"], "left")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text), a row for each row of ``pages`` (page_id, url, html).

    ``text`` is the text of the article, blocks joined by a blank in page order; empty if there is none, or if ``html`` is null. Pages
    whose ``url`` is null or has no host form one host. A host with one page has that page's tokens as its template. What stands for an element that can't be
    shown (in ``noscript``, ``iframe``, ``object``, ``canvas``, ``audio``, ``video``, ``svg`` or ``math``) is no text. A quote opens an attribute's value only
    after ``=``. Repeated rows and repeated ids each get their own text; other columns are ignored, an empty table gives none.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    page = F.xxhash64("page_id", "url", "html")
    ids = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {ids}, url string, host string, page long, body long, tokens array<struct<path:long,parent:long,n:long>>, blocks array<struct<path:long,kind:int,text:string>>"
    read = pages.select("page_id", "url", host.alias("host"), page.alias("page"), F.xxhash64("html").alias("body"), "html")
    parsed = settle(read.mapInArrow(_parsed, schema), "pages")
    places = settle(article_places(parsed, settle(templates(parsed), "templates")), "articles")
    rows = join_hosts(parsed, places).select("page_id", "url", "tokens", "blocks", "article", "shared")
    return rows.mapInArrow(_chosen, f"page_id {ids}, url string, text string")
