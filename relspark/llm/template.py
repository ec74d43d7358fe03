"""Operator 1: HTML extraction by template deduction from equivalence classes.

A page is a sequence of tokens: start tags, told apart by their path of tags and classes, and text runs, told apart by
path and text. Two tokens of the same host are equivalent if their occurrence vectors, how often each occurs on each of
the host's pages, are equal. Vectors are compared by two sums over pages of a hash of (page, count), which tasks and the
shuffle add up, so that no host's pages ever meet. A class is valid if it is found on ``LEAST_PAGES`` pages and
``LEAST_SHARE`` of the host's, and holds ``LEAST_TOKENS`` tokens or a tag. The tags of valid classes that occur once on
each of their pages are the template's places; the paths of their parents nest them into a tree, whose places between
the tokens are the slots.

The main slot is found by walking down the tree from its root: into the place that holds the larger part of the text
that isn't link text on all pages of the host together, until a place is a text element, has a heading of its own or is
named as an article or main element. On a page that has the place, the text is taken from it, whatever the names of the
elements around it. What the template fixes inside is left out: text runs that stand on nearly every page
(``FIXED_SHARE``), unless they are most of the host's text (near copies). Names label what else is in the slot: menus,
sidebars, notices, adverts, forms and comments nested in it go, if an element that holds others is of such a tag, or if a
whole class or id is made of such words (see ``named``). Pages of hosts with too few pages, or without the host's main
place, are read by names alone: the largest article, else main element, else element named as content, else the page.

Words of a run are not tokens of their own: that a frequent word stands equally often on a host's few pages would make
it part of the template, and it would be missing from their articles.

Templates are rows by host, of a size bounded by a page's tokens; they are joined to pages by host, with Spark free to
split a host with many pages. Defined cases: a null or empty page has an empty text; a null URL, or a host with few
pages, has no template; ids may be null or repeated; unclosed elements end with their parent; text that is only found
under names of furniture is main text after all; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, rows_of, small_batches, stored

LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 3, 0.5, 3
#: The main place holds this share of the text of the place around it; an article or main element needs this one.
MAIN_SHARE, NAMED_SHARE = 0.5, 0.25
#: A text run is furniture if the template has it on this share of pages (within an article: this one).
FIXED_SHARE, ARTICLE_SHARE = 0.8, 0.95
#: A host whose fixed runs make up more than this share of all characters of its articles (of the texts of its pages without
#: one) serves copies of one article: what they share is text, not furniture.
COPIED_ARTICLE, COPIED_PAGE = 0.5, 0.8

#: A quoted value may be of any length; a quote that nothing closes ends with its tag, at the next < or >.
_TOKEN = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|object|svg|math|canvas|audio|video|select|button|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+(?:[\"'][^<>]*+)?)>|<[!?/][^<>]*>|[^<]+|<"
)
_ATTR = re.compile(r"(?i)\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an open element of the same kind (or of those named) ends with.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
HEADINGS = frozenset("h1 h2 h3".split())
#: Elements of text, which are main places never, and furniture only by a name of ``ADVERTS``.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl dt dd li figure figcaption caption b i em strong a span u small code q cite mark sub sup abbr time font label tr td th tbody thead tfoot table address".split())
#: Tags, roles and words of class names and ids that say what an element is.
FURNITURE = frozenset("nav footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
CONTENT = frozenset("article content post entry story main".split())
ADVERTS = frozenset("ad ads adsense advert adverts advertisement advertisements sponsor sponsored sponsors".split())
NAMES = ADVERTS | frozenset(
    "banner promo promos promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar sidenav aside widget widgets notice notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription signup login comment comments reply replies disqus share sharing social related recommended pagination pager copyright hidden toolbar skip".split()
)
#: Words that say where or how, beside one of ``NAMES``.
NEUTRAL = frozenset("site page top bottom left right main primary secondary global box bar area list links buttons block section container wrapper wrap inner outer panel item items row column col thread posts articles form media icons text body title".split())


def named(value: str) -> bool:
    """Whether a class or id value has a name that is made of words of ``NAMES`` and ``NEUTRAL``, one of the former at least."""
    for name in value.split():
        words = _NAME.findall(name)
        if any(w in NAMES for w in words) and all(w in NAMES or w in NEUTRAL for w in words):
            return True
    return False


class _Element:
    """An element: its tag's path, its parent, whether it or one around it is furniture (``odd``: the innermost such
    element's number, or -1), its rank as a holder of the main text and the innermost holder around it or itself."""

    __slots__ = ("block", "end", "holder", "link", "name", "odd", "parent", "path", "rank")

    def __init__(self, name: str, path: int, parent: int, block: int, odd: int, rank: int, holder: int, link: bool) -> None:
        self.name, self.path, self.parent, self.block, self.odd, self.rank, self.holder, self.link = name, path, parent, block, odd, rank, holder, link
        self.end = -1


class Page:
    """A parsed page: elements in the order of their start tags, and blocks (text, path, element, characters of links).

    Elements of rank 3 are articles, of 2 main elements, of 1 elements named as content; element 0 is the page.
    """

    def __init__(self, html: str) -> None:
        self.elements = [_Element("", 0, -1, 0, -1, 0, 0, False)]
        self.blocks: list[tuple[str, int, int, int]] = []
        #: paths of start tags that hold nothing
        self.voids: list[int] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        elements = self.elements
        stack, open_names = [0], {"": 1}
        text: list[str] = []
        links = 0

        def flush() -> None:
            nonlocal links
            if text:
                s = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if s:
                    k = stack[-1]
                    self.blocks.append((s, elements[k].block, k, min(links, len(s))))
            links = 0

        def pop() -> None:
            e = elements[stack.pop()]
            e.end = len(elements)
            open_names[e.name] -= 1

        for m in _TOKEN.finditer(html):
            name = m["name"]
            if name is None:
                if m[0] == "<" or m[0][0] != "<":
                    text.append(m[0])
                    if elements[stack[-1]].link:
                        links += len(m[0])
                continue
            name = name.lower()
            if name in BLOCK:
                flush()
            if m["close"]:
                if open_names.get(name):
                    depth = next(k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].name == name)
                    # inline elements end within their block, unless they are furniture in it
                    before = elements[stack[depth - 1]].odd
                    if any(elements[k].odd != before or elements[k].name in BLOCK for k in stack[depth:]):
                        flush()
                    while len(stack) > depth:
                        pop()
                continue
            if name in BLOCK and open_names.get("p") and name != "br":
                depth = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].name == "p" or elements[stack[k]].name in BLOCK), 0)
                if elements[stack[depth]].name == "p":
                    while len(stack) > depth:
                        pop()
            for other in CLOSES.get(name, ()):
                if open_names.get(other):
                    depth = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].name == other or elements[stack[k]].name in SCOPE.get(name, ("table", "select", "datalist"))), 0)
                    if elements[stack[depth]].name == other:
                        while len(stack) > depth:
                            pop()
            found = {a.lower(): (x or y or z or "").lower() for a, x, y, z in _ATTR.findall(m["attrs"])} if m["attrs"].strip() else {}
            classes, top = found.get("class", ""), elements[stack[-1]]
            path = xxhash.xxh3_64_intdigest(f"{top.path}>{name}.{classes}") >> 1
            if name in VOID:
                self.voids.append(path)
                continue
            own = len(elements)
            odd, rank, role = False, 0, found.get("role")
            if name not in ("html", "body"):
                inside = elements[top.holder].rank >= 2
                both = f"{classes} {found.get('id', '')}"
                if "hidden" in found or found.get("aria-hidden") == "true" or role in ROLES or name in FURNITURE or name == "header" and not inside:
                    odd = True
                elif name == "header":
                    pass
                elif name in TEXTUAL:
                    odd = any(w in ADVERTS for w in both.split())
                else:
                    odd = named(both) and not (inside and "header" in both)
                if name == "article":
                    rank = 3
                elif name == "main" or role in ("main", "article") or found.get("itemprop") == "articlebody":
                    rank = 2
                elif name in ("div", "section", "td") and any(w in CONTENT for w in _NAME.findall(both)):
                    rank = 1
            if (own if odd else top.odd) != top.odd:
                flush()
            elements.append(_Element(name, path, stack[-1], path if name in BLOCK else top.block, own if odd else top.odd, rank, own if rank and not odd else top.holder, top.link or name == "a"))
            stack.append(own)
            open_names[name] = open_names.get(name, 0) + 1
        flush()
        while stack:
            e = elements[stack.pop()]
            e.end = len(elements)

    def within(self, root: int) -> list[tuple[str, int, int, int]]:
        """The blocks below an element, but those that are furniture in it; all of them, if there are no others."""
        end = self.elements[root].end
        below = [b for b in self.blocks if root <= b[2] < end]
        return [b for b in below if self.elements[b[2]].odd <= root] or below

    def main(self, root: int = 0) -> tuple[list[tuple[str, int, int, int]], int]:
        """The blocks of the holder below ``root`` that holds the main text, and its rank."""
        below = self.within(root)
        size: dict[int, int] = {root: 0}
        for s, _, k, _ in below:
            h = self.elements[k].holder
            while h > root:
                size[h] = size.get(h, 0) + len(s)
                h = self.elements[self.elements[h].parent].holder
            size[root] += len(s)
        rank = lambda k: self.elements[k].rank if k else 0
        if rank(root) >= 2:
            return below, rank(root)
        best = max(size, key=lambda k: (rank(k) if size[k] else -1, size[k], -k))
        return [b for b in below if best <= b[2] < self.elements[best].end], rank(best)


def _run(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}") >> 1


def main_text(html: str | None, place: int | None = None, fixed: frozenset[int] = frozenset(), fixed_inside: frozenset[int] = frozenset()) -> str:
    """The main text of a page. Of its host's template: ``place`` is the path of the main place, ``fixed`` are text runs,
    ``fixed_inside`` those also within articles."""
    if not html:
        return ""
    page = Page(html)
    root = next((k for k, e in enumerate(page.elements) if e.path == place), 0) if place else 0
    inside, rank = page.main(root)
    drop = fixed_inside if rank >= 2 else fixed
    kept = [s for s, path, *_ in inside if not drop or _run(path, s) not in drop]
    return " ".join(kept or [s for s, *_ in inside])


def main_place(places: list[tuple], root_chars: int) -> int | None:
    """The main place of a host's template: (path, parent's path, name, rank, whether furniture, characters) of its places.

    Characters are those that aren't link text, below the place on all pages; ``root_chars`` are those of whole pages.
    """
    below: dict[int, list[tuple]] = {}
    for p in places:
        below.setdefault(p[1], []).append(p)
    best = max((p for p in places if p[3] >= 2 and not p[4]), key=lambda p: (p[3], p[5]), default=None)
    if best and best[5] >= NAMED_SHARE * root_chars:
        return best[0]
    at, chars, found = 0, root_chars, None
    while True:
        inner = [p for p in below.get(at, ()) if p[2] not in TEXTUAL and not p[4]] or [p for p in below.get(at, ()) if p[2] not in TEXTUAL and p[2] not in FURNITURE]
        nxt = max(inner, key=lambda p: p[5], default=None)
        if nxt is None or nxt[5] < MAIN_SHARE * chars or not nxt[5] or found and any(p[2] in HEADINGS for p in below.get(at, ())):
            return found
        at, _, name, rank, _, chars = nxt
        if name not in ("html", "body"):
            found = at
        if rank >= 2:
            return found


def occurrences(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """A host's tokens with their vectors' sums, summed in tasks first.

    (host, token, tag, parent, name, rank, odd): of a tag its parent's path, name, rank and whether it is furniture. Sums:
    a, b, pages, total (occurrences), chars (of a tag: of text below it that isn't link text), inside and loose (of a
    run: characters in main texts that are articles, and in others); token 0 has those of whole pages.
    """
    kinds = "host string, token long, tag boolean, parent long, name string, rank int, odd boolean, a long, b long, pages long, total long, chars long, inside long, loose long"
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in kinds.split(", ")])

    def run(batches):
        held: dict[tuple, list[int]] = {}
        for hosts, ids, urls, texts in rows_of(batches):
            for host, i, u, text in zip(hosts, ids, urls, texts, strict=True):
                if not text or not host:
                    continue
                page = Page(text)
                elements = page.elements
                chars = [0] * len(elements)
                for s, _, k, links in page.blocks:
                    chars[k] += len(s) - links
                for k in range(len(elements) - 1, 0, -1):
                    chars[elements[k].parent] += chars[k]
                # token: occurrences, characters, characters inside, loose
                counts: dict[tuple, list[int]] = {}
                for k, e in enumerate(elements):
                    key = (e.path, True, elements[e.parent].path if k else 0, e.name, e.rank, e.odd == k)
                    x = counts.setdefault(key, [0, 0, 0, 0])
                    x[0] += 1
                    x[1] += chars[k]
                for path in page.voids:
                    counts.setdefault((path, True, 0, "", 0, False), [0, 0, 0, 0])[0] += 1
                for s, path, *_ in page.blocks:
                    counts.setdefault((_run(path, s), False, 0, "", 0, False), [0, 0, 0, 0])[0] += 1
                main, rank = page.main()
                for s, path, *_ in main:
                    counts[_run(path, s), False, 0, "", 0, False][2 if rank >= 2 else 3] += len(s)
                    counts[0, True, 0, "", 0, False][2 if rank >= 2 else 3] += len(s)
                for key, (n, *sizes) in counts.items():
                    x = xxhash.xxh3_64_intdigest(f"{i} {u} {n}")
                    sums = held.setdefault((host, *key), [0] * 7)
                    for j, v in enumerate((x & 0x7FFFFFFF, x >> 33, 1, n, *sizes)):
                        sums[j] += v
            if len(held) > 200_000:
                yield from small_batches(schema, [(*k, *v) for k, v in held.items()], 10_000)
                held.clear()
        yield from small_batches(schema, [(*k, *v) for k, v in held.items()], 10_000)

    rows = pages.select(_host(url).alias("host"), id_col, url, html).transform(arrow, run, kinds)
    return rows.groupBy("host", "token", "tag", "parent", "name", "rank", "odd").agg(*[F.sum(c).alias(c) for c in ("a", "b", "pages", "total", "chars", "inside", "loose")])


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), "://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, place, fixed, fixed_inside): the main place and the fixed text runs of each host's template."""
    tokens = stored(occurrences(pages, id_col, url, html), "tokens")
    hosts = tokens.where("token = 0").select("host", *[F.col(c).alias(f"all_{c}") for c in ("pages", "chars", "inside", "loose")])
    common = tokens.where("token != 0").join(hosts, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("all_pages")))
    all_ = ["all_pages", "all_chars", "all_inside", "all_loose"]
    item = F.struct("token", "tag", "parent", "name", "rank", "odd", (F.col("total") == F.col("pages")).alias("once"), (F.col("pages") / F.col("all_pages")).alias("share"), "chars", "inside", "loose")
    classes = common.groupBy("host", *all_, "a", "b").agg(F.collect_list(item).alias("items"), F.max("tag").alias("tags"))
    valid = classes.where((F.size("items") >= LEAST_TOKENS) | F.col("tags")).groupBy("host", *all_).agg(F.flatten(F.collect_list("items")).alias("items"))
    fixed = lambda share: F.filter("items", lambda x: ~x["tag"] & (x["share"] >= share))

    def runs(share: float, where: str, most: float):
        held = F.aggregate(fixed(share), F.lit(0).cast("long"), lambda n, x: n + x[where])
        return F.when(held <= most * F.col(f"all_{where}"), F.transform(fixed(share), lambda x: x["token"])).otherwise(F.array().cast("array<long>"))

    place = lambda x: F.struct(x["token"].alias("path"), *[x[c].alias(c) for c in ("parent", "name", "rank", "odd", "chars")])
    places = F.transform(F.filter("items", lambda x: x["tag"] & x["once"]), place)
    rows = valid.select("host", "all_chars", places.alias("places"), runs(FIXED_SHARE, "loose", COPIED_PAGE).alias("fixed"), runs(ARTICLE_SHARE, "inside", COPIED_ARTICLE).alias("fixed_inside"))

    def run(batches):
        for b in batches:
            _, chars, places, *_ = (c.to_pylist() for c in b.columns)
            found = [main_place([tuple(p.values()) for p in ps], n) for ps, n in zip(places, chars, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64()), b.column(3), b.column(4)], ["host", "place", "fixed", "fixed_inside"])

    return rows.transform(arrow, run, "host string, place long, fixed array<long>, fixed_inside array<long>")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id_col, url, text) of every row."""
    of_host = ["__place", "__fixed", "__inside"]
    found = stored(templates(pages, id_col, url, html), "templates").toDF("__host", *of_host)
    rows = pages.select(F.col(id_col), F.col(url), F.col(html).alias("__html"), _host(url).alias("__host")).join(found, "__host", "left")
    rows = rows.select(id_col, url, "__html", *of_host)
    out = rows.select(id_col, url, F.lit("").alias("__text")).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        known: dict[tuple, frozenset] = {}
        schema = to_arrow_schema(out)
        for b in batches:
            _, _, texts, places, *fixed = (c.to_pylist() for c in b.columns)
            sets = [[known.setdefault(k, frozenset(k)) for x in f for k in [tuple(x or ())]] for f in fixed]
            if len(known) > 2000:
                known.clear()
            found = [main_text(*x) for x in zip(texts, places, *sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], schema=schema)

    return rows.transform(arrow, run, out).withColumnRenamed("__text", "text")
