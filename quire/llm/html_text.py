"""Main text by equivalence-class template deduction.

Each page becomes tokens: opening tags with their path of ancestors (names, classes, ids), sectioning elements by their
place below each other, and all text blocks with their path, those in menus, notices and the like too. Over all different contents of a host, tokens with equal occurrence vectors (how often on which content) form
an equivalence class; vectors are compared by the sum over contents of a hash of content and count, so they are
aggregated in two steps, for a host of any size and without leaving out pages. A class is of the template if it has
three tokens or more, is on three contents or more (below
half of the host's, its blocks count where most of what is in their path repeats), has at most half of the text or
half of the blocks of its pages, as pages that share more are copies of each other, and comes in
one order on most of them, openings and ends of sections alike. On a page where it comes in another order, or crosses a larger
class instead of lying between two of its tokens, it isn't taken as template. Blocks of the template go.

The template's slots lie between the opening and the end of a section in such a class. One that
has three quarters of the text of the contents on which its class is in place is a main slot. A section that is in no valid class,
or whose class isn't in place on a page, is no slot there. On a page the innermost
main slot is the article, or the innermost with a main headline that isn't of the template, so a headline above
the body of the article stays; blocks of all other slots go. This needs no names of elements or classes. A slot with
less than half of a page's own text is none there: that page has another layout than its host's others.

Names are hints for what the template leaves (``hints`` false: they aren't asked). If at least half of the text that is left lies in article or main
elements, that is the main text; else all of it is. Blocks in boilerplate elements (menus, headers, footers,
sidebars, notices, adverts, forms, comments) go too, so hosts with one or two pages have a result; names
of classes and ids count only for elements without most of the article's text (of the page's, without an article).

Null and empty pages give the empty text. Malformed markup is read as far as it goes. A page without a host
counts as of the host ''. Repeated rows count each.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import by_bytes, column, discard, staged

TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|$)", re.S)
ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUND = frozenset("ul ol dl table select body html article section div main aside nav header footer td th blockquote form".split())
# Elements, roles and words of class or id that mark what isn't the article.
BOILER = frozenset("nav footer aside form script style noscript template button select option textarea iframe svg canvas menu dialog object embed audio video head title".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond reply replies disqus social share sharing related recommended widget pagination pager toolbar".split())
#: Elements that can be a slot.
SECTIONS = frozenset("body div section article main table tbody tr td center aside nav header footer form".split())
SALTS = 32
# A class has so many tokens and is on so many contents at least.
SIZE, PAGES = 3, 3
#: Attributes of a tag that are longer aren't kept from tag to tag.
LONG = 200
WORDS = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")


class Block(NamedTuple):
    text: str
    token: int
    slot: int
    main: bool
    spot: int  # its innermost section
    head: bool  # the main headline
    hint: bool  # its names say boilerplate


class Spot(NamedTuple):
    """A section: its place among the page's, the section around it, the text below it, what hints leave of that, and
    the number of tokens before its end."""

    token: int
    around: int
    chars: int
    kept: int
    end: int


class Page(NamedTuple):
    tokens: list[int]  # tags and blocks
    blocks: list[Block]
    spots: list[Spot]

    def slots(self) -> list[int]:
        """The sections that have text, but less than the one around them."""
        return [i for i, x in enumerate(self.spots) if i and 0 < x.chars < self.spots[x.around].chars]


def hashed(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode()) - (1 << 63)


class Node(NamedTuple):
    """``token``: the hash of the names on the path from the root, so depth costs nothing."""

    name: str
    token: int
    boiler: bool
    main: bool
    named: int  # the innermost element that its names call boilerplate, -1 if none
    spot: int  # the innermost section


@lru_cache(4096)
def marks(name: str, attrs: str, in_main: bool) -> tuple[str, bool, bool, bool]:
    """Signature of a tag, whether it opens boilerplate, whether it opens the article, whether its names say boilerplate."""
    got: dict[str, str] = {}
    if attrs and ("=" in attrs or "hidden" in attrs):
        for m in ATTR.finditer(attrs):
            got.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    named = f"{got.get('class', '')} {got.get('id', '')}".strip()
    words = {w.lower() for w in WORDS.findall(named)} if named else set()
    role = got.get("role", "").lower()
    boiler = name in BOILER or role in BOILER_ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true"
    boiler = boiler or name == "header" and not in_main
    called = bool(words & BOILER_WORDS) and name not in ("html", "body") or "header" in words and name not in INLINE and name[:1] + name[1:].strip("123456") != "h" and not in_main
    main = name in ("article", "main") or role == "main" or "articlebody" in got.get("itemprop", "").lower()
    return f"{name}.{re.sub(r'[0-9]+', '0', named)}" if named else name, boiler, main, called and not main


def parse(page: str, hints: bool = True) -> Page:
    """Tag tokens and text blocks in page order. Names are weighed
    once the page is known: an element with most of the article's text, or of the page's where no article has
    any, isn't what its names say. Without ``hints`` no block has any."""
    root = Node("", 0, False, False, -1, 0)
    stack: list[Node] = [root]
    opened: defaultdict[str, int] = defaultdict(int)
    tokens: list[int] = []
    blocks: list[Block] = []
    owners: list[int] = []  # of each block its innermost named element
    named: list[list[int]] = []  # of each named element the one around it, characters, characters in articles
    places_of: list[list[int]] = [[0, 0, 0, 0, 0]]  # of each section its token, the one around it, characters, those that stay, its end
    like: Counter[tuple[int, str]] = Counter()  # of each section how many of a kind are in it
    held: list[str] = []
    owner = root

    def flush() -> None:
        raw = "".join(held)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        held.clear()
        if text:
            places_of[owner.spot][2] += len(text)
            blocks.append(Block(text, hashed(str(owner.token), text), owner.token, owner.main, owner.spot, opened["h1"] > 0, owner.boiler))
            owners.append(owner.named)
            tokens.append(blocks[-1].token)

    def add(text: str) -> None:
        nonlocal owner
        if not held:
            owner = stack[-1]
        held.append(text)

    def pop(names: set[str] | frozenset[str], bound: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                for n in stack[k:]:
                    opened[n.name] -= 1
                    if n.name in SECTIONS:
                        places_of[n.spot][4] = len(tokens)
                del stack[k:]
                return
            if stack[k].name in bound:
                return

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if held and name not in INLINE:
                flush()
            if opened[name]:
                pop({name}, frozenset() if name not in INLINE else BOUND)
            if held and (owner.boiler, owner.named) != (stack[-1].boiler, stack[-1].named):
                flush()
            continue
        if name == "br":
            held and held.append(" ")
            continue
        if name not in INLINE:
            if held:
                flush()
            if opened["p"]:
                pop({"p"}, BOUND)
            if name in CLOSES and any(opened[n] for n in CLOSES[name]):
                pop(CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select")) - {name})
        parent = stack[-1]
        attrs = m["attrs"] or ""
        sign, boiler, main, called = (marks if len(attrs) < LONG else marks.__wrapped__)(name, attrs if "=" in attrs or "hidden" in attrs else "", parent.main)
        if not hints:
            boiler = main = called = False
        token = hashed(str(parent.token), sign) if name not in INLINE else parent.token
        spot = parent.spot
        if name in SECTIONS:
            like[spot, sign] += 1
            spot = len(places_of)
            places_of.append([hashed(str(places_of[parent.spot][0]), sign, str(like[parent.spot, sign])), parent.spot, 0, 0, 0])
            tokens.append(places_of[spot][0])
        elif name not in INLINE:
            tokens.append(token)
        node = Node(name, token, parent.boiler or boiler, parent.main or main, len(named) if called else parent.named, spot)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif name not in VOID and not attrs.endswith("/"):
            if called:
                named.append([parent.named, 0, 0])
            if held and (node.boiler != parent.boiler or called):
                flush()
            stack.append(node)
            opened[name] += 1
    if held:
        flush()
    weighed = [(b, k) for b, k in zip(blocks, owners, strict=True) if not b.hint]
    drop = iter(dropped([b for b, _ in weighed], [k for _, k in weighed], named))
    blocks = [b if b.hint else b._replace(hint=next(drop)) for b in blocks]
    for b in blocks:
        places_of[b.spot][3] += 0 if b.hint else len(b.text)
    for x in reversed(places_of[1:]):  # a section comes after those around it
        places_of[x[1]][2] += x[2]
        places_of[x[1]][3] += x[3]
    return Page(tokens, blocks, [Spot(t, around, chars, kept, end or len(tokens)) for t, around, chars, kept, end in places_of])


def dropped(blocks: list[Block], owners: list[int], named: list[list[int]]) -> list[bool]:
    """Per block whether it lies in an element that is what its names say."""
    for b, k in zip(blocks, owners, strict=True):
        if k >= 0:
            named[k][1] += len(b.text)
            named[k][2] += len(b.text) * b.main
    for around, chars, main in reversed(named):  # an element comes after those around it
        if around >= 0:
            named[around][1] += chars
            named[around][2] += main
    every, articles = sum(len(b.text) for b in blocks), sum(len(b.text) for b in blocks if b.main)
    gone: list[bool] = []
    for around, chars, main in named:
        gone.append(around >= 0 and gone[around] or not (2 * main > articles if articles else 2 * chars > every))
    return [k >= 0 and gone[k] for k in owners]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def content_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def judged(seen: list[dict]) -> list[tuple[int, int, list[int]]]:
    """Of a page's tokens that are in classes (at, token, cls, size, chars): per class that nests with the others,
    a hash of its order and its blocks. Of two classes that cross the smaller one goes."""
    seen = sorted(seen, key=lambda x: x["at"])
    last = {x["cls"]: i for i, x in enumerate(seen)}
    rank = {x["cls"]: (x["size"], x["cls"]) for x in seen}
    stack: list[int] = []
    opened, crossed = set(), set()
    for i, x in enumerate(seen):
        c = x["cls"]
        if c not in opened:
            opened.add(c)
            stack.append(c)
        while c not in crossed and stack[-1] != c:
            top = stack[-1]
            if top in crossed or last[top] < i or rank[top] < rank[c]:
                if last[top] > i:
                    crossed.add(top)
                stack.pop()
            else:
                crossed.add(c)
    tokens: dict[int, list[int]] = defaultdict(list)
    blocks: dict[int, list[int]] = defaultdict(list)
    for x in seen:
        tokens[x["cls"]].append(x["token"])
        if x["chars"]:
            blocks[x["cls"]].append(x["token"])
    return [(c, hashed(*map(str, t)), blocks[c]) for c, t in tokens.items() if c not in crossed]


#: A content's different tokens in columns: place of the first, number, characters of a block, blocks without a hint, path of a
#: block; of a slot its end, its text and what hints leave of it (-1 in place of the end: no slot).
TOKENS = {"at": pa.int32(), "token": pa.int64(), "k": pa.int32(), "chars": pa.int32(), "plain": pa.int32(), "slot": pa.int64(), "end": pa.int32(), "below": pa.int64(), "kept": pa.int64()}
PLACED = {"host": pa.string(), "content": pa.int64(), "text": pa.int64(), "page_chars": pa.int64(), "cls": pa.int64(), "pages": pa.int64(), "order": pa.int64(), "blocks": pa.list_(pa.int64()), "spot": pa.list_(pa.int64()), "below": pa.list_(pa.int64()), "kept": pa.list_(pa.int64())}


def token_rows(page: Page) -> list[tuple[int, ...]]:
    """The columns of ``TOKENS`` for each different token, in order of their first places."""
    first: dict[int, int] = {}
    for i, t in enumerate(page.tokens):
        first.setdefault(t, i)
    counts, plain = Counter(page.tokens), Counter(b.token for b in page.blocks if not b.hint)
    of = {b.token: b for b in page.blocks}
    slots = {page.spots[i].token: page.spots[i] for i in page.slots()}
    rows = []
    for t, i in first.items():
        chars, path = (len(of[t].text), of[t].slot) if t in of else (0, 0)
        end, below, kept = (slots[t].end, slots[t].chars, slots[t].kept) if t in slots else (-1, 0, 0)
        rows.append((i, t, counts[t], chars, plain[t], path, end, below, kept))
    return rows


def on_a_page(got: list[dict]) -> list[tuple[int, int, int, list[int], list[int], list[int], list[int]]]:
    """Per class that nests on a page: class, contents with it, hash of its order, blocks without a hint, slots, their texts
    and what hints leave of those. A slot's end is a token of its class too; of ends in one place the inner slot's is first."""
    got = sorted(got, key=lambda x: x["at"])
    opened = [{**x, "at": 2 * x["at"]} for x in got]
    ends = [{**x, "at": 2 * x["end"] - 1, "token": ~x["token"], "chars": 0} for x in reversed(got) if x["end"] >= 0]
    plain = {x["token"] for x in got if x["plain"]}
    slots: dict[int, list[dict]] = defaultdict(list)
    for x in got:
        if x["end"] >= 0:
            slots[x["cls"]].append(x)
    pages = {x["cls"]: x["pages"] for x in got}
    return [(c, pages[c], order, [b for b in blocks if b in plain], *([x[f] for x in slots[c]] for f in ("token", "below", "kept"))) for c, order, blocks in judged(opened + ends)]


def templates(pages: DataFrame, support: float, hints: bool = True) -> DataFrame:
    """Per host and content of a page its blocks that are of the host's template, and its sections that are main
    slots: host, content, template, main (arrays of long; null if none). ``pages``: host, content, html."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html"):
            sums, columns = [], []
            for text in batch.column("html").to_pylist():
                page = parse(text or "", hints)
                own = [len(b.text) for b in page.blocks if not b.hint]
                sums.append((sum(own), len(own), page.spots[0].chars))
                columns.append(list(zip(*token_rows(page), strict=True)) or [()] * len(TOKENS))
            arrays = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)] + [pa.array(map(list, c), pa.list_(t)) for c, t in zip(zip(*columns, strict=True), TOKENS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("content"), *arrays], names=["host", "content", "page_chars", "page_blocks", "text", *TOKENS])

    lists = ", ".join(f"{c} array<{'int' if t == pa.int32() else 'long'}>" for c, t in TOKENS.items())
    contents = pages.mapInArrow(parsed, f"host string, content long, page_chars long, page_blocks long, text long, {lists}")
    contents = staged(contents.dropDuplicates(["host", "content"]), "contents")
    whole = ("host", "content", "page_chars", "page_blocks", "text")
    each = contents.select(*whole, F.explode(F.arrays_zip(*TOKENS)).alias("x")).select(*whole, "x.*")
    x = F.xxhash64("content", "k")
    sums = (F.count("*").alias("pages"), F.sum(x.bitwiseAND(0x7FFFFFFF)).alias("v1"), F.sum(F.shiftrightunsigned(x, 33)).alias("v2"), F.sum("k").alias("n"), F.sum("plain").alias("plain"), F.max("end").alias("end"), F.sum("page_chars").alias("page_chars"), F.sum("page_blocks").alias("page_blocks"))
    seen = staged(each.groupBy("host", "token", "chars", "slot").agg(*sums), "tokens")
    # a large host's tokens are dealt to as many tasks as there are salts
    sizes = contents.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("all")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    valid = seen.filter(F.col("pages") >= PAGES).join(sizes, (F.col("host") == F.col("of")) & (F.pmod("token", F.lit(SALTS)) == F.col("salt"))).drop("of", "salt")
    # below the support, blocks of slots that mostly repeat
    slots = seen.filter("chars > 0").groupBy(F.col("host").alias("of"), F.col("slot").alias("fixed")).agg((2 * F.sum(F.when(F.col("pages") > 1, F.col("n")).otherwise(0)) >= F.sum("n")).alias("repeats")).filter("repeats")
    valid = valid.join(slots, (F.col("host") == F.col("of")) & (F.col("slot") == F.col("fixed")), "left").filter((F.col("chars") == 0) | (F.col("pages") >= support * F.col("all")) | F.col("repeats"))
    valid = staged(valid.select("host", "token", "chars", "plain", "end", "pages", "page_chars", "page_blocks", F.xxhash64("pages", "v1", "v2").alias("cls")), "valid")
    # pages that share most of their text are copies of each other, not of one template
    classes = valid.groupBy(F.col("host").alias("of"), F.col("cls").alias("c")).agg(F.count("*").alias("size"), F.max((F.col("plain") > 0) | (F.col("end") >= 0)).alias("matters"), F.sum("plain").alias("blocks"), F.sum(F.col("chars") * F.col("plain")).alias("held"), F.first("page_chars").alias("page_chars"), F.first("page_blocks").alias("page_blocks"))
    classes = classes.filter((F.col("size") >= SIZE) & F.col("matters") & ((2 * F.col("held") <= F.col("page_chars")) | (2 * F.col("blocks") <= F.col("page_blocks")))).select("of", "c", "size")
    members = staged(valid.join(classes, (F.col("host") == F.col("of")) & (F.col("cls") == F.col("c"))).select(F.col("host").alias("of"), F.col("token").alias("t"), "cls", "size", "pages"), "members")
    found = each.join(members, (F.col("host") == F.col("of")) & (F.col("token") == F.col("t")))
    on_page = found.groupBy("host", "content", "text", "page_chars").agg(F.collect_list(F.struct("at", "token", "cls", "size", "chars", "pages", "plain", "end", "below", "kept")).alias("seen"))

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*key, *placed) for *key, got in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "text", "page_chars", "seen")), strict=True) for placed in on_a_page(got)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PLACED.values(), strict=True)], names=list(PLACED))

    placed = staged(on_page.mapInArrow(orders, "host string, content long, text long, page_chars long, cls long, pages long, order long, blocks array<long>, spot array<long>, below array<long>, kept array<long>"), "placed")
    usual = placed.groupBy(F.col("host").alias("of"), F.col("cls").alias("c"), F.col("order").alias("o")).agg((2 * F.count("*") > F.first("pages")).alias("most")).filter("most")
    usual = staged(usual, "usual")
    out = placed.join(usual, (F.col("host") == F.col("of")) & (F.col("cls") == F.col("c")) & (F.col("order") == F.col("o")), "left_semi")
    own = out.select("host", "content", "text", "page_chars", F.explode(F.arrays_zip("spot", "below", "kept")).alias("x")).select("host", "content", "text", "page_chars", "x.*")
    main = own.groupBy(F.col("host").alias("of"), F.col("spot").alias("s")).agg(F.count("*").alias("pages"), F.sum("below").alias("below"), F.sum("text").alias("text"))
    main = staged(main.filter((F.col("pages") >= PAGES) & (4 * F.col("below") >= 3 * F.col("text"))).select("of", "s"), "main")
    slots = own.join(main, (F.col("host") == F.col("of")) & (F.col("spot") == F.col("s")), "left_semi").select("host", "content", F.lit(None).cast("array<long>").alias("blocks"), "spot", (F.col("kept") < F.col("page_chars")).alias("cuts"))
    both = out.select("host", "content", "blocks", F.lit(None).cast("long").alias("spot"), F.lit(False).alias("cuts")).unionByName(slots)
    # where no main slot leaves out any text that hints leave, the slots change nothing and the page needs no row
    both = both.groupBy("host", "content").agg(F.flatten(F.collect_list("blocks")).alias("template"), F.collect_list("spot").alias("main"), F.max("cuts").alias("cuts"))
    kept = staged(both.filter(F.col("cuts") | (F.size("template") > 0)).drop("cuts"), "templates")
    for table in (contents, seen, valid, members, placed, usual, main):
        discard(table)
    return kept


def within(page: Page, template: set[int], main: set[int]) -> list[Block]:
    """The blocks of a page's innermost main slot, or of the innermost with a main headline that isn't of the template;
    all blocks without a main slot. A section that is a main slot of the host counts only where it has at least half of
    what hints leave of this page, so a page of another layout, or with a section more, loses no text."""
    around = [i for i in page.slots() if page.spots[i].token in main and 2 * page.spots[i].kept >= page.spots[0].kept]
    if not around:
        return page.blocks
    headed: set[int] = set()  # sections around a main headline
    for b in page.blocks:
        spot = b.spot
        while b.head and not b.hint and b.token not in template and spot not in headed:
            headed.add(spot)
            spot = page.spots[spot].around
    chosen = max([i for i in around if i in headed] or around)
    own = [False] * len(page.spots)
    for i, x in enumerate(page.spots):
        own[i] = i == chosen or i > chosen and own[x.around]
    return [b for b in page.blocks if own[b.spot]]


def extract(text: str, template: set[int], main: set[int] = frozenset(), hints: bool = True) -> str:
    """The blocks of the main slot that vary and have no hint; an article or main element that has at least half of their
    text is all of it."""
    page = parse(text, hints)
    kept = [b for b in within(page, template, main) if not b.hint and b.token not in template]
    articles = [b for b in kept if b.main]
    if 2 * sum(len(b.text) for b in articles) >= sum(len(b.text) for b in kept):
        kept = articles
    return "\n\n".join(b.text for b in kept)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.5, hints: bool = True) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    pages = df.select(column(id_col).alias("page"), column(url_col).cast("string").alias("url"), host_of(column(url_col).cast("string")).alias("host"), column(html_col).cast("string").alias("html")).withColumn("content", content_of(F.col("html")))
    found = templates(pages.select("host", "content", "html"), support, hints).select(F.col("host").alias("of"), F.col("content").alias("c"), "template", "main")
    joined = pages.join(found, (F.col("host") == F.col("of")) & (F.col("content") == F.col("c")), "left").select("page", "url", "html", "template", "main")
    id_type = pages.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html"):
            texts = [extract(h or "", set(t or ()), set(m or ()), hints) for h, t, m in zip(*(batch.column(c).to_pylist() for c in ("html", "template", "main")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
