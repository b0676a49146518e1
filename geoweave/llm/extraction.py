"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A page is read as tokens: container tags with their path, and text runs with the path they stand in.  On the distinct pages
of a host, tokens with the same occurrence vector (the same count on every page) form an equivalence class; vectors are
compared by the sum of a hash of (page, count), which Spark adds up map-side, so no host is ever gathered.  Classes that
occur on most pages and whose tokens keep one order on all of them are valid; their containers, nested by their paths, are the
host's template, and its text is what repeats.  What stands between is slots: a template container that mostly holds links
is a menu.  Extraction takes each page's slots: those inside the article where the page marks one, else all but menus; template
text and parts marked as navigation, adverts, notices, forms or comments go.  Hosts of few pages use the template of all pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small_batches, stored

#: Distinct pages from which a host has a template of its own, and from which text that repeats is template text.
MIN_PAGES, MIN_TEXT_PAGES = 8, 20
#: Percent of the pages that a class of containers, and one with text, must occur on.
SUPPORT, TEXT_SUPPORT = 50, 80

# Element names by what they mean for the reading of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img br".split())
IMPLIED = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table menu select".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button select dialog menu fieldset input".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset("""
    ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu
    breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal
    overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist
    reply replies respond discussion disqus widget toolbar pagination pager search skip
""".split())
ARTICLE_NAMES = frozenset("article article-body article-content post post-body post-content entry entry-content story story-body main "
                          "main-content content page-content".split())
PLAIN_TAGS = frozenset("html body main article".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_NOT = re.compile(r"\b(?:has|with|no|without|not|is)[-_]?[a-z]+")


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode()) >> 2


@lru_cache(100_000)
def _element(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Signature, whether it is marked as boilerplate, and its level as an article (3 tag, 2 main, 1 by name)."""
    named: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        named.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    names = f"{named.get('class', '')} {named.get('id', '')}"
    role = named.get("role", "")
    marked = set(_WORD.findall(_NOT.sub(" ", names)))
    plain = tag in PLAIN_TAGS
    boilerplate = (tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or "hidden" in named or named.get("aria-hidden") == "true"
                   or bool(marked & BOILERPLATE_WORDS) and (not plain or "comment" in marked))
    level = 3 if tag == "article" else 2 if tag == "main" or role == "main" else int(bool(set(names.split()) & ARTICLE_NAMES)) if not plain else 0
    own_id = re.sub("[0-9]+", "#", named.get("id", ""))  # ids number their elements
    return f"{tag}.{' '.join(named.get('class', '').split())}#{own_id}", boilerplate, 0 if boilerplate else level


class Block:
    """One block of text: its words, the container it stands in, and how it is marked."""

    __slots__ = ("text", "slot", "level", "chars", "links")

    def __init__(self, text: str, slot: int, level: int, links: int):
        self.text, self.slot, self.level, self.chars, self.links = text, slot, level, len(text), links

    @property
    def token(self) -> int:
        return _hash(self.slot, self.text) * 2 + 1


class Page:
    """Blocks outside marked boilerplate, and the page's tokens in order (containers even, text runs odd)."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.tokens: list[int] = []
        # (tag, path hash, boilerplate, article level, container); the root closes never
        self.stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, True)]
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.read(source)

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1][2]:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if any(x[0] == "a" for x in reversed(self.stack)):
                self.linked.append(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                block = Block(text, top[1], top[3], len(" ".join("".join(self.linked).split())))
                self.blocks.append(block)
                self.tokens.append(block.token)
            self.parts, self.linked = [], []

    def close(self, tag: str, within: frozenset = frozenset()) -> None:
        """Pop to the nearest open ``tag`` unless one of ``within`` is nearer; nothing if there is none."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                for x in self.stack[i:]:
                    if x[4]:
                        self.tokens.append(_hash(x[1], "/") * 2)
                del self.stack[i:]
                return
            if self.stack[i][0] in within:
                return

    def read(self, source: str) -> None:
        at = 0
        find = _TAG.search
        while (m := find(source, at)) is not None:
            if m.start() > at:
                self.text(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            closing = bool(m[1])
            if tag == "br":
                self.text(" ")
                continue
            if tag not in INLINE:
                self.flush()
            if closing:
                if tag not in VOID:
                    self.close(tag, LISTS if tag in IMPLIED else frozenset())
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source) if tag in ("script", "style") else at
                if end or tag in ("script", "style"):
                    continue
            if tag not in INLINE:  # a block ends the paragraph it would stand in, an item the item before
                self.close("p", LISTS | {"div", "article", "section", "body", "aside", "footer", "header", "nav", "main", "form"})
                if tag in IMPLIED and tag[0] != "h":
                    self.close(tag, LISTS)
            if tag in INLINE and tag not in ("a", "span", "label"):
                continue
            signature, boilerplate, level = _element(tag, m[3])
            _, path, marked, above, _ = self.stack[-1]
            if tag == "header" and not above:
                boilerplate = True
            container = tag not in INLINE and tag not in IMPLIED
            inner = _hash(path, signature) if container else path
            self.stack.append((tag, inner, marked or boilerplate, 0 if marked or boilerplate else max(above, level), container))
            if container:
                self.tokens.append(inner * 2)
        self.text(source[at:])
        self.flush()

    def slots(self) -> dict[int, list[int]]:
        """Characters and linked characters that stand directly in each container."""
        out: dict[int, list[int]] = {}
        for b in self.blocks:
            x = out.setdefault(b.slot * 2, [0, 0])
            x[0] += b.chars
            x[1] += b.links
        return out

    def main_text(self, template_text: frozenset, menus: frozenset) -> str:
        """The article's blocks, one a line; without a marked article, all that is in no menu."""
        level = max((b.level for b in self.blocks), default=0)
        own = {} if level else self.slots()
        out = []
        for b in self.blocks:
            if level and b.level < level or template_text and b.token in template_text:
                continue
            if not level:
                chars, links = own[b.slot * 2]
                if b.slot * 2 in menus or 2 * links >= chars:
                    continue
            out.append(b.text)
        return "\n".join(out)


TOKENS = "host long, page long, tokens array<long>, slots array<long>, chars array<long>, links array<long>"


def page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, html`` to each page's token sequence and its slots' text volumes."""
    longs = pa.list_(pa.int64())
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for source in batch.column(1):
            source = source.as_py() or ""
            page = Page(source)
            slots = page.slots()
            for column, x in zip(columns, (_hash(source), page.tokens, list(slots), [x[0] for x in slots.values()],
                                           [x[1] for x in slots.values()]), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, longs) for c in columns[1:])],
                                         ["host", "page", "tokens", "slots", "chars", "links"])


def templates(pages: DataFrame) -> DataFrame:
    """``host, texts, menus`` of every host with a template (host 0: all pages), from ``host, html``.

    ``texts`` are tokens of text that repeats, ``menus`` template containers that mostly hold links.  Both are bounded by the
    support asked for: a token on half the pages is one of at most twice the tokens of a mean page.
    """
    read = stored(pages.mapInArrow(page_tokens, TOKENS), "page-tokens")
    seen = stored(read.groupBy("host", "page").agg(F.count("*").alias("n")).where("n > 1"), "copied-pages")
    once = (read.join(seen, ["host", "page"], "left_anti")
            .unionByName(read.join(seen, ["host", "page"], "left_semi").dropDuplicates(["host", "page"])))
    groups = F.explode(F.array("host", F.lit(0).cast("long"))).alias("g")
    sizes = once.select(groups, "page").groupBy("g").agg(F.count("*").alias("pages")).where(
        (F.col("pages") >= MIN_PAGES) | (F.col("g") == 0))
    # one row per page and distinct token; text runs count for their host only
    counted = once.select("host", "page", F.explode(F.expr(
        "transform(array_distinct(tokens), t -> struct(t AS token, size(filter(tokens, u -> u = t)) AS n))")).alias("t")).select(
        "host", "page", "t.token", "t.n")
    text = F.col("token") % 2 == 1
    everywhere = F.explode(F.when(text, F.array("host")).otherwise(F.array("host", F.lit(0).cast("long")))).alias("g")
    vectors = (counted.select(everywhere, "token", F.xxhash64("page", "n").alias("v")).groupBy("g", "token")
               .agg(F.count("*").alias("support"), F.bit_xor("v").alias("vector")))
    frequent = vectors.join(sizes, "g").where(
        F.when(text, (F.col("pages") >= MIN_TEXT_PAGES) & (F.col("support") * 100 >= F.col("pages") * TEXT_SUPPORT))
        .otherwise(F.col("support") * 100 >= F.col("pages") * SUPPORT)).drop("pages")
    classes = stored(frequent.groupBy("g", "support", "vector").agg(F.sort_array(F.collect_set("token")).alias("members"))
                     .where(F.size("members") > 1), "token-classes")
    member = classes.select("g", "vector", F.size("members").alias("size"), F.explode("members").alias("token"))
    placed = once.select("host", "page", F.posexplode("tokens").alias("pos", "token"))
    order = (placed.select(everywhere, "page", "pos", "token").join(member, ["g", "token"])
             .groupBy("g", "vector", "size", "page").agg(F.expr("transform(array_sort(collect_list(struct(pos, token))), x -> x.token)").alias("seq"))
             .withColumn("unit", F.expr("slice(seq, 1, size)"))
             .withColumn("whole", F.expr("seq = flatten(array_repeat(unit, cast(size(seq) div size AS int)))"))
             .groupBy("g", "vector").agg(F.min("whole").alias("whole"), F.min(F.xxhash64("unit")).alias("a"), F.max(F.xxhash64("unit")).alias("b"))
             .where("whole AND a = b").select("g", "vector"))
    valid = member.join(order, ["g", "vector"], "left_semi").select("g", "token")
    volume = (once.select("host", F.explode(F.arrays_zip("slots", "chars", "links")).alias("s"))
              .select(groups, F.col("s.slots").alias("token"), F.col("s.chars").alias("chars"), F.col("s.links").alias("links"))
              .groupBy("g", "token").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
              .where(F.col("links") * 2 >= F.col("chars")))
    menus = valid.where(~text).join(volume, ["g", "token"], "left_semi").groupBy("g").agg(F.collect_list("token").alias("menus"))
    texts = valid.where(text).groupBy("g").agg(F.collect_list("token").alias("texts"))
    return stored(menus.join(texts, "g", "full").withColumnRenamed("g", "host"), "templates")


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``page_id, url, html, texts, menus, all_menus`` to the result rows."""
    @lru_cache(1000)
    def frozen(x: tuple) -> frozenset:
        return frozenset(x)

    for batch in batches:
        out = []
        for source, texts, menus in zip(*(batch.column(c) for c in ("html", "texts", "menus")), strict=True):
            out.append(Page(source.as_py() or "").main_text(frozen(tuple(texts.as_py() or ())), frozen(tuple(menus.as_py() or ()))))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
                                          pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: str = "url") -> F.Column:
    """Hash of the lower-cased host after the first ``://`` (null or none: empty)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://([^/?#]*)", 1))
    return F.xxhash64(host)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row.

    Null or empty html gives an empty text; unclosed and stray tags are read as browsers do, a page cut short to its end; pages
    of any length are read whole; repeated rows count each, but exact copies count once in a host's vectors; null ids and urls
    are kept (no host: the empty one); an empty table gives no rows; other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    found = templates(rows.select("host", "html"))
    common = found.where("host = 0").select(F.lit(0).cast("long").alias("zero"), F.col("menus").alias("all_menus"))  # at most one row
    joined = (rows.withColumn("zero", F.lit(0).cast("long")).join(found, "host", "left").join(F.broadcast(common), "zero", "left")
              .select("page_id", "url", "html", "texts", F.coalesce("menus", "all_menus").alias("menus")))
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
