"""Operator 8: main text of web pages by equivalence-class template deduction.

Each page is cut into tokens: its tags and its blocks of text, each together with the path of elements above it; boxes
that differ from others below the same element by their place only have their place in the token. Tokens
of a host that occur equally often in each of its pages (that have the same occurrence vector) are one equivalence
class. Classes are judged as a whole: one is valid if it occurs in most of the host's pages, has enough tokens, tags
among them, and leaves slots: below its outermost tags, text that differs must make up a share of all text. Constant
text without tags or slots of its own (as copies of one article are) is content. Valid classes are nested by the paths
of their tokens and make up the host's template; what is left of a page are its slots.

The template also tells which slot holds the article. From the root of the template, as long as one element of a
valid class holds most of the text that varies over the host's pages and isn't in links, it is gone down into; where that ends
is the article, and the rest of a page goes, also where its article is short or its comments are long. Boxes whose number
differs from page to page are parts of a text and not gone into. Names of elements and class words only weigh text in this.
Hosts without such an element leave it to votes: every page names the first article or main element that it meets on
its own way down, and an element is the article if enough of the pages that have it name it. Other slots are dropped if,
over all pages of the host, they hold mostly links, and in elements that HTML defines as menus, headers, footers,
sidebars, forms or hidden. Class words only decide between what is left below the article's element or outside of
any; those of elements around the article count for nothing. Pages of a host that the template does not have speak for
themselves.

Occurrence vectors are never gathered: two tokens have the same one if the sums over pages of (count x hash of the
page) are equal, which Spark adds up by host and token, before and after one shuffle. A host may have any share of the pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Set

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staveframe.llm._batches import chunks
from staveframe.llm._lineage import cut
from staveframe.llm.url_filter import host_path

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Elements by their part in a page, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg textarea title select canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NO_CONTENT = frozenset("head nav footer aside menu dialog button label fieldset".split())
GROUPS = frozenset("html body div section center form table tbody tr td article main".split())
#: Boxes that have their place in their token, as they often have nothing else of their own.
BOXES = frozenset("div section center form".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("table ul ol dl article section div main body".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: Class words of what isn't content; a class or id counts if it has one of them and else only words for places and shapes.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget widgets related recommended share sharing social "
    "comment comments disqus reply replies respond discussion footer header masthead topbar toolbar search pagination pager copyright disclaimer toc".split()
)
SHAPES = frozenset("area bar block bottom box button column container content foot form group head inner item items left line link links list main message outer page panel post posts primary right row secondary section site slot text thread title top unit user users wrap wrapper".split())
#: A class is valid if it is found in this share of a host's pages; a text inside an article needs the higher share.
SHARE, ARTICLE_SHARE = 0.5, 0.9
#: An element is gone down into from this share of the text; text in articles counts so many times, below class words so much.
MOST, ARTICLE_WEIGHT, NAMED_WEIGHT = 0.6, 6.0, 0.05
#: An element is the article if so many of the pages that have it name it; elements of fewer pages than the second share speak for themselves.
VOTES, RARE = 0.3, 0.01
#: Boxes are parts of the template if their mean number below an element is so near to the number of frequent ones.
STEADY = 0.1
#: Tokens of a valid class, and the share of the text below its tags that its slots hold: of all text, and of text in articles.
LEAST_TOKENS, SLOTS, ARTICLE_SLOTS = 3, 0.05, 0.5
#: Hosts' templates are broadcast while they have fewer tokens than this together; beyond, pages are joined to them by host.
BROADCAST_TOKENS = 1_000_000
CAMEL, WORD, DIGITS = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]+")


def named(names: str) -> bool:
    """Whether a class or id among ``names`` says that the element isn't content."""
    for name in names.split():
        words = {w.lower() for w in WORD.findall(CAMEL.sub(" ", name))}
        if not NAMES.isdisjoint(words) and words <= NAMES | SHAPES:
            return True
    return False


class Page:
    """The blocks of a page, and its tokens: ``(token, parent, kind)`` with kind 0 for tags, 1 for text, 2 for text in an article."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, int, int]] = []  # text, token, slot, node, characters in links
        self.tokens: list[tuple[int, int, int]] = []
        #: Elements as they come: token, node above, shut for good, named as no content. Node 0 is the page.
        self.nodes: list[tuple[int, int, bool, bool]] = [(0, 0, False, False)]
        #: Tokens of elements: the token without its place, and whether it groups others (1) or holds the page (2).
        self.bases: dict[int, tuple[int, int]] = {}
        self.places: Counter = Counter()  # (number of the element above, token without its place)
        #: Tokens of elements: token above, whether it groups others, is an article, is named as no content.
        self.elements: dict[int, tuple[int, bool, bool, bool]] = {}
        self.stack: list[tuple[str, int, int, bool, bool, int]] = []  # name, node, path, article, link, number of the block
        self.parts: list[str] = []
        self.linked = 0
        self._read(source)
        self.repeats = Counter(self.bases[token][0] for token, _, _ in self.tokens)
        self.article, self.around = self._article()
        inside, barred = self.marks(self.article)
        self.tokens += [(token, slot, 2 if inside[node] and not barred[node] else 1) for _, token, slot, node, _ in self.blocks]

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                slot = next((path for name, _, path, *_ in reversed(self.stack) if name in BLOCK), 0)
                token = xxhash.xxh3_64_intdigest(f"{slot}#{text}") >> 1
                self.blocks.append((text, token, slot, self.stack[-1][1] if self.stack else 0, min(self.linked, len(text))))
        self.linked = 0

    def _article(self) -> tuple[int | None, set[int]]:
        """The article or main element that this page names, if any, and the elements gone through."""
        shut = [False]
        for _, above, closed, _ in self.nodes[1:]:
            shut.append(closed or shut[above])
        weight: Counter = Counter()
        for text, _, slot, node, linked in self.blocks:
            if not shut[node]:
                weight[slot] += len(text) - linked
        full = Counter(weight)
        for token in reversed(self.elements):  # elements come after those around them
            full[self.elements[token][0]] += full[token]
        # Articles with the fewest class words around them are what a page can name; their wrappers' words count for nothing.
        ways = {t: self._way(t) for t, (_, _, article, _) in self.elements.items() if article and full[t] > 0}
        words = {t: sum(self.elements[x][3] for x in way) for t, way in ways.items()}
        best_ones = {t for t, n in words.items() if n == min(words.values())}
        around = {0}.union(*(ways[t] for t in best_ones))

        def factor(token: int) -> float:
            return ARTICLE_WEIGHT if token in best_ones else NAMED_WEIGHT if token in self.elements and self.elements[token][3] and token not in around else 1.0

        below: dict[int, list[int]] = {}
        for token in reversed(self.elements):
            weight[token] *= factor(token)
            above = self.elements[token][0]
            weight[above] += weight[token]
            below.setdefault(above, []).append(token)
        at = 0
        while at in below:
            best = max(below[at], key=lambda c: (weight[c], -c))
            if not self.elements[best][1] or weight[best] <= 0 or weight[best] < MOST * weight[at] / factor(at):
                break
            if best in best_ones:
                return best, around
            if self.repeats[self.bases[best][0]] > 1:
                break
            around.add(best)
            at = best
        return None, around

    def _way(self, token: int) -> list[int]:
        """The elements around this one."""
        way = []
        while token := self.elements[token][0]:
            way.append(token)
        return way

    def marks(self, article: int | None) -> tuple[list[bool], list[bool]]:
        """Of every node: whether it is in the article, and whether it is no content by an element on the way to it."""
        chain = self.around | ({article, *self._way(article)} if article else set())
        inside, barred = [False], [False]
        for token, above, shut, noise in self.nodes[1:]:
            inside.append(inside[above] or token == article)
            barred.append(barred[above] or shut or noise and token not in chain)
        return inside, barred

    def _pop_to(self, index: int) -> None:
        if any(s[0] in BLOCK for s in self.stack[index:]):
            self._flush()
        del self.stack[index:]

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._flush()
            shut = {"p"} | CLOSES.get(name, set())
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in shut:
                    self._pop_to(k)
                    break
                if self.stack[k][0] in BOUNDS:
                    break
        if name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        _, node, path, article, link, number = self.stack[-1] if self.stack else ("", 0, 0, False, False, 0)
        is_article = name in ("article", "main") or found.get("role") in ("main", "article")
        shut = name in NO_CONTENT or name == "header" and not article or found.get("role", "") in ROLES or found.get("aria-hidden") == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes)) or "display:none" in found.get("style", "").replace(" ", "")
        noise = name == "form" or bool(names) and name not in ("html", "body", "main") and named(names)
        if name in BLOCK:
            base = own = xxhash.xxh3_64_intdigest(f"{path}/{name}.{DIGITS.sub('0', names)}") >> 1
            self.places[number, base] += 1
            place = self.places[number, base]
            if place > 1 and name in BOXES and not is_article:
                own = xxhash.xxh3_64_intdigest(f"{base}@{place}") >> 1
            self.tokens.append((own, path, 0))
            self.bases.setdefault(own, (base, 2 if name in ("html", "body") else int(name in GROUPS or is_article)))
            self.elements.setdefault(own, (path, name in GROUPS or is_article, is_article and not noise, noise))
            path, number = own, len(self.tokens)
        if name in BLOCK or shut or noise:
            self.nodes.append((path if name in BLOCK else -1, node, shut, noise))
            node = len(self.nodes) - 1
        self.stack.append((name, node, path, article or is_article, link or name == "a", number))

    def _close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self._pop_to(k)
                return
        if name == "p" or name in BLOCK:
            self._flush()

    def _text(self, piece: str) -> None:
        if self.stack and self.stack[-1][0] not in BLOCK and self.nodes[self.stack[-1][1]][2]:
            return  # in a button, a label or a hidden part of a line
        self.parts.append(piece)
        if self.stack and self.stack[-1][4]:
            self.linked += len(piece.strip())

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if end:
                self._close(name)
            elif name in RAW:
                if not attributes.rstrip().endswith("/"):
                    shut = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                    at = shut.end() if shut else n
            else:
                self._open(name, attributes)
        self._flush()

    def main_text(self, gone: Set[int] = frozenset(), articles: Set[int] = frozenset(), others: Set[int] = frozenset()) -> str:
        """The text of the slots that hold content: ``gone`` has the host's tokens of text and its slots of links,
        ``articles`` its articles, ``others`` elements that pages name as articles and that aren't."""
        known = self.article if self.article in articles else next((t for t in self.elements if t in articles), None)
        article = known or (self.article if self.article not in others else None)
        inside, barred = self.marks(article)
        kept = [(text, inside[node]) for text, token, slot, node, linked in self.blocks if not barred[node] and token not in gone and slot not in gone and (inside[node] or 2 * linked <= len(text))]
        if any(x for _, x in kept):
            kept = [x for x in kept if x[1]]
        return "\n".join(text for text, _ in kept)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host, _ = host_path(F.col(url_col).cast("string"))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))


def occurrences(rows: DataFrame) -> DataFrame:
    """``host, token, parent, kind, base, shape, times, page, chars, linked, below, below_article, mass, vote``: the
    distinct tokens of every page.

    ``base`` is the token without its place, ``shape`` 1 for elements that group others and 2 for those of the page.
    ``chars`` is how much text a text token holds, or a slot outside articles, of it ``linked`` in links; ``below`` is
    all text in an element and in those inside it, ``below_article`` that in articles, ``mass`` that outside of links,
    weighed by what the page's names say (of text tokens: their own); ``vote`` is 1 for the element that the page names as its article.
    """
    names = ["host", "token", "parent", "kind", "base", "shape", "times", "page", "chars", "linked", "below", "below_article", "mass", "vote"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", 2 << 20):
            out: list[list] = [[] for _ in names]
            for host, source, mark in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("page").to_pylist(), strict=True):
                page = Page(source or "")
                sizes, links, below, below_article, mass = Counter(), Counter(), Counter(), Counter(), Counter()
                inside, barred = page.marks(page.article)
                for text, token, slot, node, linked in page.blocks:
                    sizes[token] += len(text)
                    below[slot] += len(text)
                    weight = (NAMED_WEIGHT if barred[node] else ARTICLE_WEIGHT if inside[node] else 1.0) * (len(text) - linked)
                    mass[slot] += weight
                    mass[token] += weight
                    if inside[node] and not barred[node]:
                        below_article[slot] += len(text)
                    else:
                        sizes[slot] += len(text)
                        links[slot] += linked
                counted = Counter(page.tokens)
                for token, parent, kind in reversed(counted):  # elements are first met after those around them
                    if kind == 0:
                        below[parent] += below[token]
                        below_article[parent] += below_article[token]
                        mass[parent] += mass[token]
                for (token, parent, kind), times in counted.items():
                    base, shape = page.bases[token] if kind == 0 else (0, 0)
                    of_slot = (links[token], below[token], below_article[token]) if kind == 0 else (0, 0, 0)
                    for column, value in zip(out, (host, token, parent, kind, base, shape, times, mark, sizes[token], *of_slot, round(mass[token] * 100), int(kind == 0 and token == page.article)), strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    source = rows.select("host", "html", F.xxhash64(F.monotonically_increasing_id(), F.lit(8)).alias("page"))
    return source.mapInArrow(run, "host string, token long, parent long, kind int, base long, shape int, times long, page long, chars long, linked long, below long, below_article long, mass long, vote long")


def article_of(tokens: pd.DataFrame) -> pd.DataFrame:
    """The element of one host's template that its article is in: ``host, found``, or no row where there is none.

    ``tokens`` are the host's tokens of valid classes, which are twice as many as a page has, at most: each is in half
    of the pages. Text among them is constant and taken off from the elements around it.
    """
    tags = tokens[tokens["kind"] == 0]
    above = dict(zip(tags["token"], tags["parent"], strict=True))
    mass = Counter(dict(zip(tags["token"], tags["mass"], strict=True)))
    for token, size in tags.loc[tags["parent"] == 0, ["token", "mass"]].itertuples(index=False):
        mass[0] += size
    constant: Counter = Counter()
    for parent, size in tokens.loc[tokens["kind"] != 0, ["parent", "mass"]].itertuples(index=False):
        constant[parent] += size
    depth = {0: 0}
    order = []
    for token in above:  # from the token up to one that is known
        way = []
        while token in above and token not in depth:
            way.append(token)
            token = above[token]
        for step in reversed(way):
            depth[step] = depth.get(above[step], 0) + 1
            order.append(step)
    for token in sorted(order, key=depth.get, reverse=True):
        constant[above[token]] += constant[token]
    steady = tags.groupby("base").agg(n=("token", "size"), met=("pages", "max"), siblings=("of_base", "max"))
    steady = set(steady.index[(steady["siblings"] / steady["met"] - steady["n"]).abs() <= STEADY * steady["n"]])
    below: dict[int, list] = {}
    for row in tags.itertuples(index=False):
        below.setdefault(row.parent, []).append(row)
    at, found = 0, None
    while at in below:
        best = max(below[at], key=lambda r: (mass[r.token] - constant[r.token], -r.token))
        own = mass[best.token] - constant[best.token]
        if best.shape == 0 or best.base not in steady or own <= 0 or own < MOST * (mass[at] - constant[at]):
            break
        at = best.token
        found = at if best.shape == 1 else None
    return pd.DataFrame({"host": tokens["host"].iloc[:1], "found": [found]}) if found is not None else pd.DataFrame({"host": pd.Series(dtype=str), "found": pd.Series(dtype="int64")})


def templates(rows: DataFrame) -> DataFrame:
    """The classes of most pages of each host as ``host, class_id, within, tokens, slots_of_links, articles, others, pages``;
    every host has at least one row.

    ``class_id`` is a class's occurrence sum (null: tokens of fewer pages); ``within`` is that of the class around it (null for
    the outermost); ``tokens`` are its tokens of text if the class is valid, else empty, and without those in articles if they
    are most of the text of the articles; ``slots_of_links`` its elements of which the text is mostly links; ``articles`` the
    element that holds the article by :func:`article_of`, for hosts without one those that enough of the pages that have
    them name; ``others`` those that fewer pages name.
    Shares of pages are counted as if one page more spoke against and one less for it, so that few pages prove little.
    """
    big = "decimal(38,0)"
    vector = F.sum((F.col("times") * F.col("page").cast(big) % F.lit(1 << 61).cast(big)).cast(big))  # equal for equal occurrence vectors
    each = occurrences(rows).groupBy("host", "token", "parent", "kind").agg(F.count("*").alias("pages"), vector.alias("vector"), F.max("base").alias("base"), F.max("shape").alias("shape"), *[F.sum(c).alias(c) for c in ("times", "chars", "linked", "below", "below_article", "mass", "vote")])
    each = cut(each.where((F.col("pages") > 1) | (F.col("parent") == 0) & (F.col("kind") == 0)))
    # The element that most pages of a host have tells how many pages there are.
    total = each.groupBy("host").agg(F.max("pages").alias("of"))
    counted = each.join(F.broadcast(total) if total.count() <= BROADCAST_TOKENS else total, "host")
    frequent = (F.col("pages") - 1) >= (F.col("of") + 1) * F.when(F.col("kind") == 2, ARTICLE_SHARE).otherwise(SHARE)
    chosen = counted.where(frequent | (F.col("vote") > 0) & (F.col("pages") >= RARE * F.col("of"))).withColumn("vector", F.when(frequent, F.col("vector")))
    valid = chosen.where(F.col("vector").isNotNull())
    above = valid.where(F.col("kind") == 0).select("host", F.col("token").alias("parent"), F.col("vector").alias("outer"))
    nested = valid.join(above, ["host", "parent"], "left").unionByName(chosen.where(F.col("vector").isNull()), allowMissingColumns=True)
    links = (F.col("kind") == 0) & (F.col("chars") > 0) & (2 * F.col("linked") > F.col("chars")) & F.col("vector").isNotNull()
    tag, outermost = F.col("kind") == 0, F.coalesce(F.col("outer") != F.col("vector"), F.lit(True))
    total_of = lambda c, which: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0)).alias(f"{c}_of")
    held = lambda which, name: F.collect_list(F.when(which, F.col("token"))).alias(name)
    is_article = tag & (F.col("vote") > 0) & (F.col("vote") >= VOTES * F.col("pages"))
    classes = cut(nested.groupBy("host", F.col("vector").alias("class_id")).agg(
        F.min(F.when(F.col("outer") != F.col("vector"), F.col("outer"))).alias("within"), held(F.col("kind") == 1, "texts"), held(F.col("kind") == 2, "article_texts"),
        held(links, "slots_of_links"), held(is_article, "articles"), held(tag & (F.col("vote") > 0) & ~is_article, "others"), F.max("pages").alias("pages"), F.count("*").alias("n"), F.count_if(tag).alias("tags"),
        total_of("below", tag & outermost), total_of("below_article", tag & outermost), F.sum(F.when(~tag, F.col("chars")).otherwise(0)).alias("own"), F.sum(F.when(F.col("kind") == 2, F.col("chars")).otherwise(0)).alias("own_article"),
    ))
    leaves = F.col("class_id").isNotNull() & (F.col("tags") > 0) & (F.col("own") <= (1 - SLOTS) * F.col("below_of"))
    valid = leaves & (F.col("n") >= LEAST_TOKENS)
    small = F.col("own_article") <= (1 - ARTICLE_SLOTS) * F.col("below_article_of")
    # The tags of classes that leave slots, and the text that is taken for template, tell the article's element.
    known = classes.select("host", F.col("class_id").alias("vector"), leaves.alias("leaves"), valid.alias("valid"), small.alias("small"))
    given = nested.join(known, ["host", "vector"]).where(F.when(tag, F.col("leaves")).otherwise(F.col("valid") & ((F.col("kind") == 1) | F.col("small"))))
    given = given.withColumn("of_base", F.sum(F.when(tag, F.col("times"))).over(Window.partitionBy("host", "base")))
    found_in = given.select("host", "token", "parent", "kind", "base", "shape", "pages", "of_base", "mass").groupBy("host").applyInPandas(article_of, "host string, found long")
    none = F.array().cast("array<bigint>")
    tokens = F.when(valid, F.concat("texts", F.when(small, F.col("article_texts")).otherwise(none))).otherwise(none)
    told = classes.join(found_in, "host", "left")
    articles = F.when(F.col("found").isNull(), F.col("articles")).otherwise(F.array("found"))
    found = told.select("host", "class_id", "within", tokens.alias("tokens"), "slots_of_links", articles.alias("articles"), "others", "pages")
    bare = rows.select("host").distinct().join(found.select("host").distinct(), "host", "left_anti")
    return found.unionByName(bare.select("host", F.lit(None).cast(big).alias("class_id"), F.lit(None).cast(big).alias("within"), none.alias("tokens"), none.alias("slots_of_links"), none.alias("articles"), none.alias("others"), F.lit(0).cast("long").alias("pages")))


def extract(pages: DataFrame, template: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``: the blocks of its main text, joined by line feeds.

    Character references are decoded, white space in a block is one blank. Null or empty html gives the empty text, and
    so do pages that hold nothing but template. Of hosts that a given ``template`` does not have, every page speaks for
    itself. A null url counts as the empty host. Repeated rows are extracted once each; other columns are left out.
    """
    rows = _pages(pages, id_col, url_col, html_col)
    template = templates(rows) if template is None else template
    lists = {"gone": F.concat("tokens", "slots_of_links"), "articles": F.col("articles"), "others": F.col("others")}
    by_host = cut(template.groupBy("host").agg(*[F.array_distinct(F.flatten(F.collect_list(x))).alias(c) for c, x in lists.items()]))
    small = (by_host.agg(F.sum(F.size("gone") + F.size("articles") + F.size("others") + 8)).first()[0] or 0) <= BROADCAST_TOKENS
    joined = rows.join(F.broadcast(by_host) if small else by_host, "host", "left").select("page_id", "url", "html", *lists)
    names = list(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", 2 << 20):
            slots = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            out = [Page(source or "").main_text(*(set(x or ()) for x in own)) for source, own in zip(batch.column("html").to_pylist(), slots, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
