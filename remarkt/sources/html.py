"""Listing cards and details from captured pages, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.scalars import is_condition_label, normalize_link, trim_lines

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript"))


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def all(self, tag: str, class_: str | None = None):
        """Descendants of a tag and class, in the order of the page."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                if n.tag == tag and (class_ is None or class_ in n.attributes.get("class", "").split()):
                    yield n
                stack.extend(reversed(n.children))

    def places(self, tag: str):
        """Where a tag's descendants stand, in the order of the page: the children among which each is, and its index there."""
        for i, n in enumerate(self.children):
            if isinstance(n, Node):
                if n.tag == tag:
                    yield self.children, i
                yield from n.places(tag)

    def one(self, tag: str, class_: str | None = None) -> Node | None:
        return next(self.all(tag, class_), None)

    def strings(self, skip: frozenset[str] = frozenset(), without: str | None = None):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    yield n.strip()
            elif n.tag not in skip and (without is None or without not in n.attributes.get("class", "").split()):
                stack.extend(reversed(n.children))

    def text(self, between: str = "", skip: frozenset[str] = frozenset(), without: str | None = None) -> str | None:
        return between.join(self.strings(skip, without)) or None


class Page(HTMLParser):
    """A tree of a page; end tags without a start are left out."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        # nodes don't know their parents: a tree without cycles goes as soon as its page is read
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def text_of(node: Node | None) -> str | None:
    return node.text() if node else None


def link_of(card: Node) -> str | None:
    return next((a.attributes["href"] for a in card.all("a") if "href" in a.attributes), None)


def cards_of(page: Node, kind: str) -> list[dict]:
    if kind == "mercari":
        cards = page.all("li", "list")
    elif kind == "rakuma":
        cards = (li for ul in page.all("ul", "item-lists") for li in ul.children if isinstance(li, Node) and li.tag == "li" and "list" in li.attributes.get("class", "").split())
    else:
        cards = page.all("li", "itemCard")
    found = []
    for card in cards:
        row = {"link": link_of(card), "buyout": None, "fixed": None, "current": None, "listing_type": None}
        if kind != "yahooauction":
            row |= {"name": text_of(card.one("h2", "name")), "fixed": text_of(card.one("p", "price"))}
        else:
            row |= {"name": text_of(card.one("div", "itemCard__itemName")), "listing_type": "fleamarket" if card.one("div", "itemCard__fleamarket") else "auction"}
            details = card.one("div", "g-priceDetails")
            for item in details.all("li", "g-priceDetails__item") if details else ():
                title, price = text_of(item.one("span", "g-title")), text_of(item.one("span", "g-price"))
                if title is None or price is None:
                    continue
                row |= {kind_of_price(title): price}
        found.append(row)
    return found


def kind_of_price(label: str) -> str:
    """The first kind whose words a label has, without those it mustn't have; else one that is not read."""
    return next((kind for kind, words, without in config.PRICE_LABELS if any(w in label for w in words) and not any(w in label for w in without)), "other")


def condition_of(page: Node, kind: str) -> str | None:
    table = "m-goodsTable" if kind == "mercari" else "attrContainer__detail"
    linked = next((a for dl in page.all("dl", table) for a in dl.all("a") if "condition=" in a.attributes.get("href", "")), None)
    if linked:
        return linked.text()
    dl = page.one("dl", table) if kind == "mercari" else None
    for own, i in dl.places("dt") if dl else ():
        said = (own[i].text() or "").lower()
        if "condition" in said or "状態" in said:
            after = next((n for n in own[i + 1 :] if isinstance(n, Node) and n.tag == "dd"), None)
            if after:
                return after.text()
    return None


def labelled(page: Node) -> list[dict]:
    """Labels and values of an auction's detail list, without tooltips."""
    found = []
    for li in page.all("li", "itemDetail__list"):
        name, value = li.one("div", "itemDetail__listName"), li.one("div", "itemDetail__listValue")
        if name and value:
            found.append({"label": name.text(" ", without="tooltip-auc"), "value": value.text()})
    return found


def description_of(page: Node, kind: str) -> str | None:
    own = page.one("div", "itemDetail__content") if kind == "rakuma" else page.one("p", "m-itemDetail__content")
    for node in (own, page.one("body"), page):
        if node and (text := node.text("\n", HIDDEN if node is not own else frozenset())):
            return text
    return None


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PARTS = T.StructType([
    *strings("condition", "description").fields, T.StructField("labelled", T.ArrayType(strings("label", "value"))), T.StructField("cards", T.ArrayType(strings("link", "name", "buyout", "fixed", "current", "listing_type"))),
])
KINDS = ("mercari", "rakuma", "yahooauction")


def parts(html: str | None, kind: str) -> tuple:
    """All that is read of a page; its tree ends here."""
    root, auction = Page(html or "").root, kind == "yahooauction"
    return None if auction else condition_of(root, kind), description_of(root, kind), labelled(root) if auction else [], cards_of(root, kind)


@F.pandas_udf(PARTS)
def parse(pages: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    """One function for cards and details, so that a plan with both parses a page once; one tree is held at a time."""
    return pd.DataFrame([parts(h, k) for h, k in zip(pages, kinds, strict=True)], columns=["condition", "description", "labelled", "cards"], index=pages.index, dtype=object)


def listing_cards(html: Column, kind: str, base: str) -> Column:
    """array of (link, name, price, price_type, listing_type) of a listing page; auctions without a fixed price are left out.

    Explode it with posexplode_outer: for the others Spark infers a filter that parses once more.
    """
    price = lambda x: F.coalesce(x["buyout"], x["fixed"], F.when(x["listing_type"] == "fleamarket", x["current"]))
    type_ = lambda x: F.when(x["listing_type"].isNotNull(), F.when(x["buyout"].isNotNull(), "buyout").when(price(x).isNotNull(), "fixed").otherwise("current_bid_skip"))
    rows = F.transform(parse(html, F.lit(kind))["cards"], lambda x: F.struct(normalize_link(x["link"], base).alias("link"), x["name"].alias("name"), price(x).alias("price"), type_(x).alias("price_type"), x["listing_type"].alias("listing_type")))
    return rows if kind != "yahooauction" else F.filter(rows, lambda x: x["link"].isNotNull() & x["price"].isNotNull())


def detail(html: Column, kind: str) -> Column:
    """condition and description of a detail page.

    The condition is null without one. The description is the item's, else the page's visible text, a line for each
    string. Null and empty pages give nulls.
    """
    found = parse(html, F.lit(kind))
    of_label = F.get(F.filter(found["labelled"], lambda x: is_condition_label(x["label"])), F.lit(0))["value"]
    return F.struct(F.coalesce(found["condition"], of_label).alias("condition"), trim_lines(found["description"]).alias("description"))


def detail_condition(html: Column, kind: str) -> Column:
    return detail(html, kind)["condition"]


def detail_description(html: Column, kind: str) -> Column:
    return detail(html, kind)["description"]
