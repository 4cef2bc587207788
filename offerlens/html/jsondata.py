"""JSON inside pages: where it stands, and the products in it."""

from __future__ import annotations

import json
import re

from offerlens.html.tree import Tree

# Script patterns and the key banks of product objects.
GLOBALS = re.compile(r"(?:window\.)?__(?:NUXT|APOLLO_STATE|PRELOADED_STATE|INITIAL_STATE|INITIAL_DATA|NEXT_DATA)__\s*=\s*")
PUSHED = re.compile(r'self\.__next_f\.push\(\s*\[\s*\d+\s*,\s*("(?:[^"\\]|\\.)*")\s*\]\s*\)')
FLIGHT_ROW = re.compile(r"(?:^|\n)\s*[0-9a-z]+\s*:\s*(?=[{[])", re.IGNORECASE)
NAME = "name title productName product_name displayName itemName productTitle".split()
DEAL = "dealPrice salePrice sellingPrice discountPrice discountedPrice specialPrice offerPrice currentPrice salesPrice unitPrice price sale_price selling_price".split()
ORIGINAL = "originalPrice mrp regularPrice listPrice oldPrice marketPrice basePrice priceBeforeDiscount retailPrice compareAtPrice".split()
IMAGE = "image imageUrl image_url img thumbnail thumb photo picture imagePath featuredImage images".split()
URL = "productUrl url link href slug permalink canonicalUrl webUrl".split()
DISCOUNT = "discountPercentage discountPercent discount_percent percentOff offPercentage discount".split()
LD_CONTAINERS = "@graph itemListElement item itemOffered mainEntity hasPart".split()


def literal_at(text: str, start: int) -> str | None:
    """The bracketed literal that begins at `start`, quotes respected; null if it never closes."""
    if text[start : start + 1] not in ("{", "["):
        return None
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[{\[]|[}\]]|"', re.DOTALL).finditer(text, start):
        c = m[0]
        if c == '"':
            return None  # a string that never ends
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


def _loads(s: str | None):
    try:
        return json.loads(s) if s else None
    except (ValueError, RecursionError):
        return None


def literals_after(code: str, pattern: re.Pattern):
    """Parsed literals behind each hit; what does not parse is dropped."""
    for m in pattern.finditer(code):
        at = re.compile(r"[\[{]").search(code, m.end())
        got = _loads(literal_at(code, at.start())) if at else None
        if got is not None:
            yield got


def sources(t: Tree):
    """(kind, value) of the JSON scripts, then of hydration globals and flight chunks, script by script."""
    for i in t.all('script[type="application/json"]'):
        got = _loads(t.text(i).strip())
        if got is not None:
            yield "script", got
    for i in t.all("script:not([src])"):
        code = t.text(i)
        for x in literals_after(code, GLOBALS):
            yield "global", x
        parts = [s for s in (_loads(m[1]) for m in PUSHED.finditer(code)) if isinstance(s, str)] if "__next_f.push" in code else []
        flight = "".join(parts)
        for m in FLIGHT_ROW.finditer(flight):
            got = _loads(literal_at(flight, m.end()))
            if got is not None:
                yield "flight", got


def first(obj: dict, keys: list[str]):
    return next((obj[k] for k in keys if obj.get(k) is not None and obj[k] != ""), None)


def ld_products(node, depth: int = 0):
    """Schema.org product objects, through the containers that listings use."""
    if depth > 8 or not node:
        return
    if isinstance(node, list):
        for x in node:
            yield from ld_products(x, depth + 1)
    elif isinstance(node, dict):
        kinds = node.get("@type")
        if "product" in [str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])]:
            yield node
            return
        for key in LD_CONTAINERS:
            if key in node:
                yield from ld_products(node[key], depth + 1)


def ld_price(offers) -> tuple[object, str | None]:
    """(price, currency) of the first offer."""
    o = offers[0] if isinstance(offers, list) and offers else offers
    if not isinstance(o, dict):
        return None, None
    spec = o.get("priceSpecification") if isinstance(o.get("priceSpecification"), dict) else {}
    price = next((x for x in (o.get("price"), o.get("lowPrice"), spec.get("price")) if x is not None), None)
    currency = next((x for x in (o.get("priceCurrency"), spec.get("priceCurrency")) if x is not None), None)
    return price, currency if isinstance(currency, str) else None


def product_objects(data, productish):
    """Objects of the lists of which half or more, and two objects at least, look like products."""
    stack = [(data, 0)]
    while stack:
        node, depth = stack.pop()
        if node is None or depth > 12:
            continue
        if isinstance(node, list):
            objects = [x for x in node if isinstance(x, dict)]
            good = [x for x in objects if productish(x)]
            if len(objects) >= 2 and 2 * len(good) >= len(objects):
                yield from good
            stack.extend((x, depth + 1) for x in reversed(node))
        elif isinstance(node, dict):
            stack.extend((x, depth + 1) for x in reversed(list(node.values())))
