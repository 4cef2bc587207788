"""Functions of a page's HTML and of candidate pages, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions import url as U
from offerlens.functions.price import clamp01
from offerlens.functions.text import tokenize

# Block phrases, page tells, platforms and their probe paths.
BLOCK_PHRASES = [
    "just a moment", "checking your browser", "attention required", "access denied", "verify you are human", "unusual traffic", "captcha", "cf-browser-verification", "are you a robot", "request blocked",
]
COUNTDOWN = r"""(?i)class=["'][^"']*countdown|data-countdown|\[data-timer\]|class=["'][^"']*timer|ends?\s+in|hurry|limited[\s-]time|শেষ\s*হবে|সময়\s*বাকি"""
GENERATOR = r"""(?i)<meta\s+[^>]*name=["']generator["'][^>]*content=["']([^"']+)["']"""
GENERATORS = [("shopify", "shopify"), ("woocommerce", "woocommerce"), ("wordpress", "woocommerce"), ("magento", "magento"), ("bigcommerce", "bigcommerce"), ("prestashop", "prestashop"), ("opencart", "opencart"), ("wix", "wix"), ("squarespace", "squarespace")]
PLATFORM_TELLS = [
    ("shopify", r"cdn\.shopify\.com|Shopify\.theme|myshopify\.com"),
    ("woocommerce", r"/wp-content/plugins/woocommerce|woocommerce(?:-|_)(?:ajax|js|css)"),
    ("magento", r"Mage\.Cookies|/static/frontend/Magento|mage/cookies"),
    ("bigcommerce", r"bigcommerce\.com/s-|cdn\d*\.bigcommerce\.com"),
    ("prestashop", r"""content/themes/[^"']*prestashop|PrestaShop"""),
    ("opencart", r"catalog/view/theme|route=common/home"),
    ("wix", r"wixstatic\.com|X-Wix-Request-Id"),
    ("squarespace", r"squarespace-cdn\.com|static\.squarespace\.com"),
    ("nextjs", r"__NEXT_DATA__|/_next/static/"),
]
PROBES = {
    "shopify": ["/collections/sale", "/collections/all?filter.v.price.gte=0&sort_by=best-selling", "/collections/clearance", "/collections/deals"],
    "woocommerce": ["/shop/?on_sale=1", "/product-category/sale/", "/sale/", "/offers/"],
    "magento": ["/sale.html", "/deals.html", "/promotions"],
    "bigcommerce": ["/sale/", "/categories/sale"],
    "nextjs": ["/deals", "/offers", "/sale", "/promotions"],
    "wix": ["/deals", "/sale", "/offers"],
    "squarespace": ["/deals", "/sale", "/offers"],
    "opencart": ["/index.php?route=product/special", "/specials"],
    "prestashop": ["/prices-drop", "/promotions", "/sales"],
    "unknown": ["/deals", "/offers", "/sale", "/discount", "/promotions", "/clearance", "/flash-sale", "/campaign"],
}
FRAMEWORKS = [
    ("Next.js", r"/_next/static|__NEXT_DATA__|/_next/image"),
    ("Nuxt", r"__NUXT__|/_nuxt/"),
    ("Angular", r"ng-version|_ngcontent|ng-app"),
    ("Gatsby", r"___gatsby|gatsby-"),
    ("SPA", r"""data-reactroot|id="root"|id="app"|id="__next"|react-dom|vue(\.min)?\.js"""),
]
PRODUCT_PATH = r"(?i)/(p|product|products|dp|item|sku)/[\w-]+"
SKU_TAIL = r"(?i)-(\d{4,}|[a-z0-9]{8,})(\.html?)?$"

# The deal lexicon by weight, its seasons, the words that reject.
LEXICON = {
    1.0: [
        "deal", "deals", "discount", "discounts", "offer", "offers", "sale", "sales", "clearance", "outlet", "promo", "promotion", "promotions", "flash sale", "flashsale", "hot deals", "daily deals",
        "deal of the day", "price drop", "markdown", "liquidation", "blowout", "doorbuster", "bargain", "on sale", "super saver", "ছাড়", "অফার", "ডিসকাউন্ট", "সেল", "ফ্ল্যাশ সেল", "বিশেষ ছাড়", "মূল্যছাড়",
    ],
    0.9: [
        "black friday", "cyber monday", "singles day", "11 11", "12 12", "boxing day", "summer sale", "winter sale", "eid", "eid offer", "ramadan", "boishakh", "pohela boishakh", "puja", "christmas",
        "new year sale", "anniversary sale", "mega sale", "back to school", "campaign", "ক্যাম্পেইন",
    ],
    0.45: ["save", "savings", "special", "budget", "combo", "bundle", "lowest price", "best price", "under"],
}
SEASONS = {
    "black friday": [11], "cyber monday": [11, 12], "christmas": [11, 12], "summer sale": [4, 5, 6, 7], "eid": [3, 4, 5, 6], "eid offer": [3, 4, 5, 6], "boishakh": [4], "pohela boishakh": [4], "11 11": [11], "12 12": [12],
    "back to school": [7, 8, 9],
}
NEGATIVE = ["wholesale", "resale", "salesman", "salesforce", "salem", "saletax"]
STOP = (
    "blog news article press help faq support terms privacy policy policies careers jobs about contact login signin register cart checkout account wishlist compare return refund shipping track review reviews"
).split()
SOURCE_PRIOR = {"root": 0.65, "nav": 1.0, "hero": 0.9, "platform": 0.8, "probe": 0.7, "body": 0.6, "sitemap": 0.55, "footer": 0.5, "expanded": 0.45, "network": 0.9, "memo": 0.7, "user": 1.0}
IN_SEASON, OUT_OF_SEASON, FUZZY_LENGTH = 0.10, 0.45, 6
FRESH_MS = 14 * 24 * 3600 * 1000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def detect_block(html: Column | str, status: Column | None = None) -> Column:
    """C20: why a response looks like a bot wall, else null."""
    hit = F.regexp_extract(F.substring(_c(html), 1, 20_000), f"(?i)({'|'.join(BLOCK_PHRASES)})", 1)
    out = F.when(hit != "", F.concat(F.lit('challenge page ("'), hit, F.lit('")')))
    return out if status is None else F.when(status.isin(403, 429), F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(out)


def visible_text(html: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(_c(html), r"(?i)<script[\s\S]*?</script>", ""), r"(?i)<style[\s\S]*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))


def render_type(html: Column | str) -> Column:
    """CSR for an app's shell with little visible text."""
    shell = _c(html).rlike(r"""(?i)<div\s+id=["'](__next|root|app)["']|__NEXT_DATA__|__NUXT__""")
    return F.when(shell & (F.length(visible_text(html)) < 500), "CSR").otherwise("SSR")


def framework(html: Column | str) -> Column:
    return F.coalesce(*(F.when(_c(html).rlike(f"(?i){p}"), name) for name, p in FRAMEWORKS))


def rendering_score(has_prices: Column, product_nodes: Column, has_next_data: Column, text_length: Column, has_framework: Column) -> Column:
    """One or more is server-rendered."""
    points = lambda c, yes, no=0: F.when(c, yes).otherwise(no)
    return points(has_prices, 2, -2) + points(product_nodes >= 3, 2) + points(has_next_data, 2) + points(text_length > 2500, 1) + points(has_framework, -2) + points(text_length < 1200, -2)


def has_countdown(html: Column | str) -> Column:
    """C23."""
    return F.substring(_c(html), 1, 500_000).rlike(COUNTDOWN)


def platform(html: Column | str) -> Column:
    """The shop platform: its generator tag first, then the first tell in order."""
    generator = F.lower(F.regexp_extract(_c(html), GENERATOR, 1))
    head = F.substring(_c(html), 1, 500_000)
    return F.coalesce(*(F.when(F.contains(generator, F.lit(word)), name) for word, name in GENERATORS), *(F.when(head.rlike(f"(?i){p}"), name) for name, p in PLATFORM_TELLS))


def probe_paths(name: Column | str) -> Column:
    """Conventional paths of a platform; of none, the general ones."""
    out = F.array(*map(F.lit, PROBES["unknown"]))
    for key, paths in PROBES.items():
        out = F.when(_c(name) == key, F.array(*map(F.lit, paths))).otherwise(out)
    return out


def _grams(tokens: Column) -> Column:
    """Words and pairs of words, in order of their first word."""
    pairs = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(tokens, i), w))
    return F.concat(tokens, pairs)


def keyword_score(text: Column | str, month: Column | int, lexicon: dict[float, list[str]] | None = None) -> Column:
    """The greatest weight of a text's words and word pairs.

    A seasonal term is raised in season and damped out of it; a word of six letters or more within one edit of
    a strong single word of six or more counts as that word.
    """
    lexicon = lexicon or LEXICON
    m = F.lit(month) if isinstance(month, int) else month
    tokens = tokenize(F.coalesce(_c(text), F.lit("")))
    entries = []
    for weight, terms in lexicon.items():
        for t in terms:
            w = F.lit(weight)
            if t in SEASONS:
                w = F.when(m.isin(SEASONS[t]), F.lit(min(1.0, weight + IN_SEASON))).otherwise(F.lit(OUT_OF_SEASON))
            entries += [F.lit(t), w.cast("double")]
    table = F.create_map(*entries)
    strong = [t for t in lexicon[1.0] if " " not in t and len(t) >= FUZZY_LENGTH and t.isascii()]
    known = F.transform(_grams(tokens), lambda g: F.coalesce(F.try_element_at(table, g), F.lit(0.0)))
    near = lambda w: F.exists(F.array(*map(F.lit, strong)), lambda t: F.levenshtein(w, t, 1) >= 0)
    fuzzy = F.exists(tokens, lambda w: (F.length(w) >= FUZZY_LENGTH) & F.try_element_at(table, w).isNull() & near(w))
    return F.greatest(F.coalesce(F.array_max(known), F.lit(0.0)), F.when(fuzzy, F.lit(1.0)).otherwise(F.lit(0.0)))


def negative_token(text: Column | str) -> Column:
    """The first rejecting word, else null."""
    return F.get(F.filter(tokenize(F.coalesce(_c(text), F.lit(""))), lambda t: t.isin(NEGATIVE)), F.lit(0))


def stop_segment(path: Column | str) -> Column:
    """The first word of a path that no deal page has, else null."""
    return F.get(F.filter(tokenize(F.coalesce(_c(path), F.lit(""))), lambda t: t.isin(STOP)), F.lit(0))


def is_product_page(path: Column | str) -> Column:
    """C30."""
    return _c(path).rlike(PRODUCT_PATH) | _c(path).rlike(SKU_TAIL)


def candidate_prior(url: Column, source: Column, anchor: Column, title: Column, month: Column | int, lastmod_ms: Column | None = None, now_ms: Column | None = None, nav_and_footer: Column | None = None) -> Column:
    """(score, reject) of a candidate page from its URL, its labels and where it was found."""
    path = U.path(url)
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    stop, negative = stop_segment(path), F.coalesce(negative_token(path), negative_token(anchor), negative_token(title))
    reject = F.when(U.host(url) == "", "unparseable-url").when(stop.isNotNull(), F.concat(F.lit("stop-segment:"), stop)).when(negative.isNotNull(), F.concat(F.lit("neg-token:"), negative))
    keyword = F.greatest(keyword_score(anchor, month), keyword_score(path, month) * 0.85, keyword_score(title, month) * 0.7)
    prior = F.lit(0.0)
    for name, p in SOURCE_PRIOR.items():
        prior = F.when(source == name, F.lit(p)).otherwise(prior)
    amount = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    bonus = amount(depth == 1, 0.05)
    if lastmod_ms is not None and now_ms is not None:
        bonus = bonus + amount(lastmod_ms.isNotNull() & (now_ms - lastmod_ms < FRESH_MS), 0.1)
    if nav_and_footer is not None:
        bonus = bonus + amount(F.coalesce(nav_and_footer, F.lit(False)), 0.1)
    parameters = F.size(F.filter(F.split(U.query(url), "&"), lambda x: x != ""))
    penalty = amount(depth > 3, 0.3) + amount(is_product_page(path), 0.4) + amount(parameters >= 3, 0.25)
    score = clamp01(F.lit(0.6) * keyword + F.lit(0.4) * prior + bonus - penalty)
    return F.struct(F.when(reject.isNotNull(), F.lit(0.0)).otherwise(score).alias("score"), reject.alias("reject"))


def verdict(count: Column, density: Column, quality: Column, countdown: Column, prior: Column) -> Column:
    """Why a checked page is no deal page, else null."""
    strong = (count >= 8) & (quality >= 0.35) & ((density >= 0.30) | countdown | (prior >= 0.80))
    return F.when(count < 3, "not-a-listing").when((density < 0.05) & (prior < 0.75), "no-discounts").when(~strong, "demoted")


def final_score(prior: Column, count: Column, density: Column, quality: Column, countdown: Column) -> Column:
    """The ranking blend; its weights sum to 1.05, so it is clamped."""
    return clamp01(F.lit(0.35) * prior + F.lit(0.3) * F.least(F.lit(1.0), count / 40.0) + F.lit(0.2) * density + F.lit(0.15) * quality + F.when(countdown, F.lit(0.05)).otherwise(F.lit(0.0)))
