"""What a page's tree tells about how it was rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from offerlens.functions import page as G
from offerlens.functions.price import PRICE_HINT
from offerlens.html.tree import clean, parse

PRODUCT_NODES = '[class*="product" i], [id*="product" i], [data-product], [data-product-id], [itemtype*="Product"]'
HIDDEN = "script, style, noscript, svg, template"


@udtf(returnType="text string, product_nodes int, next_data boolean")
class PageFeatures:
    def eval(self, html: str):
        t = parse(html or "")
        body = t.first("body") or 0
        hidden = [(i, t.end[i]) for i in t.all(HIDDEN)]
        text = "".join(s for e, _, s in t.texts if body <= e < t.end[body] and not any(a <= e < b for a, b in hidden))
        gone = {i for a, b in hidden for i in range(a, b)}
        yield clean(text), sum(i not in gone for i in t.all(PRODUCT_NODES)), t.first("#__NEXT_DATA__") is not None


def render_scores(pages: DataFrame, keep: list[str]) -> DataFrame:
    """(score, renderType, framework, textLength, hasPrices) of each page (html)."""
    f = pages.select(*keep, F.col("html").alias("html_in")).lateralJoin(PageFeatures(F.col("html_in").outer()))
    frame, prices, n = G.framework("html_in"), F.col("text").rlike(PRICE_HINT), F.length("text")
    score = G.rendering_score(prices, F.col("product_nodes"), F.col("next_data"), n, frame.isNotNull())
    return f.select(*keep, score.alias("score"), F.when(score >= 1, "SSR").otherwise("CSR").alias("renderType"), frame.alias("framework"), n.alias("textLength"), prices.alias("hasPrices"))
