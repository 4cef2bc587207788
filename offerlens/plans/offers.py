"""Queries over offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import price as P
from offerlens.functions import text as X
from offerlens.operators import offers as O
from offerlens.sources.tables import OFFERS_SQL, offers, part_titles

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_D = "CAST({} AS DOUBLE)"
_JS_ROUND = "CAST(floor({} + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(f"""WITH {OFFERS_SQL} SELECT substr(sha1(sourceSite || '|' || productUrl || '|' || title), 1, 12) AS id, suppkey, ord, title, originalPrice, dealPrice, discountPercentage, currency, sourceSite, productUrl, imageUrl FROM offers""")
def offers_view(spark, sf_dir):
    """Offers as a typed table with their ids."""
    o = offers(spark, sf_dir)
    return o.select(P.make_id(F.col("sourceSite"), F.col("productUrl"), F.col("title")).alias("id"), "suppkey", "ord", "title", "originalPrice", "dealPrice", "discountPercentage", "currency", "sourceSite", "productUrl", "imageUrl")


_TEXTS = ["'৳' || p", "'Tk ' || p || ' - ' || (p * 2)", "'was 1,250.50 now ' || p", "'EQ27 20mm 12 Pcs ' || p", "p || ' Tk'", "'  ' || p || '  '", "'৳১,২৫০ / ' || p || '% off'", "'USD ' || p", "'€' || p || ' £' || p", "'-' || p || '%'"]
_NORM = "translate(t, '০১২৩৪৫৬৭৮৯', '0123456789')"
_AMOUNTS = f"list_filter([try_cast(replace(x, ',', '') AS DOUBLE) FOR x IN regexp_extract_all(regexp_replace({_NORM}, '\\d+(?:\\.\\d+)?\\s*%', ' ', 'g'), '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?')], lambda n: n > 0)"
_PRE, _SUF = P.PREFIXED.replace("'", "''"), P.SUFFIXED.replace("'", "''")
_ONE, _TWO = (f"regexp_extract_all({_NORM}, '(?i){_PRE}|{_SUF}', {g})" for g in (1, 2))
_ANCHORED = f"list_filter([try_cast(replace(CASE WHEN {_ONE}[i] <> '' THEN {_ONE}[i] ELSE {_TWO}[i] END, ',', '') AS DOUBLE) FOR i IN range(1, len({_ONE}) + 1)], lambda n: n > 0)"
_TEXTS_SQL = f"""texts AS (SELECT p_partkey, k, t FROM (SELECT p_partkey, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS p0, unnest({list(range(len(_TEXTS)))}) AS k, CAST(floor(p_retailprice) AS BIGINT) AS p FROM part) x,
  LATERAL (SELECT CASE k {" ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS))} END AS t))"""


def _price_texts(spark, sf_dir):
    """Ten price texts for each part, from its whole price."""
    from offerlens.sources.tables import table

    parts = table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").alias("p"))
    return parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(_TEXTS) - 1)))).select("p_partkey", "k", F.expr(f"CASE k {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(_TEXTS))} END").alias("t"))


@query(f"""WITH {_TEXTS_SQL} SELECT p_partkey, CAST(k AS BIGINT) AS k, len({_AMOUNTS}) AS n_amounts, list_min({_AMOUNTS}) AS price, list_max({_AMOUNTS}) AS most FROM texts""")
def price_parse(spark, sf_dir):
    """Amounts and the least of them in price texts."""
    return _price_texts(spark, sf_dir).withColumn("a", P.extract_amounts("t")).select("p_partkey", F.col("k").cast("long").alias("k"), F.size("a").cast("long").alias("n_amounts"), P.parse_price("t").alias("price"), F.array_max("a").alias("most"))


@query(
    f"""WITH {_TEXTS_SQL}, m AS (SELECT *, regexp_matches(t, '[৳$€£₹₨]|(?i)\\b(?:Tk|BDT|Rs|INR|RM|Rp|AED|SAR|USD|EUR|GBP|kr)\\b') AS marked, regexp_matches(t, '^[\\d,.\\s]+$') AS bare FROM texts),
  a AS (SELECT p_partkey, k, CASE WHEN marked THEN {_ANCHORED} WHEN bare THEN {_AMOUNTS} ELSE [] END AS a FROM m)
  SELECT p_partkey, CAST(k AS BIGINT) AS k, len(a) AS n_amounts, list_min(a) AS least, list_max(a) AS most FROM a"""
)
def price_invariant(spark, sf_dir):
    """Only anchored or all-numeric texts give amounts."""
    return _price_texts(spark, sf_dir).withColumn("a", P.amounts_from_price_text("t")).select("p_partkey", F.col("k").cast("long").alias("k"), F.size("a").cast("long").alias("n_amounts"), F.array_min("a").alias("least"), F.array_max("a").alias("most"))


@query(
    f"""WITH {_TEXTS_SQL} SELECT p_partkey, CAST(k AS BIGINT) AS k, CASE WHEN regexp_matches(t, '৳|(?i)Tk\\.?|BDT|টাকা') THEN 'BDT' WHEN regexp_matches(t, '\\$|(?i)USD') THEN 'USD' WHEN regexp_matches(t, '€|(?i)EUR') THEN 'EUR'
  WHEN regexp_matches(t, '£|(?i)GBP') THEN 'GBP' WHEN regexp_matches(t, '₹|(?i)INR') THEN 'INR' ELSE 'BDT' END AS currency FROM texts"""
)
def currency_detect(spark, sf_dir):
    """B4."""
    return _price_texts(spark, sf_dir).select("p_partkey", F.col("k").cast("long").alias("k"), P.detect_currency("t").alias("currency"))


@query(f"""WITH {OFFERS_SQL} SELECT suppkey, ord, discountPercentage AS pct, coalesce(CAST(NULL AS DOUBLE), CASE WHEN dealPrice > 0 AND originalPrice > dealPrice THEN (CAST(1 AS DOUBLE) - dealPrice / originalPrice) * 100 END, CAST(0 AS DOUBLE)) AS effective FROM offers""")
def effective_discount(spark, sf_dir):
    """B5, B11."""
    return offers(spark, sf_dir).select("suppkey", "ord", F.col("discountPercentage").alias("pct"), P.effective_discount(F.lit(None), "originalPrice", "dealPrice").alias("effective"))


@query(f"""WITH {OFFERS_SQL} SELECT sourceSite, count(*) AS offers, sum(dealPrice) > 0 AS some FROM offers WHERE coalesce(CAST(discountPercentage AS DOUBLE), 0) >= 5 GROUP BY sourceSite""")
def min_discount_filter(spark, sf_dir):
    """Offers of five per cent off or more, by shop."""
    return O.min_discount(offers(spark, sf_dir), 5).groupBy("sourceSite").agg(F.count("*").alias("offers"), (F.sum("dealPrice") > 0).alias("some"))


@query(f"""WITH {OFFERS_SQL}, o AS (SELECT *, CASE WHEN line % 2 = 0 THEN originalPrice END AS op FROM offers) SELECT sourceSite, count(*) AS offers FROM o WHERE NOT (line % 3 = 1) OR op IS NOT NULL OR coalesce(discountPercentage >= 5, false) GROUP BY sourceSite""")
def fallback_discounted_only(spark, sf_dir):
    """On fallback pages only discounted offers count (D3)."""
    o = offers(spark, sf_dir).withColumn("originalPrice", F.when(F.col("line") % 2 == 0, F.col("originalPrice")))
    return O.discounted_only(o, F.col("line") % 3 == 1, 5).groupBy("sourceSite").agg(F.count("*").alias("offers"))


def _rough(o):
    """Offers at rough prices, so that several share title and price; one in two without original price."""
    return o.withColumn("dealPrice", F.floor(F.col("dealPrice") / 20000.0) * 20000.0 + 10.0).withColumn("originalPrice", F.when(F.col("line") % 2 == 0, F.col("originalPrice")))


_ROUGH = "rough AS (SELECT suppkey, ord, title, floor(dealPrice / CAST(20000 AS DOUBLE)) * CAST(20000 AS DOUBLE) + CAST(10 AS DOUBLE) AS dealPrice, CASE WHEN line % 2 = 0 THEN originalPrice END AS originalPrice, discountPercentage, currency, sourceSite, productUrl, imageUrl, pageUrl, line FROM offers)"


@query(
    f"""WITH {OFFERS_SQL}, {_ROUGH}, f AS (SELECT suppkey, lower(title) AS kt, dealPrice, min(ord) AS ord FROM rough GROUP BY ALL),
  g AS (SELECT r.suppkey, lower(r.title) AS kt, r.dealPrice, arg_min(r.title, r.ord) AS title, arg_min(r.productUrl, r.ord) AS url0, any_value(pageUrl) AS page,
     arg_min(r.imageUrl, r.ord) FILTER (coalesce(r.imageUrl, '') <> '') AS imageUrl, arg_min(r.productUrl, r.ord) FILTER (r.productUrl <> r.pageUrl) AS url1, bool_or(r.ord = f.ord AND r.originalPrice IS NOT NULL) AS own,
     bool_or(r.ord = f.ord AND r.discountPercentage IS NOT NULL) AS ownp, max(CASE WHEN r.ord = f.ord THEN r.originalPrice END) AS op0, max(CASE WHEN r.ord = f.ord THEN r.discountPercentage END) AS pct0,
     arg_min(r.originalPrice, r.ord) FILTER (r.originalPrice > r.dealPrice) AS op1, min_by(struct_pack(x := r.discountPercentage), r.ord) FILTER (r.originalPrice > r.dealPrice) AS pct1, min(r.ord) AS ord
   FROM rough r JOIN f ON r.suppkey = f.suppkey AND lower(r.title) = f.kt AND r.dealPrice = f.dealPrice GROUP BY r.suppkey, lower(r.title), r.dealPrice),
  n AS (SELECT *, row_number() OVER (PARTITION BY suppkey ORDER BY ord) AS nth FROM g)
  SELECT suppkey, ord, title, dealPrice, CASE WHEN own THEN op0 ELSE op1 END AS originalPrice, CASE WHEN own OR ownp THEN pct0 ELSE pct1.x END AS discountPercentage,
    CASE WHEN url0 = page AND url1 IS NOT NULL THEN url1 ELSE url0 END AS productUrl, imageUrl FROM n WHERE nth <= 200"""
)
def offer_dedupe_backfill(spark, sf_dir):
    """The merge of one shop's offers with backfill and cap (F1)."""
    m = O.merge(_rough(offers(spark, sf_dir)), ["suppkey"], 200, "pageUrl")
    return m.select("suppkey", "ord", "title", "dealPrice", "originalPrice", "discountPercentage", "productUrl", "imageUrl")


@query(
    f"""WITH {OFFERS_SQL}, {_ROUGH}, a AS (SELECT *, row_number() OVER (PARTITION BY suppkey, lower(title), dealPrice ORDER BY ord) AS n FROM rough),
  b AS (SELECT suppkey, ord, title, dealPrice, row_number() OVER (PARTITION BY suppkey ORDER BY ord) AS m FROM a WHERE n = 1) SELECT suppkey, ord, title, dealPrice FROM b WHERE m <= 200"""
)
def offer_first_by_price(spark, sf_dir):
    """F2."""
    return O.first_by_price(_rough(offers(spark, sf_dir)), ["suppkey"]).select("suppkey", "ord", "title", "dealPrice")


_QUALITY = f"""q AS (SELECT {{by}}, count(*) AS n, avg(CASE WHEN productUrl <> pageUrl THEN CAST(1 AS DOUBLE) ELSE 0 END) AS links, avg(CASE WHEN coalesce(imageUrl, '') <> '' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS img,
   avg(CASE WHEN originalPrice IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS op, min(dealPrice) AS lo, max(dealPrice) AS hi, max({{claim}}) AS claim FROM rough GROUP BY ALL),
  s AS (SELECT {{by}}, n, CASE WHEN n = 1 THEN CAST(1 AS DOUBLE) ELSE links END AS rl, img, op, claim, CASE WHEN claim >= n THEN CAST(n AS DOUBLE) / claim END AS cov, n > 1 AND lo = hi AS same, n > 2 AND lo > 0 AND hi / lo > 500 AS wide FROM q),
  r AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (CAST(0.35 AS DOUBLE) * rl + CAST(0.25 AS DOUBLE) * img + CAST(0.15 AS DOUBLE) * op + CAST(0.25 AS DOUBLE) * least(coalesce(cov, 0), CAST(1 AS DOUBLE)))
     / (CAST(0.75 AS DOUBLE) + CASE WHEN cov IS NOT NULL THEN CAST(0.25 AS DOUBLE) ELSE 0 END) * CASE WHEN same THEN CAST(0.3 AS DOUBLE) ELSE 1 END * CASE WHEN wide THEN CAST(0.7 AS DOUBLE) ELSE 1 END)) AS score FROM s)"""
_SIX = "floor({} * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6"


def _six(c):
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


@query(
    f"""WITH {OFFERS_SQL}, {_ROUGH}, {_QUALITY.format(by="suppkey", claim="CAST(700 AS BIGINT)")} SELECT suppkey, n AS productCount, {_SIX.format("rl")} AS pctWithRealLink, {_SIX.format("img")} AS pctWithImage, {_SIX.format("op")} AS pctWithOriginalPrice,
  {_SIX.format("cov")} AS coverage, {_SIX.format("score")} AS score, concat_ws(',', CASE WHEN same THEN 'all-prices-identical' END, CASE WHEN wide THEN 'extreme-variance' END, CASE WHEN rl < 0.5 AND n > 1 THEN 'mostly-fallback-links' END, CASE WHEN cov < 0.2 THEN 'low-coverage' END) AS flags FROM r"""
)
def extraction_quality(spark, sf_dir):
    """F3 by shop, with a claimed total of 700."""
    q = O.quality(_rough(offers(spark, sf_dir)), ["suppkey"], F.col("pageUrl"), F.lit(700).cast("long"))
    return q.select("suppkey", "productCount", *(_six(c).alias(c) for c in ("pctWithRealLink", "pctWithImage", "pctWithOriginalPrice", "coverage", "score")), F.array_join("flags", ",").alias("flags"))


@query(
    f"""WITH {OFFERS_SQL}, {_ROUGH}, {_QUALITY.format(by="suppkey, attempt", claim="CAST(NULL AS BIGINT)").replace("FROM rough", "FROM (SELECT *, line % 3 AS attempt FROM rough)")},
  t AS (SELECT suppkey, attempt, score, max(score) OVER (PARTITION BY suppkey ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
  SELECT suppkey, CAST(arg_max(attempt, score * 1000000 - attempt / 1000.0) AS BIGINT) AS attempt, {_SIX.format("max(score)")} AS score FROM t WHERE coalesce(before, 0) < 0.35 GROUP BY suppkey"""
)
def escalate_best_attempt(spark, sf_dir):
    """Each shop's lines as three tries."""
    tries = O.quality(_rough(offers(spark, sf_dir)).withColumn("attempt", F.col("line") % 3), ["suppkey", "attempt"], F.col("pageUrl"))
    return O.best_attempt(tries, ["suppkey"]).select("suppkey", F.col("attempt").cast("long").alias("attempt"), _six("score").alias("score"))


_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\b(pack of|pcs|pc|pack|combo|free|offer|new|hot|deal)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_GENERIC = "[" + ", ".join(f"'{w}'" for w in X.GENERIC) + "]"
_TOKENS = f"list_sort(list_distinct(list_filter(string_split({_TITLE.format('title')}, ' '), lambda w: length(w) >= 2 AND NOT list_contains({_GENERIC}, w))))"
_TITLES_SQL = "titles AS (SELECT p_partkey, p_brand, p_name || ' ' || p_brand || ' ' || p_type || ' pk' || p_partkey AS title FROM part)"


@query(
    f"""WITH {_TITLES_SQL}, t AS (SELECT p_partkey, title, {_TOKENS} AS tokens FROM titles) SELECT p_partkey, {_TITLE.format("title || ' (New) Pack of 6 pcs!'")} AS norm, list_aggregate(tokens, 'string_agg', ' ') AS tokens,
  coalesce(list_aggregate(list_filter(tokens, lambda x: (length(x) >= 3 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[a-z0-9]+$')) OR regexp_matches(x, '^[0-9]{{4,}}$')), 'string_agg', ' '), '') AS models FROM t"""
)
def title_tokens(spark, sf_dir):
    """C2-C4 over part titles."""
    t = part_titles(spark, sf_dir).withColumn("tokens", F.array_sort(X.content_tokens(X.normalize_title("title"))))
    return t.select("p_partkey", X.normalize_title(F.concat("title", F.lit(" (New) Pack of 6 pcs!"))).alias("norm"), F.array_join("tokens", " ").alias("tokens"), F.array_join(X.model_tokens("tokens"), " ").alias("models"))


LEAST_JACCARD = 0.6


@query(
    f"""WITH {_TITLES_SQL}, t AS (SELECT p_partkey, {_TOKENS} AS tokens, p_brand FROM titles),
  j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(len(list_intersect(a.tokens, b.tokens)) AS DOUBLE) / len(list_distinct(list_concat(a.tokens, b.tokens))) AS j FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
  SELECT a, b, {_SIX.format("j")} AS jaccard FROM j WHERE j >= {LEAST_JACCARD}"""
)
def title_jaccard_pairs(spark, sf_dir):
    """F7 over all parts of one brand: the pairs of at least LEAST_JACCARD."""
    t = part_titles(spark, sf_dir).select(F.col("p_partkey").alias("id"), "p_brand", X.content_tokens(X.normalize_title("title")).alias("tokens"))
    return O.similar_titles(t, ["p_brand"], LEAST_JACCARD).select("a", "b", _six("jaccard").alias("jaccard"))


_BIGRAMS = "[substr({0}, i, 2) FOR i IN range(1, length({0}))]"


@query(
    f"""WITH t AS (SELECT p_name, regexp_replace(lower(p_name), '\\s+', '', 'g') AS s, min(p_size) AS size FROM part GROUP BY ALL), n AS (SELECT p_name, s, {_BIGRAMS.format("s")} AS g FROM t)
  SELECT a.p_name AS a, b.p_name AS b, {_SIX.format("CAST(2 AS DOUBLE) * list_sum([least(len(list_filter(a.g, lambda v: v = x)), len(list_filter(b.g, lambda v: v = x))) FOR x IN list_distinct(a.g)]) / (len(a.g) + len(b.g))")} AS dice
  FROM n a JOIN n b ON a.p_name < b.p_name"""
)
def dice_pairs(spark, sf_dir):
    """F8 over the distinct part names (a small fixed vocabulary)."""
    from offerlens.sources.tables import table

    names = table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("a")).join(names.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))
    return pairs.withColumn("d", X.dice(F.lower("a"), F.lower("b"))).select("a", "b", _six("d").alias("dice"))


@query()
def comparison_groups(spark, sf_dir):
    """Where the same product is cheaper: runs of ten shops, 200 offers of each, merged and grouped."""
    o = O.first_by_price(offers(spark, sf_dir), ["suppkey"]).withColumn("run", F.floor(F.col("suppkey") / 10))
    return O.comparison_groups(o.withColumn("ord", F.col("suppkey") * 1_000_000 + F.col("ord")), ["run"])


@query(
    f"""WITH {OFFERS_SQL} SELECT title, currency, count(DISTINCT sourceSite) AS sites, count(*) AS items, min(dealPrice) AS bestPrice, max(dealPrice) AS worstPrice, max(dealPrice) - min(dealPrice) AS savings,
  {_JS_ROUND.format("(max(dealPrice) - min(dealPrice)) / max(dealPrice) * 100")} AS savingsPercent FROM offers GROUP BY title, currency HAVING count(DISTINCT sourceSite) > 1 AND max(dealPrice) / min(dealPrice) <= 5"""
)
def same_title_groups(spark, sf_dir):
    """The set-based form of the grouping: equal titles of one currency within the price ratio."""
    savings = F.max("dealPrice") - F.min("dealPrice")
    g = offers(spark, sf_dir).groupBy("title", "currency").agg(
        F.countDistinct("sourceSite").alias("sites"), F.count("*").alias("items"), F.min("dealPrice").alias("bestPrice"), F.max("dealPrice").alias("worstPrice"), savings.alias("savings"), P.js_round(savings / F.max("dealPrice") * 100).alias("savingsPercent")
    )
    return g.where("sites > 1 AND worstPrice / bestPrice <= 5")


@query(f"""WITH {OFFERS_SQL} SELECT count(DISTINCT sourceSite) AS shops, count(*) AS offers, coalesce(max(greatest(discountPercentage, 0)), 0) AS maxDiscount, count(*) FILTER (discountPercentage >= 5) AS discounted FROM offers""")
def store_price_summary(spark, sf_dir):
    """the dashboard's totals."""
    return offers(spark, sf_dir).agg(F.countDistinct("sourceSite").alias("shops"), F.count("*").alias("offers"), F.coalesce(F.max(F.greatest("discountPercentage", F.lit(0))), F.lit(0)).alias("maxDiscount"), F.count_if(F.col("discountPercentage") >= 5).alias("discounted"))


@query(f"""WITH {OFFERS_SQL}, l AS (SELECT suppkey, avg(CASE WHEN discountPercentage IS NOT NULL AND line % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS d, count(*) AS n, median(discountPercentage) AS m FROM (SELECT *, row_number() OVER (PARTITION BY suppkey ORDER BY ord) AS k FROM offers) WHERE k <= 60 GROUP BY suppkey)
  SELECT suppkey, n AS productCount, {_SIX.format("CAST(m AS DOUBLE)")} AS medianDiscountPct FROM l""")
def listing_medians(spark, sf_dir):
    """the first sixty offers of a shop."""
    return O.listing_stats(offers(spark, sf_dir), ["suppkey"]).select("suppkey", "productCount", _six("medianDiscountPct").alias("medianDiscountPct"))


@query("""WITH t AS (SELECT p_brand, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9ঀ-৿ ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM part),
  k AS (SELECT p_brand, t, row_number() OVER (PARTITION BY p_brand ORDER BY t) AS n FROM t), d AS (SELECT p_brand, t, min(n) AS n FROM k WHERE n <= 20 GROUP BY ALL)
  SELECT p_brand, substr(sha1(string_agg(t, '' ORDER BY n)), 1, 16) AS fingerprint FROM d GROUP BY p_brand""")
def product_fingerprint(spark, sf_dir):
    """F6 by brand."""
    from offerlens.sources.tables import table

    return O.fingerprint(table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("title")), ["p_brand"])
