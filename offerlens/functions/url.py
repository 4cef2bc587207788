"""URL functions for absolute http(s) URLs, Column to Column; relative references by one pandas UDF."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Parameters, suffixes, shops.
MEANINGFUL = "page p pageNo pageNumber sort order q query search filter on_sale category cat collection tag type brand discount min_price max_price".lower().split()
TWO_PART_SUFFIXES = (
    "com.bd net.bd org.bd co.uk org.uk ac.uk gov.uk com.au net.au org.au co.in com.pk com.sg com.my com.tr com.br com.mx com.ar co.jp co.kr co.nz co.za co.id com.ph com.vn com.np com.lk"
).split()
KNOWN_SITES = {
    "chaldal.com": "Chaldal",
    "pickaboo.com": "Pickaboo",
    "daraz.com.bd": "Daraz",
    "daraz.com": "Daraz",
    "rokomari.com": "Rokomari",
    "othoba.com": "Othoba",
    "priyoshop.com": "PriyoShop",
    "ajkerdeal.com": "AjkerDeal",
    "shajgoj.com": "Shajgoj",
    "evaly.com.bd": "Evaly",
}
MOST_DEPTH, MOST_LENGTH = 6, 512
_PARTS = r"(?i)^\s*(https?)://([^/?#:]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\s*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _part(u: Column | str, n: int) -> Column:
    return F.regexp_extract(_c(u), _PARTS, n)


def host(u: Column | str) -> Column:
    """Lower-cased host; empty for anything but an absolute http(s) URL."""
    return F.lower(_part(u, 2))


def path(u: Column | str) -> Column:
    return F.when(_part(u, 4) == "", "/").otherwise(_part(u, 4))


def query(u: Column | str) -> Column:
    return _part(u, 5)


def canonicalize(u: Column | str) -> Column:
    """The key of a page: meaningful parameters only, sorted; null if too deep or long or not http(s)."""
    scheme, port = F.lower(_part(u, 1)), _part(u, 3)
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    p = F.regexp_replace(path(u), "/{2,}", "/")
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    pairs = F.transform(F.filter(F.split(query(u), "&"), lambda x: x != ""), lambda x, i: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("k"), i.alias("i"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda x: x["k"].isin(MEANINGFUL)))
    q = F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    out = F.concat(scheme, F.lit("://"), host(u), port, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    depth = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    return F.when((host(u) != "") & (depth <= MOST_DEPTH) & (F.length(out) <= MOST_LENGTH), out)


def registrable_domain(h: Column | str) -> Column:
    """The site a host belongs to; null for addresses, single labels and bare suffixes."""
    x = F.regexp_replace(F.lower(F.trim(_c(h))), r"\.$", "")
    labels = F.split(x, r"\.")
    n = F.size(labels)
    last = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    out = F.when(last.isin(TWO_PART_SUFFIXES), F.when(n >= 3, three)).otherwise(last)
    return F.when((x != "") & ~x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.contains(x, F.lit(":")) & (n >= 2), out)


def same_site(a: Column | str, b: Column | str) -> Column:
    """C14: URLs of one registrable domain."""
    return F.coalesce(registrable_domain(host(a)) == registrable_domain(host(b)), F.lit(False))


def site_name(u: Column | str) -> Column:
    """A known shop's name, else the host's first label, capitalised."""
    h = F.regexp_replace(host(u), r"^www\.", "")
    first = F.substring_index(h, ".", 1)
    out = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, F.lit(2), F.length(first)))
    for domain, name in reversed(KNOWN_SITES.items()):
        out = F.when((h == domain) | h.endswith(f".{domain}"), name).otherwise(out)
    return F.when(h == "", "Unknown").otherwise(out)


def host_of(u: Column | str) -> Column:
    """Host without www., or the text itself if it is no URL."""
    return F.when(host(u) == "", _c(u)).otherwise(F.regexp_replace(host(u), r"^www\.", ""))


def is_root(u: Column | str) -> Column:
    """C17: a site's front page, without query and fragment."""
    return (host(u) != "") & _part(u, 4).isin("", "/") & (query(u) == "") & ~F.contains(_c(u), F.lit("#"))


def normalize_url(s: Column | str) -> Column:
    """C11: trimmed, https:// if without a scheme, null if the host has no dot."""
    t = F.trim(_c(s))
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    out = F.concat(F.lower(_part(full, 1)), F.lit("://"), host(full), F.when(_part(full, 3) == "", "").otherwise(F.concat(F.lit(":"), _part(full, 3))), path(full), F.when(query(full) == "", "").otherwise(F.concat(F.lit("?"), query(full))), F.regexp_extract(full, "(#.*)$", 1))
    return F.when((t != "") & F.contains(host(full), F.lit(".")) & ~F.contains(host(full), F.lit(" ")), out)


def public_address(u: Column | str) -> Column:
    """http(s), and a literal IPv4 host only if it is a public unicast address. Names are not resolved."""
    h = host(u)
    o = [F.regexp_extract(h, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).try_cast("int") for i in range(1, 5)]
    a, b, c = o[:3]
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return (h != "") & (h != "localhost") & ~F.coalesce(private, F.lit(False))


@F.pandas_udf(StringType())
def absolute(href: pd.Series, base: pd.Series) -> pd.Series:
    """A reference resolved against its page; null unless http(s)."""

    def one(h, b):
        try:
            out = urljoin(b, (h or "").strip())
        except (ValueError, TypeError):
            return None
        return out if re.match(r"(?i)https?://", out) else None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)])


def matches_pattern(pattern: str, u: Column | str) -> Column:
    """A user's page pattern: absolute, from the root or bare; `*` is any text."""
    p = pattern.strip()
    if not p or len(p) > 200:
        return F.lit(False)
    absolute_one = re.match(r"(?i)https?://", p)
    if not absolute_one and not p.startswith("/"):
        p = f"/{p}"
    subject = _c(u) if absolute_one else F.concat(path(u), F.when(query(u) == "", "").otherwise(F.concat(F.lit("?"), query(u)))) if "?" in p else path(u)
    ok = F.lit(True) if absolute_one else host(u) != ""
    bare = lambda s: F.when(F.length(s) > 1, F.regexp_replace(s, "/+$", "")).otherwise(s)
    if "*" not in p:
        return ok & (F.lower(bare(F.lit(p))) == F.lower(bare(subject)))
    return ok & subject.rlike("(?i)^" + ".*".join(re.escape(x) for x in p.split("*")) + "$")


def first_pattern(patterns: list[str], u: Column | str) -> Column:
    """The first of the patterns that matches."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(matches_pattern(p, u), p).otherwise(out)
    return out


def short_path(u: Column | str) -> Column:
    """Path and query as shown to a person."""
    return F.when((path(u) == "/") & (query(u) == ""), "(homepage)").otherwise(F.concat(path(u), F.when(query(u) == "", "").otherwise(F.concat(F.lit("?"), query(u)))))
