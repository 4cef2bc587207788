"""Price, number and currency functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, currency marks and price patterns.
BANGLA_DIGITS = "০১২৩৪৫৬৭৮৯"
CURRENCIES = [("BDT", r"৳|(?i:Tk\.?|BDT|টাকা)"), ("USD", r"\$|(?i:USD)"), ("EUR", r"€|(?i:EUR)"), ("GBP", r"£|(?i:GBP)"), ("INR", r"₹|(?i:INR)")]
DEFAULT_CURRENCY = "BDT"
PERCENT = r"\d+(?:\.\d+)?\s*%"
AMOUNT = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
PREFIXED = r"(?:৳|Tk\.?|BDT|Rs\.?|INR|RM|Rp|AED|SAR|USD|EUR|GBP|kr|\$|€|£|₹|₨)\s*([\d,]{2,}(?:\.\d+)?)"
SUFFIXED = r"([\d,]{2,}(?:\.\d+)?)\s*(?:৳|Tk\.?|BDT|Rs\.?|INR|RM|AED|SAR|USD|EUR|GBP|kr)"
MARKER = r"(?i)[৳$€£₹₨]|(?<![A-Za-z0-9_])(?:Tk|BDT|Rs|INR|RM|Rp|AED|SAR|USD|EUR|GBP|kr)(?![A-Za-z0-9_])"
BARE = r"^[\d,.\s]+$"
PRICE_TEXT = r"(?i)(?:৳|Tk\.?|BDT|Rs\.?|INR|RM|AED|\$|€|£|₹|₨)\s*[\d,]{2,}"
PRICE_HINT = r"(?i)(?:৳|&#2547;|&#x09f3;|Tk\.?|BDT|\$|€|£|₹)\s*[\d,]{2,}|[\d,]{2,}\s*(?:৳|Tk\.?|BDT)"
STRUCT_PRICE = r"(?i)(?:৳|Tk\.?|BDT|Rs\.?|INR|RM|Rp|AED|SAR|USD|EUR|GBP|\$|€|£|₹|₨)\s*[\d,]{2,}"
MONEY_TEXT = r"(?i)[৳$€£₹₨₦﷼]\s*[\d,]{2,}|(?:Tk|BDT|Rs|INR|RM|Rp|AED|SAR|USD|EUR|GBP|kr)\.?\s*[\d,]{2,}"
FLAG_LABELS = {
    "mostly-fallback-links": "many missing product links",
    "all-prices-identical": "prices look templated",
    "extreme-variance": "suspicious price spread",
    "low-coverage": "page claims more products than captured",
    "empty": "nothing extracted",
}
BADGE = r"(?i)(\d{1,2})\s*%\s*(off|discount|ছাড়)?"
CLAIMS = [
    r"(?i)(?:of|out of|from)\s+(\d[\d,]*)\s+(?:products?|items?|results?)",
    r"(?i)(\d[\d,]*)\s*(?:products?|items?|results?)\s*(?:found|available)?",
    r"(?i)(\d[\d,]*)\s*টি?\s*(?:পণ্য|আইটেম)",
]
SYMBOLS = {"BDT": "৳", "USD": "$", "EUR": "€", "GBP": "£", "INR": "₹"}
LEAST_DEAL = 10.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + F.lit(0.5).cast("double"))


def to_fixed(x: Column, digits: int = 3) -> Column:
    """Text with so many decimals, rounded by the number's exact binary value, halves to even (a formatter rounds its decimal form)."""
    unit = float(10**digits)
    m = F.floor(x * unit + 0.5)
    # sign of x - (m - 1/2) / unit, exactly: x in two halves whose products do not round
    c = x * 134217729.0
    hi = c - (c - x)
    past = (hi * (2 * unit) - (2 * m - 1)) + (x - hi) * (2 * unit)
    down = (past < 0) | (past == 0) & (m % 2 != 0)
    return F.format_string(f"%.{digits}f", F.when(down, m - 1).otherwise(m) / unit)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normalize_digits(s: Column | str) -> Column:
    """B1: Bangla digits to ASCII."""
    return F.translate(_c(s), BANGLA_DIGITS, "0123456789")


def _numbers(matches: Column) -> Column:
    return F.filter(F.transform(matches, lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double")), lambda n: n > 0)


def extract_amounts(s: Column | str) -> Column:
    """B2: every amount above zero of a text; percentages do not count."""
    text = F.regexp_replace(normalize_digits(s), PERCENT, " ")
    return _numbers(F.regexp_extract_all(text, F.lit(f"({AMOUNT})"), F.lit(1)))


def parse_price(s: Column | str) -> Column:
    """The least amount of a text, null without one."""
    return F.array_min(extract_amounts(s))


def detect_currency(s: Column | str) -> Column:
    """The first currency, in listed order, whose mark stands in the text; else the default."""
    out, text = F.lit(DEFAULT_CURRENCY), F.coalesce(_c(s), F.lit(""))
    for code, pattern in reversed(CURRENCIES):
        out = F.when(text.rlike(pattern), code).otherwise(out)
    return out


def compute_discount(original: Column | str, deal: Column | str) -> Column:
    """Whole per cent off, null unless the original price is greater."""
    o, d = _c(original), _c(deal)
    return F.when((o != 0) & (o > d), js_round((o - d) / o * 100)).cast("long")


def make_id(*parts: Column, n: int = 12) -> Column:
    """The first hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, n)


def anchored_amounts(s: Column | str) -> Column:
    """Amounts next to a currency mark, before or after."""
    text, both = normalize_digits(s), F.lit(f"(?i){PREFIXED}|{SUFFIXED}")
    one, two = F.regexp_extract_all(text, both, F.lit(1)), F.regexp_extract_all(text, both, F.lit(2))
    return _numbers(F.zip_with(one, two, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)))


def amounts_from_price_text(s: Column | str) -> Column:
    """Anchored amounts if a mark stands in the text, plain ones if the text is all numeric, else none."""
    t = _c(s)
    return F.when(t.rlike(MARKER), anchored_amounts(t)).when(t.rlike(BARE), extract_amounts(t)).otherwise(F.array().cast("array<double>"))


def is_price_leaf(s: Column | str) -> Column:
    """A short text that looks like a price."""
    return F.length(_c(s)).between(3, 60) & _c(s).rlike(STRUCT_PRICE)


def effective_discount(pct: Column | str, original: Column | str, deal: Column | str) -> Column:
    """The stated per cent, else the unrounded one of the prices, else 0."""
    o, d = _c(original), _c(deal)
    return F.coalesce(_c(pct).cast("double"), F.when((d > 0) & (o > d), (F.lit(1.0) - d / o) * 100), F.lit(0.0))


def json_discount(stated: Column | str, original: Column | str, deal: Column | str) -> Column:
    """The stated per cent if within (0, 95], rounded; else that of the prices."""
    s = _c(stated)
    return F.when((s > 0) & (s <= 95), js_round(s).cast("long")).otherwise(compute_discount(original, deal))


def badge_discount(s: Column | str) -> Column:
    """The first per cent of a badge's text."""
    return F.nullif(F.regexp_extract(_c(s), BADGE, 1), F.lit("")).cast("long")


def admitted(title: Column | str, deal: Column | str) -> Column:
    """An offer needs a title of four characters and a deal price of ten."""
    return (F.length(_c(title)) >= 4) & (_c(deal) >= LEAST_DEAL)


def claimed_total(html: Column | str) -> Column:
    """How many products a page says it lists."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(html), r"(?i)<script[\s\S]*?</script>", " "), r"(?i)<style[\s\S]*?</style>", " "), r"<[^>]+>", " ")
    found = [F.replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("long") for p in CLAIMS]
    return F.coalesce(*(F.when(n > 0, n) for n in found))


def ewma(before: Column, x: Column, alpha: float = 0.3) -> Column:
    """B17."""
    return F.lit(alpha) * x + F.lit(1 - alpha) * before


def format_price(n: Column | str, currency: Column | str) -> Column:
    """Symbol or code, thousands, at most two decimals."""
    mark = F.concat(_c(currency), F.lit(" "))
    for code, symbol in SYMBOLS.items():
        mark = F.when(_c(currency) == code, symbol).otherwise(mark)
    return F.concat(mark, F.regexp_replace(F.regexp_replace(F.format_number(_c(n), 2), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def store_colour(site: Column | str) -> Column:
    """0..7 by a rolling hash of the name's characters."""
    chars = F.filter(F.split(_c(site), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)), lambda h: h % 8)


def confidence(score: Column | str) -> Column:
    """Level of an extraction score."""
    return F.when(_c(score) >= 0.7, "high").when(_c(score) >= 0.35, "medium").otherwise("low")


def confidence_text(score: Column | str, count: Column | str, flags: Column | str) -> Column:
    """The level in words, with what speaks for or against it."""
    labels = F.create_map(*(F.lit(x) for kv in FLAG_LABELS.items() for x in kv))
    why = F.concat(F.when(_c(count).isNotNull(), F.array(F.concat(_c(count).cast("string"), F.lit(" products")))).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce(_c(flags), F.array().cast("array<string>")), lambda f: F.coalesce(F.try_element_at(labels, f), f)))
    text = F.array_join(why, ", ")
    return F.concat(F.when(text == "", "").otherwise(F.concat(text, F.lit(" — "))), confidence(score), F.lit(" confidence ("), js_round(_c(score) * 100).cast("string"), F.lit("%)"))


def relative_time(ms: Column, now: Column) -> Column:
    """When, in words, before or after now."""
    diff = ms - now
    size = F.abs(diff)

    def words(unit_ms: int, unit: str) -> Column:
        n = js_round(diff / float(unit_ms)).cast("long")
        unit_text = F.concat(F.abs(n).cast("string"), F.lit(f" {unit}"), F.when(F.abs(n) == 1, "").otherwise("s"))
        return F.when(n > 0, F.concat(F.lit("in "), unit_text)).otherwise(F.concat(unit_text, F.lit(" ago")))

    days = js_round(diff / 86_400_000.0)
    day = F.when(days == -1, "yesterday").when(days == 1, "tomorrow").otherwise(words(86_400_000, "day"))
    return F.when(ms.isNull(), "—").when(size < 60_000, "just now").when(size < 3_600_000, words(60_000, "minute")).when(size < 86_400_000, words(3_600_000, "hour")).otherwise(day)


def waking(ms: Column) -> Column:
    """The month in which a parked page wakes."""
    return F.concat(F.lit("waking "), F.date_format(F.timestamp_millis(ms), "MMM yyyy"))
