"""Price reading for single texts within a page; the Column functions have the same rules."""

from __future__ import annotations

import math
import re

from offerlens.functions import price as P

_digits = str.maketrans(P.BANGLA_DIGITS, "0123456789")
_percent, _amount = re.compile(P.PERCENT, re.ASCII), re.compile(P.AMOUNT, re.ASCII)
_anchored = re.compile(f"{P.PREFIXED}|{P.SUFFIXED}", re.IGNORECASE)
_marker = re.compile(P.MARKER)
_bare = re.compile(r"^[0-9,.\s]+$")
_currencies = [(code, re.compile(p)) for code, p in P.CURRENCIES]


def _positive(parts) -> list[float]:
    out = []
    for x in parts:
        try:
            n = float(x.replace(",", ""))
        except ValueError:
            continue
        if math.isfinite(n) and n > 0:
            out.append(n)
    return out


def amounts(text: str) -> list[float]:
    return _positive(_amount.findall(_percent.sub(" ", text.translate(_digits))))


def anchored(text: str) -> list[float]:
    return _positive(a or b for a, b in _anchored.findall(text.translate(_digits)))


def price_amounts(text: str) -> list[float]:
    return anchored(text) if _marker.search(text) else amounts(text) if _bare.match(text) else []


def price(x) -> float | None:
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, (int, float)):
        return float(x) if math.isfinite(x) and x > 0 else None
    return min(amounts(x), default=None) if isinstance(x, str) else None


def currency(x) -> str:
    return next((code for code, p in _currencies if p.search(x)), P.DEFAULT_CURRENCY) if isinstance(x, str) else P.DEFAULT_CURRENCY


def discount(original: float | None, deal: float) -> int | None:
    return math.floor((original - deal) / original * 100 + 0.5) if original and original > deal else None
