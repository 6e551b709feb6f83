"""Number to text, three ways."""

from __future__ import annotations

import math


def _digits(x: float) -> tuple[str, int]:
    """(shortest digits that read back as x, decimal exponent of the point before them)."""
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    part = part.rstrip("0") if part != "0" else ""
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits) if whole.strip("0") == "" else 0)
    if whole.strip("0") == "":
        point = int(exponent or 0) - (len(part) - len(digits))
    return digits.rstrip("0") or "0", point


def js_number(x: float) -> str:
    """ECMAScript's spelling: no point for whole numbers, exponents only from 1e21 up and below 1e-6."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, (digits, point) = "-" if x < 0 else "", _digits(abs(x))
    n = len(digits)
    if n <= point <= 21:
        text = digits + "0" * (point - n)
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        e = point - 1
        text = digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))
    return sign + text


def plain_number(x: float) -> str:
    """Decimal spelling without an exponent at any size (the validator's messages)."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    sign, (digits, point) = "-" if x < 0 else "", _digits(abs(x))
    n = len(digits)
    if point >= n:
        return sign + digits + "0" * (point - n)
    return sign + (digits[:point] + "." + digits[point:] if point > 0 else "0." + "0" * -point + digits)
