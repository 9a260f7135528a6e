"""Canonical JSON after RFC 8785, and digests of it.

Keys are ordered by their UTF-16 code units, numbers written as ECMAScript writes them; NaN and infinities are refused.
"""

from __future__ import annotations

import hashlib
import json
import math


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("canonical JSON has no NaN and no infinities")
    if x == 0:
        return "0"
    text = repr(abs(x))
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    # the value is 0.digits times ten to the point
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        e = point - 1
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))
    return "-" + out if x < 0 else out


def canonical_json(value) -> str:
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("canonical JSON has string keys only")
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(canonical_json(k) + ":" + canonical_json(value[k]) for k in keys) + "}"
    raise TypeError(f"no canonical JSON for {type(value).__name__}")


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()
