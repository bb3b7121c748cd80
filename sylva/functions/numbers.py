"""Values of JavaScript number literals."""

from __future__ import annotations

import re


def parse_number(literal: str) -> tuple[str, float | int] | None:
    """('float', value) or ('bigint', value); None if it is no number literal. Understands radix prefixes, separators, legacy octals and the n suffix."""
    text = literal.replace("_", "")
    if re.search(r"__|^_|_$|_\.|\._", literal):
        return None
    big = text.endswith("n")
    body = text[:-1] if big else text
    for prefix, radix, digits in (("0x", 16, "0-9a-fA-F"), ("0o", 8, "0-7"), ("0b", 2, "01")):
        if body.lower().startswith(prefix):
            if not re.fullmatch(f"[{digits}]+", body[2:]):
                return None
            value = int(body[2:], radix)
            return ("bigint", value) if big else ("float", float(value))
    if big:
        return ("bigint", int(body)) if re.fullmatch(r"0|[1-9][0-9]*", body) else None
    if re.fullmatch(r"0[0-7]+", body):
        return "float", float(int(body, 8))
    if not re.fullmatch(r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", body):
        return None
    return "float", float(body)
