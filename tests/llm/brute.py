"""Plain Python for what the operators return."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    n = lambda m: len(re.sub("[^0-9]", "", m))
    fits = {
        "email": lambda m: True,
        "ip": lambda m: all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 9 <= n(m) <= 15,
    }
    out = []
    for order, (kind, expression) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        out += [(m.start(), order, kind, m.end()) for m in expression.finditer(text) if fits[kind](m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def base_sha256(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def edited(rows):
    """(doc_id, text) to doc_id -> (text, edited text, next text)."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 2
        out[doc] = (text, text[: len(text) - cut] + following[:cut], following)
    return out


def paragraphs(text):
    return Counter(p for p in re.split(r"(?<=\n)|(?<=[.!?] )", text) if p)


def likeness(one, other):
    a, b = paragraphs(one), paragraphs(other)
    union = sum((a | b).values())
    return 1.0 if one == other else sum((a & b).values()) / max(union, 1)


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
