"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import unicodedata


def fold(s: str) -> str:
    out = []
    for c in s:
        o = ord(c)
        out.append(chr(o - 0xFEE0) if 0xFF01 <= o <= 0xFF5E else " " if o == 0x3000 else c)
    return "".join(out).lower()


def letters_digits(s: str | None) -> str:
    return "".join(c for c in fold(s or "") if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def letters(s: str | None) -> str:
    return "".join(c for c in fold(s or "") if unicodedata.category(c)[0] == "L")


def stretches(s: str, k: int) -> set[str]:
    return {s[i : i + k] for i in range(len(s) - k + 1)} if len(s) >= k else ({s} if s else set())


def near_pairs(bodies: dict[int, str], least: float, k: int = 5) -> set[tuple[int, int]]:
    sets = {i: stretches(b, k) for i, b in bodies.items() if b}
    out = set()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n / (len(sets[a]) + len(sets[b]) - n) >= least:
                out.add((a, b))
    return out
