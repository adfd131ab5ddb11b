"""The rules in plain Python, for comparison on small inputs."""

from __future__ import annotations

import math
from collections import Counter, defaultdict


def corpus(bags: dict, min_count: int = 2):
    """bags: doc -> {phrase: tf}. Returns (dl, cf of survivors, n, avgdl)."""
    dl = {d: sum(b.values()) for d, b in bags.items() if b}
    cf = Counter()
    for b in bags.values():
        cf.update(b)
    cf = {p: c for p, c in cf.items() if c >= min_count}
    kept = {d: sum(tf for p, tf in b.items() if p in cf) for d, b in bags.items()}
    kept = [k for k in kept.values() if k]
    n = len(kept)
    return dl, cf, n, (round(sum(kept) / n) if n else None)  # round() is half to even


def scores(bags: dict, k=1.2, b=0.75, min_count: int = 2):
    dl, cf, n, avgdl = corpus(bags, min_count)
    out = {}
    for d, bag in bags.items():
        for p, tf in bag.items():
            if p in cf:
                arg = (n - cf[p] + 0.5) / (cf[p] + 0.5)
                out[d, p] = (
                    math.log(arg) * (tf * (k + 1)) / (tf + k * (1 - b + (b * dl[d] / avgdl))) if arg > 0 else None
                )
    return out


def model(bags: dict, threshold: float, min_count: int = 2):
    passed = defaultdict(list)
    for (_, p), s in scores(bags, min_count=min_count).items():
        if s is not None and s >= threshold:
            passed[p].append(s)
    return {p: sum(s) / len(s) for p, s in passed.items()}


def word_count(text: str) -> int:
    count = i = 0
    while i < len(text):
        while i < len(text) and not text[i].isspace():
            i += 1
        count += 1
        while i < len(text) and text[i].isspace():
            i += 1
    return count


def summary(text: str, vocab: list[tuple[str, float]], top: int = 3) -> list[str]:
    pieces = text.replace("!", ".").replace("?", ".").split(".")
    scored = []
    for i, s in enumerate(pieces):
        if len(s) > 20 and word_count(s) >= 3:
            total = 0.0
            for p, score in vocab[:10]:
                if p in s.lower():
                    total += score
            if total > 0:
                scored.append((-round(total, 6), i))
    best = sorted(i for _, i in sorted(scored)[:top])
    return [pieces[i] for i in best] or [pieces[0]] * min(top, len(pieces))
