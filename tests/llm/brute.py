"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from fractions import Fraction


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def jaccard_components(rows: list[tuple[int, str | None]], k: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of its set, component id)."""
    sets = [word_shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and 100 * small >= percent * large and find(i) != find(j):
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def contained(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int = 5, containment: str = "0.8") -> set[tuple[int, int, int, int]]:
    """(doc_id, item_id, shared, size of the item's set)."""

    def words(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", fold(t))

    def grams(t: str | None) -> set[tuple[str, ...]]:
        w = words(t)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = set()
    own = [(d, grams(t)) for d, t in docs]
    for i, t in items:
        want = grams(t)
        for d, have in own:
            if want and len(want & have) >= Fraction(containment) * len(want):
                out.add((d, i, len(want & have), len(want)))
    return out
