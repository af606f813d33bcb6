"""Plain-Python versions of the operators' results, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    found = SPACED.findall(ascii_lower(text or ""))
    if not found:
        return set()
    if len(found) < width:
        return {tuple(found)}
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def near_duplicate_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id reachable by links of similarity 0.75)."""
    sets = {id_: shingles(text) for id_, text in rows}
    where = defaultdict(list)
    for id_, own in sets.items():
        for shingle in own:
            where[shingle].append(id_)
    shared = Counter()
    for ids in where.values():
        ids.sort()
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                shared[a, b] += 1
    root = {id_: id_ for id_ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {id_: (len(own), find(id_)) for id_, own in sets.items()}


def fold(doc_id: int, of: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % of
