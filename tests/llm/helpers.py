"""Small tables and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

DOCS = "doc_id bigint, text string"


def docs(spark, rows, schema=DOCS, partitions=3):
    return spark.createDataFrame(rows, schema).repartition(partitions)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    """Repeatable text of invented words."""
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(words))


def by_id(rows, key="doc_id"):
    found = {}
    for row in rows:
        found.setdefault(row[key], []).append(row.asDict(recursive=True))
    return found


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", lower)


def shingle_set(text):
    found = words(text)
    if not found:
        return frozenset()
    if len(found) < 5:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}
