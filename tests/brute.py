"""Plain-Python versions of the estimators, for small fixtures."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

from bucketscore.operators.lsh import HashFamily


def bucket_ids(points: dict[int, list[float]], family: HashFamily, w: float | None = None) -> dict[int, list[tuple]]:
    """Per point, its bucket in every table."""
    w = family.widths[0] if w is None else w
    out = {}
    for key, x in points.items():
        codes = np.floor(np.dot(family.planes, np.array(x) / family.radius) / w + family.offsets).astype(int)
        out[key] = [(t, *row) for t, row in enumerate(codes.reshape(family.num_tables, -1).tolist())]
    return out


def sizes(buckets: dict[int, list[tuple]]) -> Counter:
    return Counter(b for own in buckets.values() for b in own)


def reach(buckets: dict[int, list[tuple]]) -> dict[int, int]:
    count = sizes(buckets)
    return {key: sum(count[b] for b in own) for key, own in buckets.items()}


def estimators(buckets: dict[int, list[tuple]]) -> dict[tuple, tuple[float, float, float, float]]:
    r = reach(buckets)
    members = defaultdict(list)
    for key, own in buckets.items():
        for b in own:
            members[b].append(r[key])
    return {
        b: (float(len(m)), sum(m) / len(m), len(m) ** 2 / sum(m), sum(1.0 / v for v in m)) for b, m in members.items()
    }


def scores(test: dict[int, list[tuple]], table: dict[tuple, tuple]) -> dict[int, list[float]]:
    zero = (0.0, 0.0, 0.0, 0.0)
    return {key: [-sum(table.get(b, zero)[e] for b in own) for e in range(4)] for key, own in test.items()}


def left_out_scores(buckets: dict[int, list[tuple]]) -> dict[int, list[float]]:
    """Scores of training points, each without its own part in its buckets."""
    r = reach(buckets)
    members = defaultdict(list)
    for key, own in buckets.items():
        for b in own:
            members[b].append(key)
    out = {}
    for key, own in buckets.items():
        totals = [0.0] * 4
        for b in own:
            others = [r[m] for m in members[b] if m != key]
            if others:
                values = (len(others), sum(others) / len(others), len(others) ** 2 / sum(others), sum(1 / x for x in others))
                totals = [t + v for t, v in zip(totals, values)]
        out[key] = [-t for t in totals]
    return out


def auroc(values: list[float], labels: list[int], tie: float = 1e-9) -> float | None:
    """By pair counting; values whose relative difference is at most ``tie`` count as equal."""
    pos = [v for v, y in zip(values, labels) if y == 1]
    neg = [v for v, y in zip(values, labels) if y != 1]
    if not pos or not neg:
        return None
    wins = sum(1.0 if p > n else 0.5 if p == n or abs(p - n) < tie * max(1.0, abs(p)) else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))
