import hashlib
import random
import zlib

import numpy as np
import pytest

from bucketscore.llm import periodic
from tests.llm.helpers import by_id, docs


def plain_runs(words):
    """All runs by looking at every period in turn."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(left).hexdigest(),
    }


def sequence(draw):
    """Words with planted repetitions, also of repetitions, and small alphabets."""
    words = [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randrange(40))]
    for _ in range(draw.randrange(5)):
        unit = words[-draw.randrange(1, 30) :] or [0]
        words += (unit * 9)[: draw.randrange(1, 9 * len(unit))]
        words += [draw.randrange(4) for _ in range(draw.randrange(3))]
        words = words[-400:]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_every_period(seed):
    draw = random.Random(seed)
    for _ in range(150):
        words = sequence(draw)
        found = periodic.find_runs(np.array(words, dtype=np.int64))
        assert [(s, e - s, q) for s, e, q in found.tolist()] == plain_runs(words), words


def test_texts_of_one_slice_do_not_match_each_other(spark):
    rows = [(i, "la la la") for i in range(9)]
    assert {r.n_runs for r in periodic.digests(periodic.periodic_runs(docs(spark, rows, partitions=1))).collect()} == {0}


def test_wavelet_tree_against_sorting():
    draw = np.random.default_rng(1)
    values = draw.permutation(300)
    tree = periodic.WaveletTree(values, 300)
    for _ in range(50):
        low, high = sorted(draw.integers(0, 301, 2))
        x = int(draw.integers(0, 301))
        part = np.sort(values[low:high])
        arrays = np.array([low]), np.array([high])
        assert tree.below(*arrays, np.array([x]))[0] == (part < x).sum()
        for k in range(len(part)):
            assert tree.kth(*arrays, np.array([k]))[0] == part[k]


def test_query_against_plain(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(i, " ".join(f"w{w}" for w in sequence(draw))) for i in range(120)]
    rows += [(200, "Ha ha  ha\tha ha ha ha"), (201, "é é é é\x0bé é"), (202, "a b " * 3_000 + "c"), (203, "x\xa0x " * 8)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "a"), (303, "a"), (None, "a a a a a a"), (None, None)]
    rows += [(i, "one two three four five six seven") for i in range(400, 430)]
    monkeypatch.setattr(periodic, "SLICE_BYTES", 2_000)
    table = docs(spark, rows)
    found = periodic.digests(periodic.periodic_runs(periodic.repeat_tails(table))).collect()
    wanted = sorted((plain(*row) for row in rows), key=str)
    assert sorted((r.asDict() for r in found), key=str) == wanted


def test_spans_and_carried_columns(spark):
    text = "say it again " * 5 + "and stop"
    table = spark.createDataFrame([(1, text, "x", 4, None)], "doc_id bigint, text string, runs string, n_words int, collapsed string")
    row = periodic.periodic_runs(table.drop("collapsed"), ("doc_id",)).first()
    assert [tuple(r) for r in row.runs] == [(0, 15, 3)] and row.collapsed == "say it again and stop" and row.n_words == 17
    assert by_id([row])[1][0]["doc_id"] == 1
    assert periodic.periodic_runs(docs(spark, [])).count() == 0
