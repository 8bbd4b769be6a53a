import hashlib
import random
import zlib

import numpy as np
import pytest

from bucketscore.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NOTHING = hashlib.sha256(b"").hexdigest()


def plain_nodes(conversations):
    """Every node by listing every prefix of every conversation ``{id: [(role, text), ...]}``."""
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    rows = []
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        rows.append(
            {
                "conv_id": min(own),
                "depth": len(node),
                "parent_conv_id": min(members[node[:-1]]) if node else None,
                "n_convs": len(own),
                "n_children": len(kids),
                "n_leaves": sum(1 for m in below if not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in below)),
                "saved_tokens": sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
                "ends_sha256": hashlib.sha256(ids.encode()).hexdigest(),
            }
        )
    return rows


def plain_turns(rows):
    found = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        found.setdefault(c, []).append((role or "", text or ""))
    return found


def plain_rebuilt(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        # c - c % 5 with a remainder that has the sign of c.
        giver = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = found.get(giver, [])[:h] + own[h:]
    return out


@pytest.fixture
def together(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(found, wanted):
    rows = [{k: v for k, v in r.asDict().items() if k not in ("t1", "t2")} for r in found.collect()]
    assert sorted(rows, key=str) == sorted(wanted, key=str)


def some(seed, n=60):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-40, 200), n):
        numbers = draw.sample(range(100), draw.randrange(0, 13))
        for turn in numbers:
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["a", "é", "", None, "long text"])))
    # Copies of one conversation, a common first turn, a long conversation, and one without number.
    for c in range(300, 340):
        rows += [(c, t, "user", f"t{t}") for t in range(draw.choice([1, 5, 5, 9]))]
    rows += [(400, t, "user", f"t{t}") for t in range(40)] + [(401, None, "user", "first"), (401, 0, "user", "second")]
    rows += [(None, 0, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("seed,levels,shard", [(0, 512, 1 << 17), (2, 15, 10)])
def test_against_all_prefixes(spark, monkeypatch, seed, levels, shard):
    monkeypatch.setattr(trie, "LEVELS", levels)
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    rows = some(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(trie.conversation_trie(table), plain_nodes(plain_turns(rows)))


@pytest.mark.parametrize("seed", [5])
def test_rebuilt_conversations(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "LEVELS", 14)
    monkeypatch.setattr(trie, "SHARD_TURNS", 50)
    rows = some(seed, 90)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same(trie.conversation_trie(table, trie.share_beginnings), plain_nodes(plain_rebuilt(plain_turns(rows))))


def test_positions_across_ranges(spark, together):
    rows = [(7, i, "user", str(i)) for i in random.Random(1).sample(range(500), 500)] + [(8, 0, "user", "x")]
    held = []
    found = trie.turn_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), held).collect()
    assert held[0].df.select("part").distinct().count() > 1
    assert sorted(r.position for r in found if r.conv_id == 7) == list(range(500))
    first = spark.sql("select xxhash64('user', '0') as h").first().h
    assert [r.position for r in found if r.t1 == first] == [0]


def test_empty_ties_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(empty).count() == 0
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "b"), (3, 0, "bot", "c")]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", position int, t1 string")
    found = {(r.conv_id, r.depth): r for r in trie.conversation_trie(table).collect()}
    assert found[(1, 0)].n_convs == 3 and found[(1, 2)].n_convs == 1 and found[(1, 1)].n_convs == 2
    assert found[(1, 1)].ends_sha256 == hashlib.sha256(b"2").hexdigest() and found[(1, 0)].ends_sha256 == NOTHING
    again = {(r.conv_id, r.depth) for r in trie.conversation_trie(table.repartition(7)).collect()}
    assert again == set(found)


def test_many_ends_in_pieces(spark, monkeypatch, together):
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(c, 0, "user", "same") for c in range(1_000)]
    node = [r for r in trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect() if r.depth][0]
    assert node.ends_sha256 == hashlib.sha256(",".join(map(str, range(1_000))).encode()).hexdigest()
    assert node.n_convs == 1_000 and node.saved_tokens == 999 * 4


def test_double_array_of_random_tries():
    draw = random.Random(2)
    for _ in range(20):
        words = {tuple(draw.choice([1, 2, 5, 300, 301, 9_000]) for _ in range(draw.randrange(1, 6))) for _ in range(200)}
        array, states = trie.DoubleArray(), {(): 0}
        for level in range(1, 6):
            edges = sorted({w[:level] for w in words if len(w) >= level})
            array.add(np.array([states[e[:-1]] for e in edges]), np.array([e[-1] for e in edges]))
            for e in edges:
                states[e] = int(array.step(np.array([states[e[:-1]]]), np.array([e[-1]]))[0])
        assert len(set(states.values())) == len(states) and min(states.values()) == 0
        for prefix, state in states.items():
            for code in (1, 2, 5, 300, 301, 9_000, 7):
                assert array.step(np.array([state]), np.array([code]))[0] == states.get((*prefix, code), -1)
