import random

import numpy as np
import pyarrow as pa
import pytest

from bucketscore import staging
from bucketscore.llm import components as cc
from bucketscore.llm import neardup
from bucketscore.llm.rows import raw, slices
from bucketscore.llm.shingles import Words, shingles
from tests.llm.helpers import components, docs, prose, shingle_set, words


def edited(text, share, seed):
    draw = random.Random(seed)
    return " ".join(f"e{draw.random()}" if draw.random() < share else w for w in text.split(" "))


def wanted(rows):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingle_set(text))
    edges = []
    ids = sorted(i for i in sets if i is not None)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= 75 * len(s | t):
                        edges.append((a, b))
    return components(edges, ids)


def compare(spark, rows):
    found = neardup.components(docs(spark, rows)).collect()
    roots = wanted(rows)
    texts = sorted((str(i), len(shingle_set(t)), str(roots.get(i))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == texts
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def corpus():
    rows = [(i, prose(i, 60, 100_000)) for i in range(60)]
    base = prose(77, 120, 100_000)
    rows += [(100 + i, edited(base, 0.02, i)) for i in range(12)]
    # A chain: neighbours are similar, ends are not.
    chain = prose(78, 100, 100_000).split(" ")
    for i in range(6):
        rows.append((200 + i, " ".join(chain)))
        for j in range(8):
            chain[(11 * i + j) % 100] = f"c{i}-{j}"
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(400, rows[3][1].upper()), (401, rows[3][1].replace(" ", " \n\t"))]
    rows += [(500, None), (501, ""), (502, "  \n "), (503, "one two"), (504, "One  TWO"), (505, "one two three")]
    rows += [(600, prose(5, 4_000, 100_000)), (601, prose(5, 4_000, 100_000) + " more")]
    return rows


def test_against_all_pairs(spark):
    compare(spark, corpus())


def test_long_lists_meet_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 3)
    base = prose(5, 80, 100_000)
    rows = [(i, edited(base, 0.05, i)) for i in range(40)]
    compare(spark, rows)


def test_a_pass_without_new_links_ends_there(spark, monkeypatch):
    calls, real = [], neardup.connected_components
    monkeypatch.setattr(neardup, "connected_components", lambda edges: calls.append(edges.count()) or real(edges))
    rows = [(i, prose(i, 80, 100_000)) for i in range(6)]
    rows += [(20, f"{rows[2][1]} more"), (21, rows[3][1]), (22, f"{rows[4][1]} less")]
    compare(spark, rows)
    assert calls == [2]


def test_edge_cases(spark):
    assert neardup.components(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f")]
    compare(spark, rows)
    more = docs(spark, [(1, "a b", 5, "x"), (2, "a b", None, None)], "doc_id bigint, text string, rep int, signature string")
    assert sorted(r.component_id for r in neardup.components(more).collect()) == [1, 1]


def test_words_and_shingles_are_those_of_the_text():
    texts = ["", None, "A b", "one two three four five six", "x\x0by\x0c\x00z \r\n", "é É ñ a b c", prose(1, 300), " lead and trail "]
    seen = {}
    for _, part in slices(pa.array(texts, pa.string())):
        data, bounds = raw(part)
        found = Words(data, bounds)
        assert found.counts.tolist() == [len(words(t)) for t in texts]
        for text, hashes in zip(texts, shingles(found)):
            assert len(hashes) == len(shingle_set(text)) and (np.diff(hashes) > 0).all()
        for text, start, stop in zip(texts, found.bounds[:-1], found.bounds[1:]):
            for word, value in zip(words(text), found.hashes[start:stop]):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_segments_do_not_matter(monkeypatch):
    from bucketscore.llm import shingles as module

    data, bounds = raw(pa.array([prose(i, 50) for i in range(30)] + ["y" * 300, "", "a b"], pa.large_string()))
    whole = Words(data, bounds)
    monkeypatch.setattr(module, "_SEGMENT", 64)
    parts = Words(data, bounds)
    assert (whole.hashes == parts.hashes).all() and (whole.bounds == parts.bounds).all()


def test_signature_agrees_as_often_as_sets_overlap():
    draw = np.random.default_rng(3)
    common = draw.integers(0, 1 << 63, 900).astype(np.uint64)
    other = [draw.integers(0, 1 << 63, 150).astype(np.uint64) for _ in range(2)]
    one, two = (neardup.signature(np.concatenate([common, o])) for o in other)
    assert abs((one == two).mean() - 0.75) < 0.2


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    nodes = draw.sample(range(1_000), 60)
    edges = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(45)] + [(nodes[0], n) for n in nodes[:15]]
    edges += [(None, 3), (4, None), (5, 5)]
    found = {r.node: r.component for r in cc.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert found == components(real, {n for e in real for n in e})


def test_components_of_a_chain_and_of_nothing(spark):
    chain = [(i, i + 1) for i in range(100)]
    found = cc.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert len(found) == 101 and {r.component for r in found} == {0}
    assert cc.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture
def many_partitions(spark):
    """A session whose shuffles always have 40 partitions."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_rounds_on_a_small_graph_are_of_few_tasks(spark, many_partitions, monkeypatch):
    tasks, real = [], cc.stage

    def counted(df, name, **facts):
        group = f"round {id(tasks)} {len(tasks)}"
        spark.sparkContext.setJobGroup(group, name)
        table = real(df, name, **facts)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
        tasks.append(sum(info.numTasks for info in map(tracker.getStageInfo, stages) if info))
        return table

    monkeypatch.setattr(cc, "stage", counted)
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    found = cc.connected_components(chain).collect()
    assert len(found) == 101 and {r.component for r in found} == {0}
    # The first table has the partitions of edges whose number is not known yet.
    assert len(tasks) > 3 and max(tasks[2:]) < 20


def test_larger_graphs_have_more_tasks(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_A_TASK", 10)
    assert staging.gathered(spark.range(0, 100, 1, 40), 25).rdd.getNumPartitions() == 3
    draw = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(500, n) for n in range(501, 560)]
    edges += [(draw.randrange(1_000, 1_080), draw.randrange(1_000, 1_080)) for _ in range(60)] + edges[:30] + [(None, 3), (7, 7)]
    found = {r.node: r.component for r in cc.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == components(real, {n for e in real for n in e})


def test_a_component_that_grows_in_a_second_pass(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_A_TASK", 4)
    monkeypatch.setattr(neardup, "SHORT_LIST", 3)
    base = prose(15, 80, 100_000)
    compare(spark, [(i, edited(base, 0.05, 100 + i)) for i in range(25)] + [(40, None), (41, base), (42, base)])
