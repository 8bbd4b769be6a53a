import random

import numpy as np
import pyarrow as pa
import pytest

from bucketscore.llm import jaccard
from tests.llm.helpers import components, docs, prose, shingle_set


def edited(text, share, seed):
    draw = random.Random(seed)
    return " ".join(f"e{draw.random()}" if draw.random() < share else w for w in text.split(" "))


def compare(spark, rows, schema="doc_id bigint, text string"):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingle_set(text))
    ids = sorted(i for i in sets if i is not None)
    edges = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                edges.append((a, b))
    roots = components(edges, ids)
    found = jaccard.components(docs(spark, rows, schema)).collect()
    wanted = sorted((str(i), len(shingle_set(t)), str(roots.get(i))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == wanted
    return roots


def corpus():
    rows = [(i, prose(i, 40 + i, 100_000)) for i in range(50)]
    for k, (words, share) in enumerate([(120, 0.01), (120, 0.02), (60, 0.03), (300, 0.02)]):
        base = prose(900 + k, words, 100_000)
        rows += [(100 + 50 * k + i, edited(base, share, 77 * k + i)) for i in range(16)]
    # A chain: neighbours are similar, ends are not.
    chain = prose(78, 100, 100_000).split(" ")
    for i in range(6):
        rows.append((400 + i, " ".join(chain)))
        for j in range(5):
            chain[(11 * i + j) % 100] = f"c{i}-{j}"
    # Parts of a text, whose sizes differ up to the bound and beyond.
    whole = prose(55, 204, 100_000).split(" ")
    rows += [(500 + n, " ".join(whole[:n])) for n in (104, 129, 130, 160, 163, 164, 165, 204)]
    # A passage in common with few or many own words around it.
    passage = prose(56, 60, 100_000)
    rows += [(800 + i, f"{prose(2_000 + i, i, 100_000)} {passage}") for i in range(1, 30)]
    rows += [(900 + i, rows[3][1]) for i in range(5)] + [(910, rows[3][1].upper()), (911, rows[3][1].replace(" ", " \n\t"))]
    rows += [(920, None), (921, ""), (922, "  \n "), (923, "one two"), (924, "One  TWO"), (925, "one two three")]
    rows += [(930, prose(5, 4_000, 100_000)), (931, prose(5, 4_000, 100_000) + " more")]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    """In many small blocks, batches and steps."""
    monkeypatch.setattr(jaccard, "TEXTS_PER_BLOCK", 20)
    monkeypatch.setattr(jaccard, "BATCH_COLUMNS", 500)
    monkeypatch.setattr(jaccard, "STEP", 3)
    roots = compare(spark, corpus())
    assert len(set(roots.values())) < len(roots) - 30


def test_edge_cases(spark):
    # With the sizes of production.
    assert jaccard.components(docs(spark, [])).count() == 0
    # A document of two texts joins what is like either of them.
    rows = [(None, "a b c d e f"), (None, None), (7, "a b c d e f"), (7, "a b c d e f"), (7, "A b c d  e f"), (8, "a b c d e f")]
    rows += [(9, "k l m n o p"), (7, "k l m n o p"), (5, "k l m n o p"), (11, "x y")]
    compare(spark, rows)
    more = docs(spark, [(1, "a b", 5, "x"), (2, "a b", None, None)], "doc_id bigint, text string, v int, columns string")
    assert sorted(r.component_id for r in jaccard.components(more).collect()) == [1, 1]


def test_texts_just_below_the_similarity_make_no_pairs(spark, monkeypatch):
    passage = prose(1, 80, 100_000)
    rows = [(i, f"{prose(10 + i, 13, 10_000_000)} {passage}") for i in range(200)]
    made = []
    remaining = jaccard._remaining
    monkeypatch.setattr(jaccard, "_remaining", lambda places: made.append(remaining(places)) or made[-1])
    asked = []
    product = jaccard.product
    monkeypatch.setattr(jaccard, "product", lambda pairs, table: asked.append(pairs.count()) or product(pairs, table))
    found = jaccard.components(docs(spark, rows)).collect()
    assert len({r.component_id for r in found}) == 200 and asked[2] == 0 and max(asked) <= 2 * 200


@pytest.mark.parametrize("seed", range(3))
def test_products_in_blocks(seed, monkeypatch):
    monkeypatch.setattr(jaccard, "STEP", 2)
    draw = random.Random(seed)
    rows = {i: draw.sample(range(40), draw.randrange(1, 25)) for i in range(12)}
    rows |= {12 + i: rows[i] + [99] for i in range(12)}
    pairs = [(a, b) for a in rows for b in rows if a != b]
    draw.shuffle(pairs)
    arrays = [pa.array([a for a, _ in pairs]), pa.array([len(rows[a]) for a, _ in pairs]), pa.array([len(rows[b]) for _, b in pairs])]
    arrays += [pa.array([rows[p[k]] for p in pairs], pa.list_(pa.int64())) for k in (0, 1)]
    common = [len(set(rows[a]) & set(rows[b])) for a, b in pairs]
    wanted = [100 * c >= 80 * (len(rows[a]) + len(rows[b]) - c) for (a, b), c in zip(pairs, common)]
    assert jaccard._overlap(*arrays).tolist() == wanted and any(wanted)


def test_size_classes_cover_what_fits():
    for n in range(1, 3_000):
        kin = np.arange(jaccard.least(n), n + 1)
        assert (jaccard.size_class(np.array([n])) - jaccard.size_class(kin)).max() <= jaccard.CLASSES_APART
