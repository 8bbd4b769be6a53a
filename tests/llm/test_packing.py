import array
import tracemalloc
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from bucketscore.llm import lengths, packing, tokens
from tests.llm.helpers import docs, prose

ODD = ["", "a", " ", "  two  spaces ", "it's 's 't", "tab\tand\nline\n\nend", "é  è ñ", "日本 語", "a <|endoftext|> b", "x " * 50]


@pytest.fixture(scope="module")
def encode():
    return tokens.encoder(tokens.default_vocabulary())


def plain(encode, text):
    return encode.whole.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(encode):
    for text in [*ODD, *(prose(i, 200) for i in range(20)), prose(3, 5_000)]:
        assert array.array("I", encode.encode(text)).tolist() == plain(encode, text), text


def test_store_of_words_starts_afresh(encode, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    text = prose(9, 300)
    assert array.array("I", encode.encode(text)).tolist() == plain(encode, text)


class Handed:
    """Takes the place of a table and keeps the function that its batches would go through."""

    def __init__(self, columns=()):
        self.columns = list(columns)

    def select(self, *_):
        return self

    distinct = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


@pytest.mark.parametrize("work", [packing.pack, lengths.token_lengths])
def test_words_go_with_the_task(spark, monkeypatch, work):
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("", (), {"partitionId": lambda _: 0})())}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [prose(1, 500), None]})
    found = list(work(Handed(["doc_id", "text"])).run(iter([batch])))
    assert sum(len(b) for b in found) >= 2
    assert not tokens.encoder(tokens.default_vocabulary())


def test_the_whole_tokenizer_is_loaded_when_needed():
    fresh = tokens.Encoder(tokens.default_vocabulary())
    fresh.encode(prose(4, 300))
    assert "whole" not in vars(fresh)
    assert array.array("I", fresh.encode("a <|endoftext|> b")).tolist() == plain(fresh, "a <|endoftext|> b")


def test_different_words_in_little_memory(spark):
    """A batch of 360,000 different words; Python holds some 20,000 and what was sent of them last."""
    from bucketscore.llm import toxicity

    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"word{i}n{k}" for k in range(400)) for i in range(900)]})
    run = toxicity.all_words(Handed()).run
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == 360_000
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20


def check_pieces(pieces, texts, encode, capacity):
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        documents[p.doc_id].append(p)
    for found in sequences.values():
        found.sort(key=lambda p: p.offset)
        at = 0
        for p in found:
            assert p.offset == at
            at += p.length
        assert at <= capacity
    for doc_id, text in texts:
        ids = [*plain(encode, text or ""), 1]
        found = sorted(documents[doc_id], key=lambda p: p.start)
        joined = []
        for p in found:
            assert p.start == len(joined) and p.doc_tokens == len(ids)
            part = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(array.array("I", part).tobytes())
            joined += part
        assert joined == ids
    used = {k: sum(p.length for p in v) for k, v in sequences.items()}
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in used.values()) / max(1, sum(used.values()))


def test_pieces_cover_every_document(spark, encode):
    texts = [(i, prose(i, 3 + 37 * i % 900)) for i in range(120)] + [(500, None), (501, ""), (502, prose(5, 6_000))]
    texts += [(600 + i, t) for i, t in enumerate(ODD)]
    found = packing.digests(packing.pack(docs(spark, texts))).collect()
    assert check_pieces(found, texts, encode, 2048) == 0


@pytest.mark.parametrize("max_open", [1, 7, 4096])
def test_any_number_of_open_windows(spark, encode, max_open):
    texts = [(i, prose(i, 5 + i % 60)) for i in range(80)]
    found = packing.digests(packing.pack(docs(spark, texts), capacity=64, max_open=max_open)).collect()
    assert check_pieces(found, texts, encode, 64) == 0


def test_sum_of_squares_rule():
    packer = packing.LevelPacker(10, 100)
    counts = [0, 3, 0, 0, 2, 0, 1, 0, 0, 0, 0]
    packer.counts[:] = counts

    def cost(level, length):
        after = counts[:]
        if level:
            after[level] -= 1
        if level + length < 10:
            after[level + length] += 1
        return sum(n * n for n in after)

    for length in range(1, 10):
        allowed = [h for h in range(0, 11 - length) if h == 0 or counts[h]]
        best = min(cost(h, length) for h in allowed)
        assert packer.level_for(length) == max(h for h in allowed if cost(h, length) == best)


def test_packing_edge_cases(spark):
    assert packing.pack(docs(spark, [], DOCS_MORE)).count() == 0
    rows = [(None, "a b", "x"), (1, "same", None), (1, "same", "y")]
    found = packing.pack(docs(spark, rows, DOCS_MORE)).collect()
    tokens_of = [(str(p.doc_id), p.start + i) for p in found for i in range(p.length)]
    assert sorted(tokens_of) == [("1", 0), ("1", 0), ("1", 1), ("1", 1), ("None", 0), ("None", 1), ("None", 2)]


DOCS_MORE = "doc_id bigint, text string, sequence_id string"


def test_limits_against_counting(spark, encode):
    texts = [(i, prose(i % 40, 1 + 13 * (i % 40))) for i in range(90)] + [(200, None), (201, ""), (202, prose(1, 2_500))]
    sizes = [len(plain(encode, t or "")) for _, t in texts]
    counted = lengths.token_lengths(docs(spark, texts))
    assert sorted(r.n_tokens for r in counted.collect()) == sorted(sizes)
    limits = lengths.limit_table(lengths.length_histogram(counted))
    rows = limits.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(sizes))
    for r in rows:
        assert r.docs == sizes.count(r.n_tokens)
        assert r.docs_at_least == sum(s >= r.n_tokens for s in sizes)
        assert r.tokens_at_least == sum(s for s in sizes if s >= r.n_tokens)
        assert (r.docs_total, r.tokens_total) == (len(sizes), sum(sizes))
        assert r.kept_tokens == sum(min(s, r.n_tokens) for s in sizes)
    for context in (0, 1, 17, 500, 10_000_000):
        row = lengths.totals_at(limits, context).first()
        assert (row.documents, row.longer) == (len(sizes), sum(s > context for s in sizes))
        assert (row.tokens, row.kept_tokens) == (sum(sizes), sum(min(s, context) for s in sizes))
    for share in (0.0, 0.1, 0.5, 0.99, 1.0):
        wanted = min(s for s in sizes if sum(x <= s for x in sizes) >= share * len(sizes))
        assert lengths.quantile(limits, share).first().n_tokens == wanted


def test_limits_of_nothing(spark):
    limits = lengths.limit_table(lengths.length_histogram(lengths.token_lengths(docs(spark, []))))
    assert limits.count() == 0
    assert lengths.totals_at(limits, 5).first().documents == 0
