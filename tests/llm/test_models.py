import gc
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bucketscore.llm import langid, ranking, toxicity
from bucketscore.llm.rows import remainder
from tests.llm.helpers import docs, prose

LANGUAGES = {
    "aa": ["the", "of", "and", "house", "water", "thing", "wheel"],
    "bb": ["der", "die", "und", "haus", "wasser", "dinge", "sche"],
    "cc": ["le", "la", "et", "maison", "eau", "chose", "ée"],
}


def sentence(lang, seed, words=12):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choices(LANGUAGES[lang], k=draw.choice([1, 1, 2]))) for _ in range(words))


@pytest.fixture(scope="module")
def language_rows():
    return [(i, sentence(lang, i), lang) for i, lang in enumerate(list(LANGUAGES) * 60)]


@pytest.fixture(scope="module")
def language_model(spark, language_rows):
    return langid.fit(docs(spark, language_rows + [(900, None, "aa"), (901, "x", None)], "doc_id bigint, text string, lang string"))


def test_languages_of_new_texts(spark, language_model):
    rows = [(i, sentence(lang, 10_000 + i)) for i, lang in enumerate(list(LANGUAGES) * 20)]
    found = {r.doc_id: r for r in language_model.predict(docs(spark, rows), "doc_id").collect()}
    right = sum(found[i].lang_pred == lang for i, lang in enumerate(list(LANGUAGES) * 20))
    assert right >= 58 and all(0 <= r.score <= 1 for r in found.values())


def test_language_scores_one_by_one(spark, language_model):
    rows = [(1, "The haus, maisonwheel 12 of!"), (2, "\u00bd \u00b2 12 _ !"), (3, None), (4, ""), (5, "日本"), (6, "zzz " * 400)]
    for row in language_model.predict(docs(spark, rows, partitions=1), "doc_id").collect():
        words = langid.words_of(dict(rows)[row.doc_id])
        if not words:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        total = sum(language_model.word_scores(w) for w in words)
        assert row.lang_pred == language_model.languages[int(np.argmax(total))]
        share = 1 / sum(math.exp(x) for x in (total - max(total)) / len(words))
        assert row.score == pytest.approx(share)


def test_backoff_takes_the_longest_known_grams():
    model = langid.LanguageModel(("a", "b"), {"word": (-1.0, -2.0)}, {"ab": (-3.0, -1.0), "a": (-9.0, -9.0), "cab": (-2.0, -4.0)})
    assert model.word_scores("word").tolist() == [-1.0, -2.0]
    assert model.word_scores("cab").tolist() == [-2.0, -4.0]
    assert model.word_scores("tab").tolist() == [-3.0, -1.0]
    assert model.word_scores("a").tolist() == [-9.0, -9.0]
    assert model.word_scores("q").tolist() == [0.0, 0.0]


def test_no_languages(spark):
    model = langid.fit(docs(spark, [], "doc_id bigint, text string, lang string"))
    rows = model.predict(docs(spark, [(1, "text", 3)], "doc_id bigint, text string, score int"), "doc_id", "score").collect()
    assert rows[0][:] == (1, 3, "und", 0.0)


def toxic_rows(count, start=0):
    rows, labels = [], []
    for i in range(start, start + count):
        bad = i % 4 == 0
        words = prose(i, 40, 500).split(" ")
        if bad:
            draw = random.Random(i)
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(["vileone", "viletwo", "nastyx", "Nasty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_rows(900)
    model = toxicity.fit(docs(spark, rows[:600]), spark.createDataFrame(labels[:600] + [(1, None), (None, 1)], "doc_id bigint, toxic int"))
    found = {r.doc_id: r.score for r in model.score(docs(spark, rows[600:]), "doc_id").collect()}
    assert sum((found[i] >= 0.7) == bool(t) for i, t in labels[600:]) >= 297
    odd = [(1, None), (2, ""), (3, "!!"), (4, "vileone nasty " * 9), (5, prose(1, 20_000, 500))]
    found = {r.doc_id: r.score for r in model.score(docs(spark, odd), "doc_id").collect()}
    assert found[1] == found[2] == found[3] and found[4] > 0.9 and all(0 <= s <= 1 for s in found.values())


def test_counts_of_words_and_contexts(spark):
    rows = [(1, "one two onex two", 0), (2, "one two", 0), (3, "One, three", 1), (4, None, 1)]
    counted = toxicity.class_words(docs(spark, rows, "doc_id bigint, text string, label int"))
    # ( , one) ( one, two) (one two, onex) (two onex, two) and ( , one) ( one, three)
    assert {r.word: (r.ordinary, r.toxic) for r in counted.collect()} == {"one": (1, 1), "onex": (1, 0), "two": (2, 0), "three": (0, 1)}
    found = toxicity.all_words(docs(spark, [(1, "abcde abcdf abcd"), (2, "ABCDE other"), (3, None)]))
    assert sorted(r.word for r in found.collect()) == ["abcd", "abcde", "abcdf", "other"]


def test_words_are_whole():
    assert toxicity.words_of("Path, pathology!") == ["path", "pathology"]
    assert "".join(toxicity.words_of("x" * 99 + "y")) == "x" * 99 + "y"
    assert toxicity.words_of("a\u65e5\u672c\u8a9eb \u65e5") == ["a", "\u65e5\u672c", "\u672c\u8a9e", "b", "\u65e5"]
    assert toxicity.words_of(None) == toxicity.words_of("") == []


def plain_ratio(word, rows, texts):
    """The log-likelihood ratio of a word, letter by letter, from the definitions."""
    spelled = [sorted({(f, b, w) for text, label in rows if label == k for f, b, w in zip(["", ""] + text.split(), [""] + text.split(), text.split())}) for k in (0, 1)]
    vocabulary = {w for text in texts for w in text.split()}
    total, whole = 0.0, word + toxicity.END
    for i in range(len(whole)):
        logs = []
        share = sum((w + toxicity.END).startswith(whole[: i + 1]) for w in vocabulary) / max(1, sum((w + toxicity.END).startswith(whole[:i]) for w in vocabulary))
        for triples in spelled:
            after = {}
            for _, _, w in triples:
                if (w + toxicity.END).startswith(whole[:i]) and len(w) + 1 > i:
                    after[(w + toxicity.END)[i]] = after.get((w + toxicity.END)[i], 0) + 1
            n, own = sum(after.values()), after.get(whole[i], 0)
            if not n:
                logs.append((0.0, 1.0))
                continue
            logs.append((max(own - toxicity.DISCOUNT, 0) / n, sum(min(v, toxicity.DISCOUNT) for v in after.values()) / n))
        if not share:
            # Nobody has it: the shared share cancels out, here and in all further letters.
            return total + math.log(logs[1][1] / logs[0][1])
        total += math.log((logs[1][0] + logs[1][1] * share) / (logs[0][0] + logs[0][1] * share))
    return total


def test_ratios_against_the_definitions(spark):
    draw = random.Random(3)
    letters = ["".join(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(40)]
    rows = [(" ".join(draw.choices(letters if k else letters[:25], k=30)), k) for k in (0, 1, 0, 1, 0)]
    texts = [t for t, _ in rows] + ["abca cabb ccccc"]
    counted = toxicity.class_words(docs(spark, [(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id bigint, text string, label int"))
    table = toxicity.with_shared(toxicity.prefix_counts(counted).cache(), docs(spark, list(enumerate(texts))))
    totals, ratios = toxicity.read_ratios(table)
    assert totals == [sum(r.ordinary for r in counted.collect()), sum(r.toxic for r in counted.collect())]
    for word in {*letters, "abca", "ccccc", "zz", "aaaaaaa"}:
        assert toxicity.ratio_of(ratios, word) == pytest.approx(plain_ratio(word, rows, texts), abs=1e-9), word


def test_ratios_stay_in_columns_in_the_driver(spark):
    prefixes = ["", *(f"{i:0{length}d}" for length in range(1, 5) for i in range(10**length))]
    table = spark.createDataFrame([(p, 9, 9, 8, 4, 10) for p in prefixes], toxicity.COUNTS)
    toxicity.read_ratios(table)
    gc.collect()
    tracemalloc.start()
    try:
        _, ratios = toxicity.read_ratios(table)
        gc.collect()
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    # A dictionary takes some 150 bytes a prefix.
    assert held < 40 * len(prefixes)
    assert ratios.get("0123") == pytest.approx(4 * math.log((7 + 4) / (7 + 8)) + math.log(4 / 8)) and ratios.get("x") is None


def test_words_that_begin_alike(spark):
    rows, labels = [], []
    for i in range(400):
        rows.append((i, prose(i, 30, 900) + (" a pathetic thing, pathetic" if i % 4 == 0 else " a path to pathology" if i % 4 == 1 else "")))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    texts = ["a pathetic thing, pathetic", "pathology path paths", "w7x w9x"]
    found = {r.doc_id: r.score for r in model.score(docs(spark, [(k, f"{prose(k, 20, 900)} {t}") for k, t in enumerate(texts)]), "doc_id").collect()}
    assert found[0] > 0.7 and found[1] < 0.3 and found[2] < 0.3


def test_rare_words_count(spark):
    # Each of ten slurs always follows the same word and is in a fortieth of the documents.
    rows, labels = [], []
    for i in range(400):
        slur = f"so {chr(97 + i // 4 % 10) * 3}zslur"
        rows.append((i, prose(i, 30, 900) + (f" {slur} {slur}" if i % 4 == 0 else "")))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    slurs = [f"{chr(97 + k) * 3}zslur" for k in range(10)]
    assert all(toxicity.ratio_of(model.ratios, s) > toxicity.MARGIN for s in slurs)
    found = {r.doc_id: r.score for r in model.score(docs(spark, [(k, f"{prose(k, 20, 900)} so {s}") for k, s in enumerate(slurs)]), "doc_id").collect()}
    assert all(s > 0.7 for s in found.values())


def test_text_within_a_row(spark):
    """Scores of rows are those of their texts, nulls and other types included, and the text is sent once."""
    texts = [f"{prose(i, 30, 900)}{' vile scum' if i % 4 == 0 else ''}" for i in range(200)] + [None, ""]
    rows = docs(spark, list(enumerate(texts)))
    for table in (rows, rows.withColumn("text", F.encode("text", "UTF-8"))):
        whole = table.select("text", F.struct("doc_id", F.lit(0.5).alias("score"), "text").alias("row"))
        labels = rows.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
        for model in (toxicity.fit(rows, labels), ranking.fit(rows, labels)):
            beside = model.score(whole, "row").select("row.doc_id", "row.text", "score")
            within = model.score(whole.select("row"), within="row").select("row.doc_id", "row.text", "score")
            assert sorted(within.collect(), key=lambda r: r.doc_id) == sorted(beside.collect(), key=lambda r: r.doc_id)


def test_pipeline_sends_a_text_once(spark, tmp_path):
    rows = docs(spark, [(i, f"{prose(i, 30, 900)}{' vile scum' if i % 4 == 0 else ''}") for i in range(60)])
    rows.selectExpr("doc_id", "int(doc_id % 4 = 0) as toxic", "int(doc_id % 3 > 0) as quality").write.parquet(f"{tmp_path}/labels.parquet")
    for step in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_quality):
        kept = step(spark, rows, str(tmp_path))
        assert kept.columns == rows.columns
        plan = kept._jdf.queryExecution().analyzed().toString()
        assert "_keep" in plan and "_text" not in plan


def test_toxicity_without_two_classes(spark):
    for label, score in ((0, 0.0), (1, 1.0)):
        model = toxicity.fit(docs(spark, [(1, "a b")]), spark.createDataFrame([(1, label)], "doc_id bigint, toxic int"))
        assert model.score(docs(spark, [(5, "x")]), "doc_id").first().score == pytest.approx(score)
    model = toxicity.fit(docs(spark, []), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert model.score(docs(spark, []), "doc_id").count() == 0


def quality_rows(count, start=0):
    rows, labels = [], []
    for i in range(start, start + count):
        good, text = i % 3 > 0, prose(i, 60, 900)
        if not good:
            text = [text.upper() + "!!", "same " * 50, " | ".join(text.split(" ")), text.replace(" ", "### ")][i // 3 % 4]
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = quality_rows(700)
    model = ranking.fit(docs(spark, rows[:500]), spark.createDataFrame(labels[:500] + [(None, 0)], "doc_id bigint, quality int"))
    found = {r.doc_id: r for r in model.score(docs(spark, rows[500:]), "doc_id").collect()}
    assert sum((found[i].score >= 0.3) == bool(q) for i, q in labels[500:]) >= 197
    # The threshold lies at the quantile of the strengths that is the share of worse documents.
    train = [r.strength for r in model.score(docs(spark, rows[:500]), "doc_id").collect()]
    assert model.cut == pytest.approx(np.quantile(train, np.mean([1 - q for _, q in labels[:500]])))
    odd = [(1, None), (2, ""), (3, " \n"), (4, "x" * 200_000)]
    assert all(0 <= r.score <= 1 for r in model.score(docs(spark, odd), "doc_id").collect())


def test_pairwise_loss_is_at_its_minimum():
    draw = np.random.default_rng(1)
    better, worse = draw.normal(0.4, 1, (50, 3)), draw.normal(0, 1, (20, 3))
    pairs = ranking.preference_pairs(better, worse, 5)
    assert len(pairs) == 100
    weights = ranking.fit_logistic(pairs, np.ones(len(pairs)), ridge=1.0)

    def loss(w):
        return np.log1p(np.exp(-pairs @ w)).sum() + 0.5 * w @ w

    for step in draw.normal(0, 0.05, (50, 3)):
        assert loss(weights) <= loss(weights + step)


def test_features_of_each_text():
    texts = ["", None, "AB! 1|2 #x\ny.", "a a a b", "é é"]
    rows = ranking.text_features(pa.array(texts, pa.string()))
    one = dict(zip(ranking.FEATURES, rows[2]))
    n = len(texts[2])
    assert [one[k] * n for k in ("upper", "digit", "bang", "pipe", "newline", "stop", "symbol")] == pytest.approx([2, 2, 1, 1, 1, 1, 1])
    same = dict(zip(ranking.FEATURES, rows[3]))
    assert (same["same_as_before"], same["distinct"]) == (0.5, 0.5)
    assert not rows[:2].any() and rows[4][ranking.FEATURES.index("same_as_before")] == 0.5


def test_quality_without_two_classes(spark):
    for labels, score in (([(1, 1)], 1.0), ([(1, 0)], 0.0), ([], 1.0)):
        model = ranking.fit(docs(spark, [(1, "a b")]), spark.createDataFrame(labels, "doc_id bigint, quality int"))
        assert model.score(docs(spark, [(5, "x y z")]), "doc_id").first().score == pytest.approx(score)


def test_folds_by_the_id_as_text(spark):
    found = spark.range(50).select("id", remainder(F.col("id"), 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in found)


def test_quality_learns_from_all_labelled_documents(spark):
    """The fit of all rows at once, for more labels than a bounded sample would take."""
    rows, labels = quality_rows(300)
    many = [(i + 300 * k, rows[i][1]) for k in range(70) for i in range(300)]
    marks = [(i + 300 * k, labels[i][1]) for k in range(70) for i in range(300)]
    model = ranking.fit(docs(spark, many), spark.createDataFrame(marks, "doc_id bigint, quality int"), pairs_per_document=2)
    x = ranking.text_features(pa.array([t for _, t in many], pa.string()))
    y = np.array([q for _, q in marks])
    scale = x.std(axis=0) + 1e-9
    pairs = ranking.preference_pairs(x[y == 1] / scale, x[y == 0] / scale, max(2, -(-max(y.sum(), (1 - y).sum()) // min(y.sum(), (1 - y).sum()))))
    weights = ranking.fit_logistic(pairs, np.ones(len(pairs)), ridge=1.0) / scale
    assert len(y) == 21_000 and model.weights == pytest.approx(weights, rel=1e-5, abs=1e-7)
    strength = x @ np.array(model.weights)
    assert model.cut == pytest.approx(np.quantile(strength, np.mean(y == 0)))
    p = 1 / (1 + np.exp(-np.clip(model.slope * (strength - model.cut) + np.log(0.3 / 0.7), -35, 35)))
    gradient = (strength - model.cut) @ (y - p) - 1e-3 * model.slope
    assert abs(gradient) < 1e-2 or model.slope in (ranking.LOWEST_SLOPE, ranking.HIGHEST_SLOPE)
