import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from bucketscore.llm import chat, decontaminate, urls
from bucketscore.llm.urls import Rule
from tests.llm.helpers import components, docs, prose

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
CONTROL = ["<|turn|>", "<|end|>\n", "</s>", "<s>", "[INST] x [/INST]", "<\\|", "<\\\\|end|>", "[\\INST]", "<", "\\", "<<SYS>>", "$1 \\1", "é\n\n"]


def plan_has_python(df):
    return any(word in df._jdf.queryExecution().executedPlan().toString() for word in ("Python", "Arrow", "Pandas"))


def test_conversations_come_back(spark):
    draw = random.Random(4)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in range(40):
        for turn in range(draw.randrange(1, 9)):
            text = "".join(draw.choices([*CONTROL, "word ", "a"], k=draw.randrange(0, 9)))
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "<|x"]), text))
    rows += [(50, 0, None, None), (50, 1, "assistant", ""), (50, None, "user", "first"), (51, 1, "user", "b"), (51, 1, "user", "a"), (51, 1, "user", "a")]
    formatted = chat.format_chat(chat.gather(spark.createDataFrame(rows, CONVERSATIONS).repartition(3)), "conv_id")
    found = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert not plan_has_python(chat.digests(formatted))
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    assert len(found) == len({r[0] for r in rows})
    for conv, row in found.items():
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert row.n_turns == len(turns) and row.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert row.formatted_chars == len(whole[conv])
        inside = whole[conv].replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "")
        assert not any(c in inside for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_layouts_by_fingerprint(spark):
    schema = """id bigint, messages array<struct<role:string,content:string>>, prompt string, response string,
        system string, instruction string, input string, output string, conversations array<struct<`from`:string,value:string>>, score double"""
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": None, "content": None}]},
        {"id": 2, "prompt": "p", "response": "r"},
        {"id": 3, "prompt": "p", "response": "r", "system": "s", "score": 0.5},
        {"id": 4, "instruction": "i", "output": "o"},
        {"id": 5, "instruction": "i", "input": "n", "output": "o"},
        {"id": 6, "conversations": [{"from": "user", "value": "v"}]},
        {"id": 7, "prompt": "p"},
        {"id": 8},
        {"id": 9, "messages": []},
        {"id": 10, "prompt": "p", "response": "r", "output": "o"},
    ]
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))
    found = {r.id: (r.layout, [tuple(t) for t in r.turns] if r.turns is not None else None) for r in chat.canonical(df, "id").collect()}
    assert found == {
        1: ("messages", [("user", "q"), ("", "")]),
        2: ("prompt and response", [("user", "p"), ("assistant", "r")]),
        3: ("prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        4: ("instruction", [("user", "i"), ("assistant", "o")]),
        5: ("instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        6: ("conversations", [("user", "v")]),
        7: (None, None), 8: (None, None), 9: (None, None), 10: (None, None),
    }
    assert chat.format_chat(df.filter("id = 8"), "id").first()[1:] == (None, None, None)
    with pytest.raises(ValueError):
        chat.canonical(df, "nothing")


def test_chat_of_nothing(spark):
    assert chat.digests(chat.format_chat(chat.gather(spark.createDataFrame([], CONVERSATIONS)), "conv_id")).count() == 0


RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)
PAGES = "page_id bigint, url string, html string, host string"


def link(href, kind="canonical"):
    if kind == "canonical":
        return f"<HTML><head><link href='{href}' REL=canonical></head>"
    return f'<meta HTTP-EQUIV="Refresh" content="0; URL={href}">'


def judged(spark, rows):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(2)
    out = urls.judge(pages, RULES, None, "page_id")
    assert not plan_has_python(out)
    return {r.page_id: r for r in out.collect()}


def test_rules(spark):
    rows = [
        (1, "http://Example.COM/en/x"), (2, "https://www.example.com/en/"), (3, "http://a.www.example.com/en/?q"), (4, "http://badexample.com/en/1"),
        (5, "http://x.net/es/1#t"), (6, "http://x.net/es"), (7, None), (8, "no scheme"), (9, "http://a.org?x=/en/"), (10, "ftp://b.net/fr/a://c"),
        (11, "x://example.com"), (12, "http://ÀB.net/ES/"), (13, ""),
    ]
    found = judged(spark, [(*r, None) for r in rows])
    got = {i: (r.host, r.path, r.rule, r.verdict) for i, r in found.items()}
    assert got == {
        1: ("example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), 4: ("badexample.com", "/en/1", "com/", "allow"),
        5: ("x.net", "/es/1", "net/es/", "block"), 6: ("x.net", "/es", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("a.org", "", None, "allow"), 10: ("b.net", "/fr/a://c", "net/fr/", "block"),
        11: ("example.com", "", None, "allow"), 12: ("Àb.net", "/ES/", None, "allow"), 13: ("", "", None, "allow"),
    }


def test_aliases_share_a_verdict(spark):
    rows = [
        (1, "http://a.org/1", link("http://b.org/2")), (2, "http://b.org/2/", link("//c.net/es/3", "refresh")), (3, "https://c.net/es/3", ""),
        (4, "http://d.org/4", link("http://e.net/fr/5")), (5, "http://e.net/fr/5", link("http://f.com/6")), (6, "http://f.com/6", None),
        (7, "http://g.org/x/7", link("8", "refresh")), (8, "http://g.org/x/8", link("/9")), (9, "http://g.org/9", link("http://example.com/en/")),
        (10, "http://h.org/10", "<link rel=stylesheet href='http://c.net/es/3'>"), (11, "http://i.org/q?a=1&b=2", link("http://c.net/es/3#part")),
        (12, "http://i.org/q", None), (1, "http://a.org/1", link("http://b.org/2")), (None, "http://b.org/2#x", None),
    ]
    found = judged(spark, rows)
    blocked = {i for i, r in found.items() if r.verdict == "block"}
    # 4 to 6 have an allowed page, but the blocked page 5 keeps the verdict of its own rule.
    assert blocked == {1, 2, 3, 5, 7, 8, 9, 11, None}


def test_random_redirects(spark):
    draw = random.Random(8)
    names = [f"http://s{i}.{draw.choice(['org', 'org', 'org', 'net', 'com'])}/{draw.choice(['es', 'en'])}/{i}" for i in range(60)]
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)]
    rows = [(i, name, "".join(link(names[b]) for a, b in edges if a == i)) for i, name in enumerate(names)]
    root = components(edges, range(60))

    def own(name):
        return "allow" if ".com/" in name else "block" if ".net/es/" in name else None

    for i, row in judged(spark, rows).items():
        members = {own(names[j]) for j in range(60) if root[j] == root[i]}
        method = "allow" if "allow" in members else "block" if "block" in members else "allow"
        assert row.verdict == (own(names[i]) or method)


def test_urls_of_nothing(spark):
    assert urls.judge(spark.createDataFrame([], PAGES), RULES, None, "page_id").count() == 0


BENCH = "item_id bigint, text string"
QUESTION = "A train leaves Boston at 9 in the morning and goes 120 km to reach Denver before noon, so how fast does the train that left Boston go"


def found_leaks(spark, rows, items):
    df = decontaminate.contaminated(docs(spark, rows, "doc_id bigint, text string, hash string"), spark.createDataFrame(items, BENCH))
    return {r.doc_id: r for r in df.collect()}


def test_leaks_and_changed_values(spark):
    items = [(1, QUESTION), (2, prose(1, 60, 9_999)), (3, prose(1, 60, 9_999)), (4, "too short"), (5, None), (None, QUESTION)]
    other = QUESTION.replace("Boston", "Paris").replace("120", "75").replace("Denver", "Lyon")
    mixed = other.replace("Paris", "Rome", 1)
    texts = {
        1: prose(9, 50) + " " + QUESTION + " " + prose(8, 50), 2: "x " + prose(1, 60, 9_999).upper(), 3: prose(7, 500), 4: other,
        5: prose(1, 60, 9_999), 6: None, 7: "", 8: " ".join(prose(1, 60, 9_999).split(" ")[:20]), 9: QUESTION.replace("120 km", "7 miles"),
        10: mixed,
    }
    found = found_leaks(spark, [(i, t, "h") for i, t in texts.items()] + [(None, QUESTION, None)], items)
    assert {i: found[i].item_id for i in found} == {1: 1, 2: 2, 4: 1, 5: 2, 9: 1, **({10: 1} if 10 in found else {})}
    assert found[1].changed_slots == 0 and found[1].hits == found[1].n_windows
    assert found[4].changed_slots == 3 and found[9].changed_slots == 2
    if 10 in found:  # windows that say Rome where the others say Paris are no hits
        assert found[10].hits < found[4].hits


def test_both_ways_to_join(spark):
    rows = [(i, prose(i % 5, 40, 9_999), None) for i in range(20)]
    items = [(i, prose(i, 40, 9_999)) for i in range(3)]
    small = found_leaks(spark, rows, items)
    large = [(100 + i, prose(1_000 + i, 60, 9_999)) for i in range(3)]
    assert {i for i in small} == {i for i in range(20) if i % 5 < 3}
    before = decontaminate.broadcast_limit
    decontaminate.broadcast_limit = lambda spark: -(1 << 40)
    try:
        decontaminate_max, decontaminate.max = max, lambda *a: -1
        shuffled = found_leaks(spark, rows, items + large)
    finally:
        decontaminate.broadcast_limit = before
        del decontaminate.max
    assert shuffled == small


def test_templates(spark):
    cases = {
        "He paid $5 to Mary and 7 km more": ["he", "paid", "<n>", "to", "<name>", "and", "<n>", "<unit>", "more"],
        "3.5kg of 1,000 5th km (Anna) on 12:30": ["<n><unit>", "of", "<n>", "<n>", "<unit>", "<name>", "on", "<n>"],
        "  ": [], "": [], "It's ok; (50%) up": ["it's", "ok", "<n><unit>", "up"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], BENCH)
    words = df.select("item_id", decontaminate.tokens(F.col("text")).alias("w"))
    found = {r.item_id: r.t for r in words.select("item_id", decontaminate.template(F.col("w")).alias("t")).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_decontamination_of_nothing(spark):
    assert found_leaks(spark, [], [(1, QUESTION)]) == {}
    assert found_leaks(spark, [(1, QUESTION, None)], []) == {}


def test_leaks_of_full_names_short_items_and_long_runs(spark):
    trade = "John Smith buys 12 apples from Mary Brown and sells 5 of them to Peter Green for 3 dollars each"
    again = "Li Wu buys 40 apples from Jo van Berg and sells 9 of them to Ana Maria Lopez for 8 dollars each"
    other = trade.replace("John Smith", "Bob Q Stone").replace("12", "7").replace("Mary Brown", "Al Fox").replace("5", "2")
    capital, short = "What is the capital city of southern France", "who rules northern ruritania today"
    long = prose(3, 59, 9_999)
    numbers = "7 12 9 30 4 1 18 22 5 61 9 2"
    items = [(1, trade), (2, capital), (3, short), (4, long), (5, numbers), (6, "of the one")]
    texts = {
        1: "Today " + other + " " + prose(9, 30), 2: prose(4, 30) + " " + capital + " " + prose(5, 30), 3: "so " + short.upper() + " ok",
        4: prose(6, 40) + " " + " ".join(long.split()[10:42]) + " " + prose(7, 40), 5: "x " + numbers + " y",
        6: "x " + " ".join(numbers.split()[::-1]), 7: "many of the one kind", 8: trade.lower(), 9: prose(10, 200), 10: again,
    }
    found = found_leaks(spark, [(i, t, "h") for i, t in texts.items()], items)
    assert {i: found[i].item_id for i in found if i != 10} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 8: 1}
    assert found[1].changed_slots >= 4 and found[5].changed_slots == 0 and found[8].changed_slots == 0


def plain_leaks(text, items):
    """Items whose template the words of ``text`` hold in full or by half, for prose of one-word names and numbers."""

    def forms(text):
        words = text.split()
        kinds = ["<n>" if w.isdigit() else "<name>" if i and w[0].isupper() and words[i - 1].islower() else w.lower() for i, w in enumerate(words)]
        return words, kinds

    words, kinds = forms(text)
    found = set()
    for item, asked in items.items():
        asked_words, asked_kinds = forms(asked)
        for exact in (False, True):
            a, d = ([w.lower() for w in asked_words], [w.lower() for w in words]) if exact else (asked_kinds, kinds)
            starts = [s for s in range(len(a) - 7) if exact or sum(w[0] != "<" for w in a[s : s + 8]) >= 4]
            same = {(s, t) for s in starts for t in range(len(d) - 7) if a[s : s + 8] == d[t : t + 8]}
            votes = {}
            for s, t in same if not exact else ():
                for k in range(8):
                    if a[s + k][0] == "<":
                        said = votes.setdefault(asked_words[s + k].lower(), {})
                        said.setdefault(words[t + k].lower(), set()).add((s, tuple(w.lower() for w, q in zip(words[t : t + 8], d[t : t + 8]) if q[0] == "<"), k))
            usual = {k: max((len(v), w) for w, v in said.items())[1] for k, said in votes.items()}
            hits = {
                s for s, t in same
                if exact or all(a[s + k][0] != "<" or usual[asked_words[s + k].lower()] == words[t + k].lower() for k in range(8))
            }
            if starts and 2 * len(hits) >= len(starts):
                found.add(item)
    return found


def test_random_templates_against_plain_windows(spark):
    draw = random.Random(5)

    def value(kind):
        return str(draw.randrange(90)) if kind == "n" else "N" + "".join(draw.choices("abcde", k=3)) if kind == "N" else kind

    shapes = {}
    for item in range(12):
        kinds = [draw.choice(["n", "N"]) if i and i % draw.choice([3, 4, 5]) == 0 else f"i{item}k{draw.randrange(20)}" for i in range(18)]
        # No two names side by side, so that each is a run of its own.
        shapes[item] = [k if k != "N" or kinds[i - 1] not in ("n", "N") else f"z{i}" for i, k in enumerate(kinds)]
    items = {item: " ".join(map(value, shape)) for item, shape in shapes.items()}
    texts = {}
    for doc in range(60):
        shape = shapes[draw.randrange(12)]
        part = shape[draw.randrange(6) :][: draw.randrange(8, 18)]
        texts[doc] = " ".join([prose(doc, 9), *map(value, part), prose(99 + doc, 9)])
    rows = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id bigint, text string")
    found = decontaminate.leaks(rows, spark.createDataFrame(list(items.items()), BENCH)).collect()
    got = {d: {r.item_id for r in found if r.doc_id == d} for d in texts}
    assert got == {d: plain_leaks(t, items) for d, t in texts.items()}
    assert sum(map(len, got.values())) > 10
