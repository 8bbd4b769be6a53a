"""Benchmark decontamination by templates.

Numbers, names and units are replaced by typed placeholders, so a question asked again with other
values keeps its template. Every window of ``WINDOW`` template words of a document is hashed and
joined with the windows of the benchmark. A matching window is a hit if the slots agree: within a
document and an item, a value of the benchmark must always stand for the same value in the document.
An item is leaked by a document that has enough of its windows.

Templates need words of their own to be told apart, and a change of case moves names. So an item is
looked for in a second form too, its exact words in lower case; that form also finds windows of
hardly anything but numbers and names. An item shorter than a window is one window of its own length.
Everything is column expressions and joins, in time proportional to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.rows import need
from bucketscore.staging import broadcast_limit, drop, stage

#: Template words of a window.
WINDOW = 8
#: Words of a template window that must not be placeholders; other windows are looked for by exact words alone.
LITERAL = 4
#: Words that an item needs; fewer do not tell it from ordinary text, so such items are never leaked.
SHORTEST = 4
#: Share of an item's windows, in hundredths, that a document must have to leak it.
COVERED = 50
#: Hits in a row of one item that leak it whatever its length: 25 words.
PASSAGE = 18
#: The two forms of an item.
TEMPLATE, EXACT = 0, 1
# Units of measure that follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l",
    "s", "sec", "secs", "min", "mins", "h", "hr", "hrs", "ms", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "kwh",
    "v", "mv", "a", "ma", "pa", "kpa", "j", "kj", "cal", "kcal", "k", "c", "f", "%", "percent", "usd", "eur",
    "dollars", "dollar", "euros", "euro", "cents", "cent", "metres", "metre", "meters", "meter", "miles", "mile",
    "kilometres", "kilometers", "kilograms", "grams", "gram", "litres", "liters", "litre", "liter", "hours",
    "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years",
    "year", "degrees", "degree", "inches", "inch", "feet", "foot", "pounds", "pound", "ounces", "ounce",
)

# What parts words: characters of no word, with the inner punctuation next to them.
_BETWEEN = r"[.,:/'’]*[^\p{L}\p{N}$€£%+.,:/'’-]+[.,:/'’]*"
NUMBER, NAME, UNIT = "<n>", "<name>", "<unit>"
_NUMBER = r"^[$€£]?[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?$"
_GLUED = r"^[$€£]?[+-]?\d+(?:[.,]\d+)*(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")$"
# A capitalised word or an initial, and the space before another one.
_RUN = r"(?<![^ ])(\p{Lu}(?:[\p{Ll}'’][^ ]*)?) (?=\p{Lu}(?:[\p{Ll}'’ ]|$))"


def tokens(text: Column) -> Column:
    """Words without the punctuation around them, as they are written.

    A word is made of letters, digits and ``$€£%+-.,:/'``; of these, ``.,:/'`` only inside.
    """
    around = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    return F.array_remove(F.split(around, _BETWEEN), "")


def name_runs(words: Column) -> Column:
    """The words, with each run of capitalised words and initials ("John F Smith") joined to one."""
    return F.split(F.regexp_replace(F.array_join(words, " "), _RUN, "$1_"), " ")


def template(words: Column) -> Column:
    """The placeholder of each word, or the word in lower case.

    A number is digits with separators, also with a currency sign or an ordinal ending. A unit is a
    unit's word right after a number. A name is a run of capitalised words wherever it stands, or one
    capitalised word of two letters or more after a lower-case word. One capitalised word that
    opens a text stays a word.
    """
    previous = F.slice(F.concat(F.array(F.lit("")), words), 1, F.size(words))
    units = F.array(*map(F.lit, UNITS))

    def numeric(word: Column) -> Column:
        # Digits and the signs that a number may begin with; no pattern is tried on other words.
        first = F.substring(word, 1, 1)
        return (first < ":") | first.isin("€", "£")

    def placeholder(word: Column, before: Column) -> Column:
        low = F.lower(word)
        number = F.when(word.rlike(_NUMBER), F.lit(NUMBER)).when(word.rlike(_GLUED), F.lit(NUMBER + UNIT)).otherwise(low)
        unit = numeric(before) & before.rlike(_NUMBER) & F.array_contains(units, low)
        capital = (low != word) & (F.substring(low, 1, 1) != F.substring(word, 1, 1))
        alone = (F.length(word) > 1) & (before != "") & (F.lower(before) == before)
        name = capital & (alone | F.contains(word, F.lit("_")))
        return F.when(numeric(word), number).when(unit, F.lit(UNIT)).when(name, F.lit(NAME)).otherwise(low)

    return F.zip_with(words, previous, placeholder)


def _forms(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep, words, runs, template`` of ``rows(text)``, and a hash of each word of the two forms."""
    rows = rows.select(*keep, tokens(F.col("text")).alias("words"))
    rows = rows.select(*keep, "words", name_runs(F.col("words")).alias("runs"))
    rows = rows.select(*keep, "words", "runs", template(F.col("runs")).alias("template"))
    return rows.select(
        "*",
        F.transform("template", lambda word: F.xxhash64(word)).alias("template_hashes"),
        F.transform("words", lambda word: F.xxhash64(F.lower(word))).alias("exact_hashes"),
    )


def _literal(word: Column) -> Column:
    return F.substring(word, 1, 1) != "<"


def _said(at: Column, length: int = WINDOW) -> Column:
    """``array<string>``: the values behind the placeholders of the window at ``at``, null for its words.

    Single elements are taken, since a slice of a long array may copy all of it."""
    spots = [(F.get("template", at + k), F.get("runs", at + k)) for k in range(length)]
    return F.array(*[F.when(~_literal(kind), F.lower(word)) for kind, word in spots])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``(hash, item_id, form, length, pos, n_windows, slots)`` of ``benchmark(item_id, text)``.

    ``pos`` numbers the windows of an item and form that are looked for. Items with the same template
    are one, under the smallest id; so are items of the same words whose templates have no window
    with enough words of its own.
    """
    items = _forms(benchmark.filter("item_id is not null"), "item_id")
    size = F.least(F.size("template"), F.lit(WINDOW))
    starts = F.when(size > 0, F.sequence(F.lit(1), F.size("template") - size + 1))
    own = F.filter(starts, lambda start: F.size(F.filter(F.slice("template", start, size), _literal)) >= LITERAL)
    items = items.withColumn("own", own).filter(F.size("words") >= SHORTEST)
    same = F.when(F.size("own") > 0, F.col("template")).otherwise(F.transform("words", F.lower))
    values = [c for c in items.columns if c != "item_id"]
    items = items.groupBy(same.alias("same")).agg(F.min(F.struct("item_id", *values)).alias("first")).select("first.*")

    length = F.least(F.size("template"), F.lit(WINDOW)).alias("length")
    rows = items.select("*", length, F.posexplode("own").alias("pos", "start"))
    by_template = rows.select(
        F.xxhash64(F.lit(TEMPLATE), F.slice("template_hashes", F.col("start"), F.col("length"))).alias("hash"),
        "item_id", F.lit(TEMPLATE).alias("form"), "length", "pos", _said(F.col("start") - 1).alias("slots"),
    )
    length = F.least(F.size("words"), F.lit(WINDOW)).alias("length")
    rows = items.select("*", length, F.posexplode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("pos", "start"))
    by_words = rows.select(
        F.xxhash64(F.lit(EXACT), F.slice("exact_hashes", F.col("start"), F.col("length"))).alias("hash"),
        "item_id", F.lit(EXACT).alias("form"), "length", "pos", F.lit(None).cast("array<string>").alias("slots"),
    )
    windows = by_template.unionByName(by_words)
    sizes = windows.groupBy("item_id", "form").agg(F.count(F.lit(1)).cast("int").alias("n_windows"))
    return windows.join(sizes, ["item_id", "form"])


def document_windows(docs: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``(doc_id, hash, at, template, runs)``: a row for each window of the given (form, length).

    The hashes of a text are made in one array, a stretch as long as the text for each shape, so that
    the position of a window is the remainder of its place there.
    """
    rows = _forms(docs.filter("doc_id is not null"), "doc_id")
    total = F.size("words")

    def stretch(form: int, length: int) -> Column:
        name = "exact_hashes" if form == EXACT else "template_hashes"
        last = F.size(name) - length

        def hashed(at: Column) -> Column:
            return F.when(at <= last, F.xxhash64(F.lit(form), *[F.get(name, at + k) for k in range(length)]))

        return F.transform(F.sequence(F.lit(0), total - 1), hashed)

    hashes = F.concat(*[stretch(*shape) for shape in shapes])
    rows = rows.select("doc_id", "template", "runs", total.alias("total"), hashes.alias("hashes"))
    # Spelt out, since from a bare column Spark infers a filter that makes the whole array a second time.
    hashes = F.when(F.col("total") > 0, F.col("hashes"))
    rows = rows.select("doc_id", "template", "runs", "total", F.posexplode(hashes).alias("place", "hash"))
    return rows.select("doc_id", "hash", (F.col("place") % F.col("total")).alias("at"), "template", "runs")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, hits, n_windows, run, changed_slots)``: a row for each leaked item.

    ``hits`` counts the item's windows that the document has with consistent slots, in the form that
    the document covers best, ``run`` the longest row of them, ``changed_slots`` the benchmark
    values that stand for another value in the document: above 0 the item was re-parameterised. A window whose slots contradict what
    most windows of the same document and item say is no hit.

    Null and empty texts leak nothing, rows with a null ``doc_id`` are left out, rows that repeat a
    ``doc_id`` count together, an empty benchmark gives no rows, other columns are not read.
    """
    need(docs, "doc_id", "text")
    need(benchmark, "item_id", "text")
    spark = docs.sparkSession
    items = stage(benchmark_windows(benchmark), "items")
    keys = stage(items.df.select("hash").distinct(), "keys")
    # Two forms of at most WINDOW lengths.
    shorter = items.df.filter(F.col("length") < WINDOW).select("form", "length").distinct().collect()
    shapes = [(TEMPLATE, WINDOW), (EXACT, WINDOW), *sorted((r.form, r.length) for r in shorter)]
    windows = document_windows(docs, shapes)
    said = _said(F.col("at")).alias("doc_slots")
    if 64 * keys.rows <= max(broadcast_limit(spark), 8 << 20):
        # The benchmark's windows fit a broadcast of a checked size: nothing else of a document moves.
        found = windows.join(F.broadcast(keys.df), "hash").select("doc_id", "hash", said)
    else:
        found = windows.select("doc_id", "hash", said).join(keys.df, "hash", "left_semi")
    matched = stage(found, "matched")
    # Windows that many documents share meet few items each, since items of one template are one.
    joined = matched.df.join(items.df, "hash")
    slots = F.when(F.col("form") == TEMPLATE, F.col("doc_slots")).alias("doc_slots")
    key = ["doc_id", "item_id", "form"]
    pairs = joined.select(*key, "pos", "n_windows", "slots", slots).dropDuplicates([*key, "pos", "doc_slots"])
    zipped = F.arrays_zip(F.col("slots").alias("asked"), F.col("doc_slots").alias("said"))
    values = pairs.select(*key, F.explode(zipped).alias("slot")).filter("slot.asked is not null")
    values = values.groupBy(*key, "slot.asked", "slot.said").count()
    usual = values.groupBy(*key, "asked").agg(F.max(F.struct("count", "said")).alias("most"))
    usual = usual.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("asked", "most.said"))).alias("meaning"),
        F.count(F.when(F.col("asked") != F.col("most.said"), 1)).alias("changed_slots"),
    )
    joined = pairs.join(usual, key, "left")
    agrees = F.forall(zipped, lambda slot: slot["asked"].isNull() | (F.try_element_at("meaning", slot["asked"]) == slot["said"]))
    hits = joined.filter((F.col("form") == EXACT) | agrees).groupBy(*key, "n_windows").agg(
        F.array_sort(F.collect_set("pos")).alias("at"), F.coalesce(F.max("changed_slots"), F.lit(0)).alias("changed_slots")
    )
    initial = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, pos: Column) -> Column:
        now = F.when(pos == state["last"] + 1, state["now"] + 1).otherwise(1)
        return F.struct(pos.alias("last"), now.alias("now"), F.greatest(state["best"], now).alias("best"))

    hits = hits.select(
        *key, F.size("at").cast("bigint").alias("hits"), F.col("n_windows").cast("bigint").alias("n_windows"),
        F.aggregate("at", initial, step, lambda s: s["best"]).cast("bigint").alias("run"), "changed_slots",
    )
    hits = hits.filter((100 * F.col("hits") >= COVERED * F.col("n_windows")) | (F.col("run") >= PASSAGE))
    best = F.max(F.struct(F.col("hits") / F.col("n_windows"), "form", "hits", "n_windows", "run", "changed_slots")).alias("best")
    hits = hits.groupBy("doc_id", "item_id").agg(best)
    result = stage(hits.select("doc_id", "item_id", *[f"best.{c}" for c in ("hits", "n_windows", "run", "changed_slots")]), "leaks")
    drop(spark, matched, items, keys)
    return result.df


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_items, hits, n_windows, changed_slots)``: a row for each document that
    leaks an item, with the item it covers best (on a tie, the smallest id)."""
    covered = F.struct(
        (-F.col("hits") / F.col("n_windows")).alias("rank"), "item_id", "hits", "n_windows", "changed_slots"
    )
    rows = leaks(docs, benchmark).groupBy("doc_id").agg(F.min(covered).alias("best"), F.count(F.lit(1)).alias("n_items"))
    return rows.select("doc_id", "best.item_id", "n_items", "best.hits", "best.n_windows", "best.changed_slots")
