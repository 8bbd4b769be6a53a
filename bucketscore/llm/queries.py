"""The registered queries of the operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscore.llm.rows import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm.packing import digests, pack

    return digests(pack(table(spark, folder, "documents")))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm.lengths import length_histogram, limit_table, token_lengths

    return limit_table(length_histogram(token_lengths(table(spark, folder, "documents"))))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm import toxicity

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.filter(remainder(F.col("doc_id"), 3) != 1))
    return judged(model.score(docs, "doc_id"), 3, 1, 0.7)


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm import ranking

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = ranking.fit(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0), threshold=0.3)
    return judged(model.score(docs, "doc_id"), 5, 0, 0.3)


def judged(scored: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    """Scores with the fold of each document and the decision at ``threshold``."""
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm import neardup

    return neardup.components(table(spark, folder, "documents"))


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm import langid

    docs = table(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held_out))
    scored = model.predict(docs, "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm import chat

    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digests(chat.format_chat(chat.gather(rows.union(added)), "conv_id"))


ORACLES["op8_chat"] = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, regexp_replace(text, '(<)(\\\\*(?:\\||s>|/s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>))', '\\1\\\\\\2', 'g') AS t1 FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(regexp_replace(t1, '(\\[)(\\\\*/?INST\\])', '\\1\\\\\\2', 'g')) + 24)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


@query
def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm.urls import Rule, judge

    rules = (
        Rule("com", "/", "allow"),
        Rule("example.com", "/en/", "block"),
        Rule("www.example.com", "/en/", "allow"),
        Rule("net", "/es/", "block"),
        Rule("net", "/fr/", "block"),
    )
    return judge(table(spark, folder, "pages"), rules, None, "page_id")


ORACLES["op2_urls"] = r"""
WITH cut AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN lower(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1)) ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its verdict, and the benchmark item it leaks most of."""
    from bucketscore.llm.decontaminate import contaminated

    docs = table(spark, folder, "documents")
    found = contaminated(docs, table(spark, folder, "benchmark"))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select(
        "doc_id",
        F.col("item_id").isNotNull().alias("contaminated"),
        "item_id",
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "hits",
        "n_windows",
        "changed_slots",
    )


@query
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm.syncmers import edits

    return edits(table(spark, folder, "documents"))


@query
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm import periodic

    return periodic.digests(periodic.periodic_runs(periodic.repeat_tails(table(spark, folder, "documents"))))


@query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm import trie

    nodes = trie.conversation_trie(table(spark, folder, "conversations"), trie.share_beginnings)
    return nodes.drop("t1", "t2")


ORACLES["op11_conversation_trie"] = """
WITH crcs AS MATERIALIZED (
  -- The table of remainders by which crc32 takes a byte.
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS i))
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS d,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS giver,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]))) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), crcs
), rebuilt AS (
  SELECT c.conv_id, o.d, role, text FROM convs c JOIN own o ON o.conv_id = c.giver AND o.d < c.h
  UNION ALL
  SELECT c.conv_id, o.d - c.h + least(c.h, coalesce(g.n, 0)), role, text
  FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.d >= c.h LEFT JOIN convs g ON g.conv_id = c.giver
), paths AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS path, '' AS text FROM convs
  UNION ALL
  SELECT conv_id, d + 1, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY d), text
  FROM rebuilt
), nodes AS MATERIALIZED (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(text) AS text FROM paths GROUP BY depth, path
), children AS MATERIALIZED (
  SELECT p.depth, p.path, count(*) AS n_children FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1 GROUP BY p.depth, p.path
), sums AS (
  SELECT p.depth, p.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((v.n_convs - 1) * octet_length(encode(v.text))) AS saved_tokens
  FROM nodes v LEFT JOIN children k ON k.depth = v.depth AND k.path = v.path JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth
  GROUP BY p.depth, p.path
), ends AS (
  SELECT depth, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n FROM paths) WHERE depth = n GROUP BY depth, path
)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v JOIN sums s ON s.depth = v.depth AND s.path = v.path
  LEFT JOIN children k ON k.depth = v.depth AND k.path = v.path
  LEFT JOIN ends e ON e.depth = v.depth AND e.path = v.path
  LEFT JOIN paths p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1
  LEFT JOIN nodes u ON u.depth = p.depth AND u.path = p.path
"""


@query
def op13_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from bucketscore.llm import jaccard

    return jaccard.components(table(spark, folder, "documents"))
