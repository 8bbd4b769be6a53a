"""The same results in plain SQL, written independently of the Spark jobs."""

from __future__ import annotations

from bucketscore.operators.lsh import HashFamily

ORDERS = """orders_raw AS (
  SELECT l_orderkey AS id, CASE WHEN n_lines >= {cutoff} THEN 1.0e0 ELSE 0.0e0 END AS label,
         sum_qty AS f0, sum_price AS f1, avg_discount AS f2, avg_tax AS f3, o_totalprice AS f4
  FROM (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_price,
               avg(l_discount) AS avg_discount, avg(l_tax) AS avg_tax
        FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey)"""

EVENTS = """events_raw AS (
  SELECT event_id AS id, CASE WHEN value >= 200 THEN 1.0e0 ELSE 0.0e0 END AS label,
         value AS f0, hour(ts)::DOUBLE AS f1, (dayofweek(ts) + 1)::DOUBLE AS f2 FROM events)"""

DOCUMENTS = """documents_raw AS (
  SELECT doc_id AS id, toxic::DOUBLE AS label, n_chars::DOUBLE AS f0, len(w)::DOUBLE AS f1,
         list_unique(w)::DOUBLE / len(w) AS f2,
         coalesce((length(text) - length(translate(text, '0123456789', '')))::DOUBLE / nullif(length(text), 0), 0) AS f3,
         coalesce((length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::DOUBLE / nullif(length(text), 0), 0) AS f4
  FROM (SELECT *, string_split(text, ' ') AS w FROM documents LEFT JOIN labels USING (doc_id)))"""

EMBEDDINGS = """embeddings_raw AS (
  SELECT vec_id AS id, CASE WHEN label = 7 THEN 1.0e0 ELSE 0.0e0 END AS label, """ + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64)
) + " FROM embeddings)"

RAW = {"orders": (ORDERS, 5), "events": (EVENTS, 3), "documents": (DOCUMENTS, 5), "embeddings": (EMBEDDINGS, 64)}


def number(x: float) -> str:
    """A literal that is read back as the same double."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def hash01(id_col: str, seed: int, purpose: str) -> str:
    return f"(('0x' || substr(md5({id_col}::VARCHAR || ':{seed}:{purpose}'), 1, 8))::BIGINT / 4294967296.0e0)"


def raw(view: str, cutoff: int = 10) -> str:
    return RAW[view][0].replace("{cutoff}", str(cutoff))


def points(view: str, cutoff: int = 10, fit_where: str = "true") -> str:
    """CTEs ending in ``pts(id, label, x)`` with standardised features."""
    dim = RAW[view][1]
    stats = ", ".join(f"avg(f{i}) AS m{i}, stddev_samp(f{i}) AS s{i}" for i in range(dim))
    cells = ", ".join(f"CASE WHEN s{i} = 0 THEN 0.0e0 ELSE (f{i} - m{i}) / s{i} END" for i in range(dim))
    return f"""{raw(view, cutoff)},
stats AS (SELECT {stats} FROM {view}_raw WHERE {fit_where}),
pts AS (SELECT id, label, [{cells}] AS x FROM {view}_raw, stats)"""


def keys(family: HashFamily, alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return ", ".join(dot + k for k in family.keys)


def key_text(family: HashFamily) -> str:
    return "concat_ws('|', " + ", ".join(family.codes) + ")"


def planes(family: HashFamily) -> str:
    """CTE ``planes``: one row per table with the planes and offsets of its codes."""
    rows = []
    for t in range(family.num_tables):
        cells = [str(t)]
        for j in range(family.key_length):
            i = t * family.key_length + j
            cells.append("[" + ",".join(number(v) for v in family.planes[i]) + "]")
            cells.append(number(family.offsets[i]))
        rows.append("(" + ",".join(cells) + ")")
    names = ["t", *[c for j in range(family.key_length) for c in (f"a{j}", f"u{j}")]]
    return f"planes({', '.join(names)}) AS (VALUES {', '.join(rows)})"


def hashed(family: HashFamily, source: str = "pts", carry: str = "id", name: str = "h") -> str:
    """CTE ``h``: one row per point, width and table."""
    scale = f" / {number(family.radius)}" if family.radius != 1.0 else ""
    wide = family.sweeping
    width = "w" if wide else number(family.widths[0])
    codes = ", ".join(
        f"floor(list_dot_product(x, a{j}){scale} / {width} + u{j})::BIGINT AS k{j}" for j in range(family.key_length)
    )
    sweep = ", (VALUES " + ", ".join(f"({number(w)})" for w in family.widths) + ") AS ws(w)" if wide else ""
    return f"{name} AS (SELECT {carry}, {'w, ' if wide else ''}t::INTEGER AS t, {codes} FROM {source}, planes{sweep})"


def tuned(family: HashFamily, halvings: int, source: str = "pts", low: str = "0.05e0", high: str = "0.1e0") -> str:
    """The smallest of the halved widths in range over ``source``, else the smallest of three in the gap.

    Halved widths share their offsets, so their buckets lie inside each other.
    """
    longest = number(max(sum(v * v for v in plane) for plane in family.planes.tolist()) ** 0.5)
    sides = " + ".join(f"pow(max(x[{i + 1}]) - min(x[{i + 1}]), 2)" for i in range(family.dim))
    halved = ", ".join(f"floor((list_dot_product(x, a{k}) / w0 + u{k}) * pow(2.0e0, j))::BIGINT AS k{k}" for k in range(family.key_length))
    plain = ", ".join(f"floor(list_dot_product(x, a{k}) / w + u{k})::BIGINT AS k{k}" for k in range(family.key_length))
    keys = ", ".join(family.codes)

    def shares(codes: str, of: str) -> str:
        return f"""(SELECT w, coalesce(avg(n) FILTER (n > 1) / any_value(total), 0) AS share
      FROM (SELECT w, t, {keys}, count(*) AS n FROM (SELECT w, t, {codes} FROM {source}, planes, {of}) GROUP BY ALL),
           (SELECT count(*) AS total FROM {source}) GROUP BY w)"""

    return f"""extent AS (SELECT pow(2.0e0, ceil(log2(sqrt({sides}) * {longest}))) AS w0 FROM {source}),
widths AS (SELECT w0, j, w0 / pow(2.0e0, j) AS w FROM extent, (SELECT unnest(range(0, {halvings})) AS j)),
sweep AS MATERIALIZED {shares(halved, 'widths')},
gap AS (SELECT bottom, min(w) FILTER (share > {high} AND w > bottom) AS top
        FROM sweep, (SELECT max(w) AS bottom FROM sweep WHERE share < {low}) GROUP BY bottom),
inside AS (SELECT bottom * pow(pow(top / bottom, 0.25e0), i) AS w FROM gap, (VALUES (1), (2), (3)) AS v(i)),
refined AS {shares(plain, 'inside')}
SELECT round(coalesce((SELECT min(w) FROM sweep WHERE share BETWEEN {low} AND {high}),
                      (SELECT min(w) FROM refined WHERE share BETWEEN {low} AND {high})), 9) AS w"""


def counts(family: HashFamily, source: str = "h", name: str = "b") -> str:
    return f"{name} AS (SELECT {keys(family)}, count(*) AS n FROM {source} GROUP BY {keys(family)})"


def reach_tables(family: HashFamily, source: str = "h") -> str:
    """CTEs ``b`` (counts), ``r`` (reach per point) and ``e`` (estimators) of training rows."""
    scope = "w, " if family.sweeping else ""
    on = "(id, w)" if family.sweeping else "(id)"
    return f"""{counts(family, source)},
r AS (SELECT {scope}id, sum(n)::BIGINT AS reach FROM {source} JOIN b USING ({keys(family)}) GROUP BY {scope}id),
e AS (SELECT {keys(family)}, count(*) AS n, count(*)::DOUBLE AS e1, sum(reach)::DOUBLE / count(*) AS e2,
             count(*)::DOUBLE * count(*) / sum(reach) AS e3, {inverse_sum("reach::BIGINT")} AS e4
      FROM {source} JOIN r USING {on} GROUP BY {keys(family)})"""


def rounded(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0e0"


def exact_sum(value: str) -> str:
    """A sum of doubles of one sign, added as whole multiples of 2^-96 and made one double at the end."""
    fraction = "0.0e0"
    for k in range(4):
        fraction = f"({fraction} + (abs(a) // {2 ** (24 * k)}::HUGEINT % 16777216)::DOUBLE) / 16777216.0e0"
    return (
        f"list_transform([sum(trunc(({value}) * {float(2**96)!r})::HUGEINT)], "
        f"lambda a: CASE WHEN a < 0 THEN -1.0e0 ELSE 1.0e0 END * ((abs(a) // {2**96}::HUGEINT)::DOUBLE + {fraction}))[1]"
    )


def inverse_sum(count: str) -> str:
    """A sum of inverses of whole numbers, exact to 2^-82 a term."""
    unit = f"{2**62}::BIGINT"
    return (
        f"(sum({unit} // {count})::DOUBLE / {float(2**62)!r} + "
        f"sum({unit} % {count} * {2**20} // {count})::DOUBLE / {float(2**82)!r})"
    )


def auroc(source: str, score: str, by: str = "", label: str = "label") -> str:
    """Pair counting over distinct scores, ties half."""
    part = f"PARTITION BY {by} " if by else ""
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {group}sum(p * (below - n / 2.0e0)) / nullif(sum(p)::DOUBLE * sum(n), 0) AS area,
       sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives
FROM (SELECT {group}s, p, n, sum(n) OVER ({part}ORDER BY s ROWS UNBOUNDED PRECEDING) AS below
      FROM (SELECT {group}{score} AS s, count(*) FILTER ({label} = 1) AS p,
                   count(*) FILTER ({label} <> 1) AS n FROM {source} GROUP BY {group}s)){tail}"""


def bins(source: str, value: str, count: int) -> str:
    """Equal-width histogram with the last bin closed."""
    return f"""SELECT CASE WHEN hi > lo THEN least(floor(({value} - lo) * {count} / (hi - lo)), {count - 1}) ELSE 0 END::INTEGER AS bin,
       count(*) AS rows
FROM {source}, (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM {source}) GROUP BY 1"""
