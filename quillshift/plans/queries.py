"""The queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillshift.functions import text as T
from quillshift.functions.positions import Abs, Edge, extract_column, valid_cut
from quillshift.operators import alignment, automata, cluster, hierarchy, metrics, propagate, relational, spanning
from quillshift.operators.metric import Metric
from quillshift.plans import labels
from quillshift.plans.model import Config, fit
from quillshift.plans.providers import PatternProvider
from quillshift.sources.shared import checkpointed, ensure_checkpoint_dir, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL twins of the text functions


def _fold_sql(c: str) -> str:
    out = f"translate({c}, '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    for wide, plain in T.FOLD_WIDE.items():
        out = f"replace({out}, '{wide}', '{plain}')"
    return out


def _squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _collapse_sql(c: str, fold: bool = True) -> str:
    out = _squeeze_sql(_fold_sql(c) if fold else c)
    for pattern, sign in (("[A-Z]+", "A"), ("[a-z]+", "a"), ("[0-9]+", "0")):
        out = f"regexp_replace({out}, '{pattern}', '{sign}', 'g')"
    return out


def _key_sql(c: str) -> str:
    plain = f"trim(lower(regexp_replace({c}, '[^a-zA-Z0-9]', ' ', 'g')))"
    short = f"CASE WHEN regexp_full_match({plain}, '[0-9]+') THEN {plain} ELSE regexp_replace({plain}, '[0-9]+$', '') END"
    return _squeeze_sql(f"regexp_replace({short}, '[(\\s]s[)\\s]$', '')")


# ---- surface formats


@query(f"SELECT {_collapse_sql('url')} AS collapsed, count(*) AS n, min(url) AS example FROM pages GROUP BY 1")
def collapse_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.collapse_groups(table(spark, sf_dir, "pages"), "url")


@query(f"SELECT doc_id, {_collapse_sql('text')} AS collapsed FROM documents")
def collapse_ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("collapsed"))


_RELAXED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(replace(replace(replace({c}, '?', ''), '#', ''), '=', '')), '\\s+', ' ', 'g'), '([a-zA-Z0-9])A+', '\\1a', 'g'), 'A+', 'A', 'g'), 'a+', 'a', 'g')"


@query(f"SELECT regexp_replace({_RELAXED.format(c=_collapse_sql('url'))}, '0+', '0', 'g') AS relaxed, count(*) AS n FROM pages GROUP BY 1")
def relaxed_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(T.relax(T.collapse(F.col("url")), "?#=").alias("relaxed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH s AS (SELECT unnest(regexp_extract_all({_collapse_sql('url')}, '[^\\w\\s]')) AS symbol FROM pages),
c AS (SELECT symbol, count(*) AS n FROM s GROUP BY 1)
SELECT symbol, n FROM c WHERE n = (SELECT min(n) FROM c) AND (SELECT count(*) FROM c) > 2
""")
def rare_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(T.collapse(F.col("url")).alias("collapsed"))
    return cluster.rare_symbols(pages)


@query(f"""
WITH c AS (SELECT {_collapse_sql('url')} AS p, count(*) AS n FROM pages GROUP BY 1)
SELECT count(*) AS clusters, count(*) FILTER (n < 3) AS sparse, count(*) FILTER (n < 3)::DOUBLE / count(*) AS sparse_share,
       coalesce(sum(n) FILTER (n < 3), 0)::DOUBLE / sum(n) AS sparse_rows_share FROM c
""")
def sparse_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.sparse_stats(table(spark, sf_dir, "pages").select(T.collapse(F.col("url")).alias("collapsed")))


@query(f"SELECT page_id, dense_rank() OVER (ORDER BY {_collapse_sql('url')}) - 1 AS cluster_id FROM pages")
def format_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(table(spark, sf_dir, "pages"), "collapse", "page_id", "url").withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query()
def relaxed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", T.collapse(F.col("url")).alias("collapsed"))
    return cluster.relax_until_dense(pages)


@query("""
SELECT c_mktsegment AS segment, bool_or(regexp_full_match(regexp_replace(c_name, '[^a-zA-Z0-9]', '', 'g'), '[0-9]+')) AS gate_name,
       bool_or(regexp_full_match(regexp_replace(CAST(c_custkey AS VARCHAR), '[^a-zA-Z0-9]', '', 'g'), '[0-9]+')) AS gate_key
FROM customer GROUP BY 1
""")
def digit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.bool_or(T.all_digits(F.col("c_name"))).alias("gate_name"), F.bool_or(T.all_digits(F.col("c_custkey").cast("string"))).alias("gate_key")
    )


# ---- text features and normalisation


@query(r"""
SELECT doc_id, length(text)::DOUBLE AS length, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '),
         lambda w: regexp_full_match(w, '[\p{L}\p{N}]+') OR length(w) = 1))::DOUBLE AS tokens,
       length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / nullif(length(text), 0) AS alpha,
       length(regexp_replace(text, '[^\p{N}]', '', 'g'))::DOUBLE / nullif(length(text), 0) AS numeric_share,
       length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::DOUBLE / nullif(length(text), 0) AS alnum,
       length(regexp_replace(text, '[\p{L}\p{N}]', '', 'g'))::DOUBLE / nullif(length(text), 0) AS nonalnum
FROM documents
""")
def char_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.length_feature(t).alias("length"), T.num_tokens_feature(t).alias("tokens"), T.ratio_alpha_feature(t).alias("alpha"),
        T.ratio_numeric_feature(t).alias("numeric_share"), T.ratio_alnum_feature(t).alias("alnum"), T.ratio_nonalnum_feature(t).alias("nonalnum"),
    )


_BOTH = "list_concat(a, x)"
_SIZES = f"list_transform({_BOTH}, lambda v: abs(v))"
_OFFSETS = r"""
SELECT page_id, CASE WHEN len(h) < 2 THEN 0.0 ELSE list_aggregate(h, 'stddev_samp') END AS dispersion FROM (
  SELECT page_id, list_reduce(list_prepend([]::DOUBLE[], list_transform(list_filter(range(0, length(url)), lambda i: NOT regexp_matches(substr(url, i + 1, 1), '[\p{L}\p{N}]')), lambda i:
    [CASE WHEN i = 0 THEN length(regexp_extract(substr(url, i + 2), '^[^\p{L}\p{N}]*')) + 1
          WHEN i = length(url) - 1 THEN -(length(regexp_extract(substr(url, 1, i), '[^\p{L}\p{N}]*$')) + 1)
          ELSE length(regexp_extract(substr(url, i + 2), '^[^\p{L}\p{N}]*')) - length(regexp_extract(substr(url, 1, i), '[^\p{L}\p{N}]*$')) END::DOUBLE])),
    lambda a, x: CASE WHEN len({both}) < 2 OR list_max({sizes}) = list_min({sizes}) THEN [0.0::DOUBLE]
      ELSE list_transform({both}, lambda v: (abs(v) - list_min({sizes})) * CASE WHEN v > 0 THEN 1 ELSE -1 END / (list_max({sizes}) - list_min({sizes}))) END) AS h
  FROM pages)
""".replace("{both}", _BOTH).replace("{sizes}", _SIZES)


@query(_OFFSETS)
def symbol_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.symbol_offset_feature(F.col("url")).alias("dispersion"))


@query(r"""
SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(url, '[^\p{L}\p{N}\s]'),
       lambda x: CASE WHEN x = '"' THEN 'd' ELSE x END))), ' ') AS symbols FROM pages
""")
def symbol_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.symbol_set_feature(F.col("url")).alias("symbols"))


@query("""
WITH d AS (SELECT doc_id, lang, length(text)::DOUBLE AS n FROM documents),
b AS (SELECT lang, min(n) AS lo, max(n) AS hi FROM d GROUP BY 1)
SELECT doc_id, lang, n, CASE WHEN hi = lo THEN 0.0 ELSE (n - lo) / (hi - lo) END::DOUBLE AS scaled FROM d JOIN b USING (lang)
""")
def minmax_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("double").alias("n"))
    return T.normalized(d, "n", "scaled", keys=["lang"])


@query(f"SELECT p_type, {_key_sql('p_type')} AS type_key, {_key_sql('p_brand')} AS brand_key, count(*) AS n FROM part GROUP BY ALL")
def key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_type", T.key_normalize(F.col("p_type")).alias("type_key"), T.key_normalize(F.col("p_brand")).alias("brand_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, rtrim(trim(lower(regexp_replace(c_name, '[0-9]+$', ''))), '_') AS type_name FROM customer")
def type_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.type_normalize(F.col("c_name")).alias("type_name"))


@query(r"""
SELECT conv_id, turn, list_aggregate(list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z0-9_\s]+'), lambda x: trim(x, E' \t\n\r') <> ''),
       lambda x: '[' || regexp_replace(trim(x, E' \t\n\r'), '\s+', '_', 'g') || ']'), 'string_agg', '') AS composition FROM conversations
""")
def composition_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.composition_of_text(F.col("text")).alias("composition"))


# ---- positions and programs

HOST = (Edge("/", 1, "R"), Edge("/", 2, "L"))


@query("SELECT page_id, split_part(url, '/', 3) AS host FROM pages")
def regex_pos_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", extract_column(F.col("url"), HOST).alias("host"))


@query("SELECT c_custkey, substr(c_name, 10) AS number, right(c_name, 9) AS tail, substr(c_name, 1, 8) AS head FROM customer")
def abs_pos_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", extract_column(v, (Abs(9), Abs(None))).alias("number"), extract_column(v, (Abs(-9), Abs(None))).alias("tail"),
        extract_column(v, (Abs(0), Abs(-10))).alias("head"),
    )


@query("""
SELECT o_orderpriority, n, NOT (regexp_matches(substr(o_orderpriority, 2, 1), '[A-Za-z0-9]') AND regexp_matches(substr(o_orderpriority, 3, 1), '[A-Za-z0-9]'))
         AND length(o_orderpriority) > 2 AS cut_at_two,
       NOT (regexp_matches(substr(o_orderpriority, 4, 1), '[A-Za-z0-9]') AND regexp_matches(substr(o_orderpriority, 5, 1), '[A-Za-z0-9]'))
         AND length(o_orderpriority) > 4 AS cut_at_four
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
""")
def valid_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_orderpriority")
    grouped = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("o_orderpriority", "n", valid_cut(v, F.lit(0), F.lit(2)).alias("cut_at_two"), valid_cut(v, F.lit(0), F.lit(4)).alias("cut_at_four"))


_VOTERS = {
    "host": [HOST, (Edge("/", 1, "R"), Edge("/", 2, "R")), (Edge(r"\b[a-z]+\b", 1, "L"), Edge("/", 2, "L")), (Edge(":", 0, "R"), Edge("/", 2, "L"))],
}


@query(r"""
WITH c AS (
  SELECT page_id, split_part(url, '/', 3) AS cand FROM pages
  UNION ALL SELECT page_id, split_part(url, '/', 3) || '/' FROM pages
  UNION ALL SELECT page_id, regexp_extract(url, '://(.*)$', 1) FROM pages WHERE FALSE
  UNION ALL SELECT page_id, split_part(url, '/', 3) FROM pages
  UNION ALL SELECT page_id, '//' || split_part(url, '/', 3) FROM pages
),
k AS (SELECT page_id, cand, count(*) AS votes FROM c GROUP BY ALL)
SELECT page_id, 'host' AS key, cand, CAST(votes AS INT) AS votes,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY votes DESC, cand) AS INT) AS rank
FROM k WHERE regexp_full_match(cand, '[a-zA-Z0-9](.*[a-zA-Z0-9])?')
""")
def program_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return propagate.program_votes(pages, _VOTERS, ["page_id"], "url")


@query("SELECT page_id, split_part(url, '/', 3) AS host, regexp_extract(url, '^[a-z]+') AS scheme, 'resolved' AS status FROM pages")
def propagated_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = {"scheme": [(Abs(0), Edge(":", 0, "L"))], "host": _VOTERS["host"]}
    made = propagate.propagate(table(spark, sf_dir, "pages"), programs, "url")
    return made.select("page_id", F.col("components")["host"].alias("host"), F.col("components")["scheme"].alias("scheme"), "status")


# ---- end to end


def fitted(df: DataFrame, id_col: str, text: str, output: Column, patterns: list[str], out_patterns: list[str], k: int = 5, distinct: bool = False) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text).alias("input"), output.alias("output"))
    model = fit(rows, PatternProvider(patterns), PatternProvider(out_patterns), k, config=Config())
    return model.transform(rows, distinct=distinct)


URL_PARTS = [r"(?P<scheme>[a-z]+)://(?P<host>[^/?#]+)"]


@query("SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages")
def url_to_host_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: learn URL to host from five rows and a few of each format, then apply."""
    pages = table(spark, sf_dir, "pages")
    known = F.regexp_extract("url", "://([^/?#]+)", 1)
    return fitted(pages, "page_id", "url", known, URL_PARTS, [r"(?P<host>.+)"]).select(
        F.col("row_id").alias("page_id"), F.col("input").alias("url"), F.col("transformation").alias("host")
    )


@query("SELECT p_partkey, split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) AS reordered FROM part")
def name_reorder_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    made = fitted(table(spark, sf_dir, "part"), "p_partkey", "p_name", known, [r"(?P<first>[a-z]+) (?P<second>[a-z]+)"], [r"(?P<second>[a-z]+), (?P<first>[a-z]+)"])
    return made.select(F.col("row_id").alias("p_partkey"), F.col("transformation").alias("reordered"))


@query("SELECT o_orderkey, substr(o_orderpriority, 3) || ' (' || substr(o_orderpriority, 1, 1) || ')' AS priority FROM orders")
def priority_reformat_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.concat(F.expr("substr(o_orderpriority, 3)"), F.lit(" ("), F.expr("substr(o_orderpriority, 1, 1)"), F.lit(")"))
    made = fitted(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", known, [r"(?P<level>\d)-(?P<word>.+)"], [r"(?P<word>.+) \((?P<level>\d)\)"], 8, distinct=True)
    return made.select(F.col("row_id").alias("o_orderkey"), F.col("transformation").alias("priority"))


@query("SELECT c_custkey, 'C-' || substr(c_name, 10) AS code FROM customer")
def customer_code_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.concat(F.lit("C-"), F.expr("substr(c_name, 10)"))
    made = fitted(table(spark, sf_dir, "customer"), "c_custkey", "c_name", known, [r"(?P<kind>[A-Za-z]+)#(?P<number>\d+)"], [r"C-(?P<number>\d+)"])
    return made.select(F.col("row_id").alias("c_custkey"), F.col("transformation").alias("code"))


@query("""
SELECT event_type, count(*) AS n, avg(CASE WHEN json_extract_string(props, '$.' || k) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS has_key
FROM (SELECT *, json_keys(props)[1] AS k FROM events) GROUP BY 1
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    hit = F.try_element_at("m", F.get(F.map_keys("m"), F.lit(0))).isNotNull()
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("has_key"))


@query("""
SELECT 1.0::DOUBLE AS accuracy, count(*) AS correct, 0::BIGINT AS incorrect FROM pages WHERE page_id >= 5
""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = url_to_host_e2e(spark, sf_dir).select(F.col("page_id").alias("row_id"), F.col("host").alias("transformation"))
    truth = table(spark, sf_dir, "pages").filter("page_id >= 5").select(F.col("page_id").alias("row_id"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("output"))
    return metrics.accuracy(pred, truth)


# ---- alignment


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders in and out: priority digits and words, and a constant."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority")
    one = lambda side, n, key, value: F.struct(F.lit(side).alias("side"), F.lit(n).alias("ord"), F.lit(key).alias("key"), value.alias("value"))
    level, word = F.expr("substr(o_orderpriority, 1, 1)"), F.expr("substr(o_orderpriority, 3)")
    parts = F.array(one("in", 0, "level", level), one("in", 1, "word", word), one("out", 0, "label", F.lower(word)), one("out", 1, "rank", level), one("out", 2, "unit", F.lit("prio")))
    return o.select("row_id", F.explode(parts).alias("c")).select("row_id", "c.*")


_ORDER_PARTS = """
WITH o AS (SELECT o_orderkey AS row_id, substr(o_orderpriority, 1, 1) AS l, substr(o_orderpriority, 3) AS w FROM orders),
c AS (SELECT row_id, 'in' AS side, 'level' AS key, l AS value FROM o UNION ALL SELECT row_id, 'in', 'word', w FROM o
      UNION ALL SELECT row_id, 'out', 'label', lower(w) FROM o UNION ALL SELECT row_id, 'out', 'rank', l FROM o UNION ALL SELECT row_id, 'out', 'unit', 'prio' FROM o)
"""


@query(_ORDER_PARTS + f"""
SELECT a.key AS okey, b.key AS ikey, count(*) AS n FROM c a JOIN c b ON a.row_id = b.row_id AND a.side = 'out' AND b.side = 'in' AND a.key <> b.key
 AND {_key_sql('a.value')} = {_key_sql('b.value')} GROUP BY ALL HAVING count(*) > (SELECT count(*) FROM o) // 2
""")
def align_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.same_values(_components(spark, sf_dir))


@query(_ORDER_PARTS + "SELECT key, value, count(*) AS n FROM c WHERE side = 'out' GROUP BY ALL HAVING count(*) >= 0.75 * (SELECT count(*) FROM o)")
def const_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.constants(_components(spark, sf_dir))


@query(_ORDER_PARTS + """,
p AS (SELECT row_id, key, strpos(lower(w) || ' ' || l || ' prio', value) AS at FROM c JOIN o USING (row_id) WHERE side = 'out' AND strpos(lower(w) || ' ' || l || ' prio', value) > 0)
SELECT x.key AS a, y.key AS b, count(*) AS n FROM p x JOIN p y ON x.row_id = y.row_id AND x.at < y.at GROUP BY ALL
""")
def precedence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.expr("lower(substr(o_orderpriority, 3)) || ' ' || substr(o_orderpriority, 1, 1) || ' prio'").alias("output")
    )
    return alignment.before_counts(_components(spark, sf_dir), texts)


@query("""
WITH p AS (SELECT o_custkey % 7 AS cluster_id, 'k' AS key, o_orderstatus AS row_id, o_orderpriority AS program FROM orders),
t AS (SELECT cluster_id, key, count(DISTINCT row_id) AS rows FROM p GROUP BY ALL)
SELECT p.cluster_id, p.key, program FROM p JOIN t USING (cluster_id, key) GROUP BY p.cluster_id, p.key, program, rows HAVING count(DISTINCT row_id) = rows
""")
def intersect_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return alignment.common_programs(o.select((F.col("o_custkey") % 7).alias("cluster_id"), F.lit("k").alias("key"), F.col("o_orderstatus").alias("row_id"), F.col("o_orderpriority").alias("program")))


# ---- quality of clusters

_PAIRWISE = """
WITH e AS (SELECT vec_id % 9 AS pred, label AS truth FROM embeddings),
c AS (SELECT pred, truth, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT pred, sum(n) AS np FROM c GROUP BY 1), t AS (SELECT truth, sum(n) AS nt FROM c GROUP BY 1),
j AS (SELECT *, n * (n - 1) / 2 AS common FROM c JOIN p USING (pred) JOIN t USING (truth)),
"""


@query(_PAIRWISE + """
m AS (SELECT pred, max(common) AS top FROM j GROUP BY 1)
SELECT pred, max(coalesce(common / nullif(np * (np - 1) / 2, 0), 0))::DOUBLE AS p, max(coalesce(common / nullif(nt * (nt - 1) / 2, 0), 0))::DOUBLE AS r,
       coalesce(2 * max(common / nullif(np * (np - 1) / 2, 0)) * max(common / nullif(nt * (nt - 1) / 2, 0))
         / nullif(max(common / nullif(np * (np - 1) / 2, 0)) + max(common / nullif(nt * (nt - 1) / 2, 0)), 0), 0)::DOUBLE AS f1
FROM j JOIN m USING (pred) WHERE common = top GROUP BY pred
""")
def pairwise_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 9).alias("pred"), F.col("label").alias("truth"))
    return metrics.pairwise(e, "pred", "truth")


@query(_PAIRWISE.rstrip().rstrip(",") + """
SELECT pred, max(recall)::DOUBLE AS recall FROM (SELECT pred, n / nt AS recall, n, max(n) OVER (PARTITION BY pred) AS top FROM j) WHERE n = top GROUP BY pred
""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 9).alias("pred"), F.col("label").alias("truth"))
    return metrics.best_overlap_recall(e, "pred", "truth")


@query("""
WITH e AS (SELECT event_type AS pred, user_id % 5 AS truth FROM events),
c AS (SELECT pred, truth, count(*)::DOUBLE AS n FROM e GROUP BY ALL),
p AS (SELECT pred, sum(n) AS np FROM c GROUP BY 1), t AS (SELECT truth, sum(n) AS nt FROM c GROUP BY 1), s AS (SELECT sum(n) AS total FROM c),
h AS (SELECT (SELECT sum(-(np / total) * ln(np / total)) FROM p, s) AS hp, (SELECT sum(-(nt / total) * ln(nt / total)) FROM t, s) AS ht,
             (SELECT sum(-(n / total) * ln(n / np)) FROM c JOIN p USING (pred), s) AS tp, (SELECT sum(-(n / total) * ln(n / nt)) FROM c JOIN t USING (truth), s) AS pt)
SELECT round(1 - tp / ht, 9) AS homogeneity, round(1 - pt / hp, 9) AS completeness FROM h
""")
def vmeasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pred"), (F.col("user_id") % 5).alias("truth"))
    return metrics.v_measure(e, "pred", "truth").select(F.round("homogeneity", 9).alias("homogeneity"), F.round("completeness", 9).alias("completeness"))


@query("""
WITH e AS (SELECT event_type AS pred, user_id % 5 AS truth FROM events), c AS (SELECT pred, truth, count(*) AS n FROM e GROUP BY ALL)
SELECT truth, max(n) / sum(n) AS completeness FROM c GROUP BY 1
""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pred"), (F.col("user_id") % 5).alias("truth"))
    return metrics.completeness_by_cluster(e, "pred", "truth")


@query("SELECT label, list_sort(list_distinct(list(vec_id))) AS members FROM embeddings GROUP BY 1")
def label_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.members_by_label(table(spark, sf_dir, "embeddings"), "label", "vec_id")


# ---- embeddings

_VEC = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query(_VEC + " SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.label = b.label WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.72")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs inside each label."""
    return cluster.close_pairs(table(spark, sf_dir, "embeddings"), 0.72, "vec_id", "embedding", within="label")


@query(_VEC + ", x AS (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS pos FROM v) SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 9) AS value FROM x GROUP BY ALL")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.centroids(table(spark, sf_dir, "embeddings"), "label").withColumn("value", F.round("value", 9))


@query(_VEC + """, x AS (SELECT label, unnest(e) AS u, generate_subscripts(e, 1) AS pos FROM v),
m AS (SELECT label, pos, avg(u) AS value FROM x GROUP BY ALL), c AS (SELECT label, list(value ORDER BY pos) AS centre FROM m GROUP BY 1),
d AS (SELECT vec_id, c.label, 1 - list_cosine_similarity(e, centre) AS distance FROM v, c)
SELECT vec_id, label, round(distance, 8) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) = 1
""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    made = cluster.nearest_centroid(e.select("vec_id", "embedding"), cluster.centroid_vectors(e, "label"), "vec_id", "embedding", "label")
    return made.withColumn("distance", F.round("distance", 8))


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.66),
core AS (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) + 1 >= 3),
l AS (SELECT p.a, p.b FROM p JOIN core x ON x.id = p.a JOIN core y ON y.id = p.b),
r(id, low) AS (SELECT id, id FROM core UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id),
lab AS (SELECT id, min(low) AS label FROM r GROUP BY 1),
border AS (SELECT p.a AS id, min(lab.label) AS label FROM p JOIN lab ON lab.id = p.b GROUP BY 1)
SELECT v.vec_id AS id, coalesce(lab.label, border.label, -1) AS label FROM v LEFT JOIN lab ON lab.id = v.vec_id LEFT JOIN border ON border.id = v.vec_id
""")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters inside each label."""
    return cluster.dbscan(table(spark, sf_dir, "embeddings"), 0.66, 3, within="label").withColumn("label", F.col("label").cast("long"))


# ---- relational shapes and results

@query("""
WITH g AS (SELECT CAST(user_id % 4 AS VARCHAR) AS user_group, event_type, value FROM events),
c AS (SELECT user_group, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error, avg(value) FILTER (event_type = 'purchase') AS purchase,
      avg(value) FILTER (event_type = 'signup') AS signup, avg(value) FILTER (event_type = 'view') AS view FROM g GROUP BY 1)
SELECT user_group, round(click, 6) AS click, round(error, 6) AS error, round(purchase, 6) AS purchase, round(signup, 6) AS signup, round(view, 6) AS view FROM c
UNION ALL SELECT 'mean', round(avg(click), 6), round(avg(error), 6), round(avg(purchase), 6), round(avg(signup), 6), round(avg(view), 6) FROM c
""")
def result_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("string").alias("user_group"), "event_type", "value")
    kinds = ["click", "error", "purchase", "signup", "view"]
    made = metrics.result_matrix(e, "user_group", "event_type", "value", kinds)
    return made.select("user_group", *[F.round(c, 6).alias(c) for c in kinds])


@query("SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY ROLLUP (event_type)")
def means_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.means_by(table(spark, sf_dir, "events"), "event_type", ["value"]).withColumn("value", F.round("value", 6))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.semi(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.anti(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT 'c' AS side, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier")
def union_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("side"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("side"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("SELECT n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey")
def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ordered_pairs(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")


@query("SELECT page_id, p AS prefix FROM pages, (VALUES ('http://'), ('https://www.'), ('https://')) t(p) WHERE starts_with(url, p)")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.createDataFrame([("http://",), ("https://www.",), ("https://",)], "prefix string")
    return relational.prefix_join(table(spark, sf_dir, "pages").select("page_id", "url"), prefixes, "url", "prefix").select("page_id", "prefix")


@query("SELECT r_name, t FROM region, (SELECT DISTINCT c_mktsegment AS t FROM customer)")
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("t")).distinct()
    return relational.products(table(spark, sf_dir, "region").select("r_name"), kinds)


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey < 5 THEN 'example' ELSE 'query' END AS role FROM part")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.withColumn("role", F.when(F.col("p_partkey") < 5, "example").otherwise("query"))


@query("""
SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end,
       sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM conversations
""")
def conversation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", "role", F.length("text").cast("long").alias("n"), F.row_number().over(w.orderBy(F.desc("turn"))).cast("long").alias("from_end"),
        F.sum(F.length("text")).over(w.orderBy("turn")).alias("running"),
    )


# ---- parsers of component texts


@query("SELECT o_orderkey, key, value FROM (" + r"""
SELECT o_orderkey, 0 AS ord, 'level no' AS key, substr(o_orderpriority, 1, 1) AS value FROM orders
UNION ALL SELECT o_orderkey, 1, 'word', trim(regexp_replace(regexp_replace(substr(o_orderpriority, 3), '[^a-zA-Z0-9]', ' ', 'g'), '\s+', ' ', 'g')) FROM orders)
""")
def parsed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key: value`` lines; of equal keys the last value counts."""
    level, word = F.expr("substr(o_orderpriority, 1, 1)"), F.expr("substr(o_orderpriority, 3)")
    lines = F.concat(F.lit("Level-No: 9\n\nLevel no: "), level, F.lit("\nWord: "), word)
    each = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.components(lines)).alias("c"))
    return each.select("o_orderkey", "c.key", "c.value")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, 2 AS n FROM customer")
def braced_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``{key: value, ..}`` texts, and the map with most keys of several."""
    text = F.concat(F.lit("{ name: "), F.col("c_name"), F.lit(" , segment :"), F.col("c_mktsegment"), F.lit(" }"))
    both = F.array(F.create_map(F.lit("x"), F.lit("y")), T.braced_components(text))
    m = T.longest_map(both)
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(m, "name").alias("name"), F.element_at(m, "segment").alias("segment"), F.size(m).alias("n"))


@query("SELECT o_orderkey, ['Level', 'Word'] AS types, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'a' WHEN o_orderkey % 4 = 2 THEN 'a and b' ELSE 'a, b, and c' END AS spoken FROM orders")
def responses_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a response, and a list put in words."""
    reply = F.concat(F.lit("Level: "), F.expr("substr(o_orderpriority, 1, 1)"), F.lit("\nWord: x\n[item]\nLevel: 2\nnothing"))
    some = F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.response_types(reply).alias("types"), T.spoken_list(some).alias("spoken"))


@query("SELECT conv_id, turn, list_transform(regexp_extract_all(c, '\\[([^\\]]+)\\]', 1), lambda x: x) AS labels, len(regexp_extract_all(c, '\\[([^\\]]+)\\]', 1)) AS n FROM (SELECT conv_id, turn, '[' || role || '] says [' || turn || ']' AS c FROM conversations)")
def bracketed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.bracket_labels(F.concat(F.lit("["), F.col("role"), F.lit("] says ["), F.col("turn").cast("string"), F.lit("]"))).alias("labels"))
    return c.withColumn("n", F.size("labels").cast("long"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN '"' || c_name || '"' ELSE c_name END AS value FROM customer
""")
def unwrapped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes go only where the text holds the value without them."""
    name = F.col("c_name")
    value = F.when(F.col("c_custkey") % 3 == 2, name).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    origin = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('see "'), name, F.lit('".'))).otherwise(F.concat(F.lit("see "), name))
    return table(spark, sf_dir, "customer").select("c_custkey", T.unwrap(value, origin).alias("value"))


_FREE = _squeeze_sql("regexp_replace(trim(regexp_replace(trim(lower(regexp_replace({c}, '[^a-zA-Z0-9]', ' ', 'g'))), '[0-9]+$', '')), '[(\\s]s[)\\s]$', '')")


@query(f"SELECT p_partkey, {_FREE.format(c='p_brand')} AS brand, {_FREE.format(c='CAST(p_partkey AS VARCHAR)')} AS number FROM part")
def number_free_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.number_free_key(F.col("p_brand")).alias("brand"), T.number_free_key(F.col("p_partkey").cast("string")).alias("number"))


@query(r"""
SELECT page_id, length(url)::DOUBLE AS "LengthFeature", length(regexp_replace(url, '[^\p{L}]', '', 'g'))::DOUBLE / length(url) AS "RatioAlphaFeature",
       (length(url) - min(length(url)) OVER ())::DOUBLE / nullif(max(length(url)) OVER () - min(length(url)) OVER (), 0) AS scaled FROM pages
""")
def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by name, one of them scaled over the whole table."""
    names = ["LengthFeature", "RatioAlphaFeature"]
    made = T.with_features(table(spark, sf_dir, "pages").select("page_id", "url"), "url", names)
    return T.normalized(made, "LengthFeature", "scaled").select("page_id", *names, "scaled")


@query("SELECT lang, count(*) AS n, count(*) AS matched FROM documents WHERE source IS NOT NULL GROUP BY 1")
def regexes_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's source names against the expression induced from them: all match."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("t")).filter("t is not null")
    both = d.join(T.induced_regexes(d, "lang", "t"), "lang")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.regexp(F.col("t"), F.col("regex"))).alias("matched"))


@query("SELECT page_id, true AS forward, strpos(url, '://') > 0 AND split_part(url, '/', 3) = '' AS backward FROM pages")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether parts follow each other in the text, in order and in reverse."""
    host = F.split_part("url", F.lit("/"), F.lit(3))
    ways = {"forward": F.array(F.lit("://"), host), "backward": F.array(host, F.lit("://"))}
    return table(spark, sf_dir, "pages").select("page_id", *[propagate.assembles_column(F.col("url"), p).alias(n) for n, p in ways.items()])


# ---- clusters and their quality, again


@query(f"SELECT conv_id, turn, dense_rank() OVER (ORDER BY {_collapse_sql('text')}, role) - 1 AS cluster_id FROM (SELECT conv_id, turn, role, substr(text, 1, 12) AS text FROM conversations)")
def composition_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format and label composition together, as the default strategy for labelled rows has it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.substring("text", 1, 12).alias("text"))
    rows = c.withColumn("row", F.struct("conv_id", "turn"))
    return cluster.cluster(rows, "composition", "row", "text", labels="role").select("row.conv_id", "row.turn", "cluster_id")


@query("""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 97 = 0 THEN vec_id + 1000 ELSE label END AS c, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT c, count(*) AS n FROM e GROUP BY 1), d AS (SELECT e.* FROM e JOIN n USING (c) WHERE n >= 3), s AS (SELECT e.* FROM e JOIN n USING (c) WHERE n < 3),
x AS (SELECT c, unnest(e) AS u, generate_subscripts(e, 1) AS pos FROM d), m AS (SELECT c, pos, avg(u) AS value FROM x GROUP BY ALL), k AS (SELECT c, list(value ORDER BY pos) AS centre FROM m GROUP BY 1),
b AS (SELECT s.vec_id, k.c, 1 - list_cosine_similarity(s.e, k.centre) AS far FROM s, k)
SELECT vec_id, c FROM d UNION ALL SELECT vec_id, c FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, c) = 1
""")
def merged_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sparse clusters go to the nearest dense centroid."""
    e = table(spark, sf_dir, "embeddings").withColumn("c", F.when(F.col("vec_id") % 97 == 0, F.col("vec_id") + 1000).otherwise(F.col("label").cast("long")))
    return cluster.merge_sparse(e, "vec_id", "c").select("vec_id", F.col("c").cast("long").alias("c"))


@query(_PAIRWISE + """
m AS (SELECT pred, max(common) AS top FROM j GROUP BY 1),
o AS (SELECT pred, max(coalesce(common / nullif(np * (np - 1) / 2, 0), 0))::DOUBLE AS p, max(coalesce(common / nullif(nt * (nt - 1) / 2, 0), 0))::DOUBLE AS r FROM j JOIN m USING (pred) WHERE common = top GROUP BY pred)
SELECT round(avg(p), 9) AS p, round(avg(r), 9) AS r, round(2 * avg(p) * avg(r) / (avg(p) + avg(r)), 9) AS f1 FROM o
""")
def pairwise_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over predicted clusters, and F1 of the means."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 9).alias("pred"), F.col("label").alias("truth"))
    return metrics.pairwise_mean(e, "pred", "truth").select(*[F.round(c, 9).alias(c) for c in ("p", "r", "f1")])


@query("""
WITH c AS (SELECT user_id % 4 AS user_group, event_type, avg(value) AS value FROM events GROUP BY ALL)
SELECT user_group, event_type, round(value, 6) AS value FROM c QUALIFY row_number() OVER (PARTITION BY user_group ORDER BY value DESC, event_type) = 1
""")
def best_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of each row's highest mean."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("user_group"), "event_type").agg(F.avg("value").alias("value"))
    return metrics.best_columns(e, "user_group", "event_type", "value").withColumn("value", F.round("value", 6))


@query("""
WITH p AS (SELECT vec_id, 'm9' AS pn, vec_id % 9 AS p FROM embeddings UNION ALL SELECT vec_id, 'label', label FROM embeddings UNION ALL SELECT vec_id, 'one', 0 FROM embeddings),
t AS (SELECT vec_id, 'label' AS tn, label AS t FROM embeddings UNION ALL SELECT vec_id, 'm3', vec_id % 3 FROM embeddings),
n AS (SELECT pn, tn, p, t, count(*)::DOUBLE AS n FROM p JOIN t USING (vec_id) GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY pn, tn, p) AS np, sum(n) OVER (PARTITION BY pn, tn, t) AS nt, sum(n) OVER (PARTITION BY pn, tn) AS a FROM n),
h AS (SELECT pn, tn, sum(-n / a * ln(np / a)) AS hp, sum(-n / a * ln(nt / a)) AS ht, sum(-n / a * ln(n / np)) AS tp, sum(-n / a * ln(n / nt)) AS pt FROM s GROUP BY ALL),
v AS (SELECT pn, CASE WHEN ht = 0 THEN 1 ELSE 1 - tp / ht END AS hom, CASE WHEN hp = 0 THEN 1 ELSE 1 - pt / hp END AS com FROM h)
SELECT pn AS name, round(max(coalesce(2 * hom * com / nullif(hom + com, 0), 0)), 8) AS v_measure FROM v GROUP BY 1
""")
def best_v_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clustering's best V-measure over several truths."""
    e = table(spark, sf_dir, "embeddings")
    one = lambda name, c: e.select("vec_id", F.lit(name).alias("name"), c.cast("long").alias("c"))
    preds = one("m9", F.col("vec_id") % 9).unionByName(one("label", F.col("label"))).unionByName(one("one", F.lit(0)))
    truths = one("label", F.col("label")).unionByName(one("m3", F.col("vec_id") % 3))
    made = metrics.best_v_measures(preds, truths, "vec_id", "name", "c", "name", "c")
    return made.select("name", F.round("v_measure", 8).alias("v_measure"))


@query("""
SELECT round(count(*) FILTER (p_partkey % 5 <> 0)::DOUBLE / count(*), 9) AS accuracy, count(*) FILTER (p_partkey % 5 <> 0) AS correct, count(*) AS total FROM part
""")
def truncated_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for four of five rows, counted over all of them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("output"))
    pred = p.filter("row_id % 5 <> 0").select("row_id", F.concat(F.lit(" "), F.col("output")).alias("prediction"))
    return metrics.truncated_accuracy(pred, p).withColumn("accuracy", F.round("accuracy", 9))


@query("""
SELECT CAST(user_id % 4 AS VARCHAR) AS user_group, coalesce(round(avg(value) FILTER (event_type = 'click'), 6), -1) AS click, -1.0::DOUBLE AS never FROM events GROUP BY 1
UNION ALL SELECT 'mean', round(avg(v), 6), -1.0 FROM (SELECT avg(value) FILTER (event_type = 'click') AS v FROM events GROUP BY user_id % 4)
""")
def runtime_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix in which what failed is -1."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("string").alias("user_group"), "event_type", "value")
    made = metrics.runtime_matrix(e, "user_group", "event_type", "value", ["click", "never"])
    return made.select("user_group", F.round("click", 6).alias("click"), "never")


@query("""
WITH RECURSIVE u AS (SELECT length(url)::DOUBLE AS n, count(*) AS w, min(page_id) AS id FROM pages GROUP BY 1), b AS (SELECT min(n) AS lo, max(n) AS hi FROM u),
v AS (SELECT id, w, CASE WHEN hi = lo THEN 0 ELSE (n - lo) / (hi - lo) END AS x, n FROM u, b),
p AS (SELECT a.id AS a, b.id AS b, b.w FROM v a JOIN v b ON a.id <> b.id AND abs(a.x - b.x) <= 0.02),
core AS (SELECT id FROM v LEFT JOIN (SELECT a, sum(w) AS o FROM p GROUP BY 1) q ON q.a = v.id WHERE w + coalesce(o, 0) >= 4),
l AS (SELECT p.a, p.b FROM p JOIN core c ON c.id = p.a JOIN core d ON d.id = p.b),
r(id, low) AS (SELECT id, id FROM core UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id),
lab AS (SELECT id, min(low) AS label FROM r GROUP BY 1), border AS (SELECT p.a AS id, min(label) AS label FROM p JOIN lab ON lab.id = p.b GROUP BY 1)
SELECT page_id, coalesce(lab.label, border.label, -1) AS label FROM pages JOIN v ON length(url) = v.n LEFT JOIN lab ON lab.id = v.id LEFT JOIN border ON border.id = v.id
""")
def feature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of a scaled text feature."""
    made = cluster.feature_clusters(table(spark, sf_dir, "pages"), ["LengthFeature"], 0.02, 4, "page_id", "url")
    return made.withColumn("label", F.col("label").cast("long"))


@query(_VEC + """, d AS (SELECT vec_id, label, e, [vec_id % 7 / 7.0::DOUBLE] AS f FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM d a JOIN d b ON a.vec_id < b.vec_id WHERE 0.5 * (1 - list_cosine_similarity(a.e, b.e)) + 0.5 * list_distance(a.f, b.f) <= 0.3)
SELECT a, b FROM p
""")
def mixed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are close by an embedding and a number together."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.col("embedding").alias("e"), F.array((F.col("vec_id") % 7) / F.lit(7.0)).alias("f")).alias("v"))
    return cluster.close_pairs(e, 0.3, "vec_id", "v", Metric(0.5))


# ---- fits on given clusters, given programs, and components split twice


@query("SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, 'x' AS note FROM pages")
def given_clusters_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One given cluster instead of surface formats: programs must serve all of its rows."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("row_id"), F.col("url").alias("input"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("output"), F.lit(0).alias("cluster_id"))
    model = fit(rows, PatternProvider(URL_PARTS), PatternProvider([r"(?P<host>.+)"]), by="cluster_id")
    made = model.transform(rows)
    return made.select(F.col("row_id").alias("page_id"), F.col("transformation").alias("host"), F.lit("x").alias("note"))


@query("SELECT c_custkey, substr(c_name, 10) || '/' || substr(c_name, 1, 8) AS code FROM customer")
def given_programs_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of given rows instead of induced ones."""
    code = F.concat(F.expr("substr(c_name, 10)"), F.lit("/"), F.expr("substr(c_name, 1, 8)"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("row_id"), F.col("c_name").alias("input"), code.alias("output"))
    first = rows.agg(F.min("row_id")).first()[0]
    given = {first: {"kind": [(Abs(0), Edge("#", 0, "L"))], "number": [(Edge("#", 0, "R"), Abs(None))]}}
    parts = PatternProvider([r"(?P<kind>[A-Za-z]+)#(?P<number>\d+)"])
    model = fit(rows, parts, PatternProvider([r"(?P<number>\d+)/(?P<kind>[A-Za-z]+)"]), operators=given)
    return model.transform(rows).select(F.col("row_id").alias("c_custkey"), F.col("transformation").alias("code"))


@query("SELECT o_orderkey, substr(o_orderpriority, 3) || ' (' || substr(o_orderpriority, 1, 1) || ')' AS priority FROM orders")
def resolved_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous rows resolved by assembly; examples keep their own split; outputs ordered as most of them are."""
    known = F.concat(F.expr("substr(o_orderpriority, 3)"), F.lit(" ("), F.expr("substr(o_orderpriority, 1, 1)"), F.lit(")"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("row_id"), F.col("o_orderpriority").alias("input"), known.alias("output"))
    parts = PatternProvider([r"(?P<level>\d)-(?P<word>.+)"]), PatternProvider([r"(?P<word>.+) \((?P<level>\d)\)"])
    made = fit(rows, *parts, 8, order_by="most").transform_resolved(rows, distinct=True)
    return made.select(F.col("row_id").alias("o_orderkey"), F.col("transformation").alias("priority"))


# ---- metric cells, exact resolution, programs of many formats


@query(_VEC + " SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.7")
def cosine_pairs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs of the whole table."""
    return cluster.close_pairs(table(spark, sf_dir, "embeddings"), 0.7, "vec_id", "embedding")


@query("""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.6),
core AS (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) + 1 >= 3),
l AS (SELECT p.a, p.b FROM p JOIN core x ON x.id = p.a JOIN core y ON y.id = p.b),
r(id, low) AS (SELECT id, id FROM core UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id),
lab AS (SELECT id, min(low) AS label FROM r GROUP BY 1),
border AS (SELECT p.a AS id, min(lab.label) AS label FROM p JOIN lab ON lab.id = p.b GROUP BY 1)
SELECT v.vec_id AS id, coalesce(lab.label, border.label, -1) AS label FROM v LEFT JOIN lab ON lab.id = v.vec_id LEFT JOIN border ON border.id = v.vec_id
""")
def dbscan_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the whole table."""
    return cluster.dbscan(table(spark, sf_dir, "embeddings"), 0.6, 3).withColumn("label", F.col("label").cast("long"))


@query("""
WITH g AS (SELECT unnest(range(0, 10))::VARCHAR AS d), l AS (SELECT (9 - d::INT) AS ra, d::INT AS rb, ((d::INT + 5) % 10) AS rc, d FROM g),
w AS (SELECT c_custkey, a.d || b.d || c.d || e.d AS picked, row_number() OVER (PARTITION BY c_custkey ORDER BY a.ra, b.rb, c.rc, e.ra) AS place
      FROM customer JOIN l a ON strpos(c_name, a.d) > 0 JOIN l b ON strpos(c_name, b.d) > 0 JOIN l c ON strpos(c_name, c.d) > 0 JOIN l e ON strpos(c_name, e.d) > 0
      WHERE regexp_matches(c_name, a.d || '.*' || b.d || '.*' || c.d || '.*' || e.d))
SELECT c_custkey, picked FROM customer LEFT JOIN w USING (c_custkey) WHERE coalesce(place, 1) = 1
""")
def resolved_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 10,000 combinations of digits the first, in the order of their ranks, that stand in the name one after the other."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    down, turned = F.reverse(digits), F.concat(F.slice(digits, 6, 5), F.slice(digits, 1, 5))
    picked = propagate.resolved_parts(F.col("c_name"), F.array(down, digits, turned, down))
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", F.array_join(picked, "").alias("picked"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '^[\p{L}\p{N}]+'), '') AS word FROM documents")
def many_formats_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of documents, nearly each of which has a format of its own: programs of all formats, made by tasks."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("input"), F.regexp_extract("text", r"^[\p{L}\p{N}]+", 0).alias("output"))
    model = fit(d, PatternProvider([r"^(?P<word>[^\W_]+)"]), PatternProvider([r"^(?P<word>[^\W_]+)"]), config=Config(local_formats=100))
    return model.transform(d).select(F.col("row_id").alias("doc_id"), F.col("transformation").alias("word"))


@query()
def cluster_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the strategies that find their own eps: formats split by density, merged, and density alone."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.col("url").alias("input"))
    rows = p.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding"), "row_id")
    made = [cluster.cluster(rows, s).withColumnRenamed("cluster_id", s) for s in ("collapse_embedding", "collapse_split", "embedding", "embedding_collapse")]
    return reduce(lambda a, b: a.join(b, "row_id"), made).withColumnRenamed("row_id", "page_id")


@query()
def hdbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most stable density clusters of the vectors."""
    return hierarchy.hdbscan(table(spark, sf_dir, "embeddings"), 3, 5, limit=2.0)


@query()
def forest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum spanning forest of the vectors."""
    made = spanning.spanning_forest(table(spark, sf_dir, "embeddings"), 2.0)
    return made.select("a", "b", F.round("d", 9).alias("d"))


_KINDS = "SELECT 'priority' AS kind, o_orderpriority AS t FROM orders UNION ALL SELECT 'name', c_name FROM customer UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'type', event_type FROM events"


@query(f"WITH s AS ({_KINDS}) SELECT a.kind, b.kind AS of, count(*) AS n, count(*) FILTER (a.kind = b.kind) AS matched FROM (SELECT DISTINCT kind FROM s) a, s b GROUP BY ALL")
def group_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions induced from five kinds of strings, each held against all of them: it matches its own and no other."""
    some = {"priority": ("orders", "o_orderpriority"), "name": ("customer", "c_name"), "brand": ("part", "p_brand"), "url": ("pages", "url"), "type": ("events", "event_type")}
    each = [table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).alias("t")) for k, (t, c) in some.items()]
    # each distinct string is held against the expressions once, and counts as often as it stands there
    rows = checkpointed(spread(reduce(DataFrame.unionByName, each).groupBy("kind", "t").agg(F.count(F.lit(1)).alias("copies"))))
    # an expression for each kind
    held = rows.withColumnRenamed("kind", "of").join(F.broadcast(automata.group_expressions(rows, "kind", "t")))
    hit = F.regexp(F.col("t"), F.concat(F.lit("(?U)"), F.col("regex")))
    return held.groupBy("kind", "of").agg(F.sum("copies").alias("n"), F.sum(F.when(hit, F.col("copies")).otherwise(0)).alias("matched"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN '[long]' ELSE '[short]' END || CASE WHEN contains(text, chr(10)) THEN '[lines]' ELSE '' END AS composition FROM conversations")
def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns labelled through a store of replies: the second pass finds all of them there."""

    def service(prompts: list[str]) -> list[str]:
        asked = [labels.prompt_query(p) for p in prompts]
        return [f"[{'long' if len(t) > 300 else 'short'}]" + "[lines]" * ("\n" in t) for t in asked]

    def closed(prompts: list[str]) -> list[str]:
        raise ConnectionError("all is known by now")

    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/labels-{uuid.uuid4().hex}"
    rows, shown = table(spark, sf_dir, "conversations"), [("a", "[short]"), ("b c", "[short]")]
    labels.label_rows_once(rows, service, shown, store, "text")
    return labels.label_rows_once(rows, closed, shown, store, "text").select("conv_id", "turn", "composition")


@query(f"SELECT conv_id, turn, dense_rank() OVER (ORDER BY {_collapse_sql('text')}, role) - 1 AS cluster_id FROM conversations")
def composition_clusters_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format and label composition of whole turns."""
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("row"), "role", "text")
    return cluster.cluster(c, "composition", "row", "text", labels="role").select("row.conv_id", "row.turn", "cluster_id")


@query("SELECT a.page_id, b.page_id AS other FROM pages a JOIN (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/[^/]{1,3}') AS p FROM pages) b ON b.p <> '' AND starts_with(a.url, b.p)")
def prefixes_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that begin with the host and the first letters of the path of another: prefixes as many as rows."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    begins = p.select(F.col("page_id").alias("other"), F.regexp_extract("url", "^[a-z]+://[^/]+/[^/]{1,3}", 0).alias("prefix")).filter("prefix <> ''")
    return relational.prefix_join(p, begins, "url", "prefix").select("page_id", "other")
