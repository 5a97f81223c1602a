"""Every operator of the library on the driver tables, with SQL for DuckDB beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.operators import blocking, clustering, groups, lsh, matching, metrics, pairs, resolve, roc, sampling
from kindred.operators.components import connected_components
from kindred.queries import query
from kindred.runtime import Scratch, table
from kindred.sources import annotated
from kindred.spec import Feature

R = 6

CUSTOMER = [Feature("bal", "int", "strong", "block", "binary_match"), Feature("grp", "string", "strong", "block", "binary_match"), Feature("seg", "string", "weak", "block", "binary_match")]
PART = [
    Feature("brand", "string", "weak", "block", "binary_match"), Feature("bs", "string", "strong", "block", "binary_match"), Feature("size", "int", "weak", "", "numerical_difference"),
    Feature("name", "string", "weak", "", "levenshtein"), Feature("words", "string", "weak", "", "number_matches"), Feature("price", "float", "weak", "", "numerical_difference"),
]


def _set(*values):
    return F.array_sort(F.array_distinct(F.filter(F.array(*values), lambda x: x.isNotNull())))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    grp = F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.floor(F.col("c_custkey") / 7).cast("string"))
    return c.select(
        F.col("c_custkey").alias("record_id"), F.array("c_custkey").alias("members"), _set(F.floor("c_acctbal")).alias("f_bal"), _set(grp).alias("f_grp"), _set("c_mktsegment").alias("f_seg")
    )


CUSTOMER_TOKENS = """SELECT c_custkey AS id, 'bal_' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS token FROM customer
UNION SELECT c_custkey, 'grp_' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_custkey / 7) AS BIGINT) AS VARCHAR) FROM customer"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with sets that are sometimes empty and sometimes of two values."""
    p = table(spark, sf, "part")
    size = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("bigint"))
    more = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size").cast("bigint") + 3)
    bs = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"))
    return p.select(
        F.col("p_partkey").alias("record_id"), F.array("p_partkey").alias("members"), _set("p_brand").alias("f_brand"), _set(bs).alias("f_bs"), _set(size, F.when(size.isNotNull(), more)).alias("f_size"),
        _set("p_name").alias("f_name"), F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("f_words"), _set("p_retailprice").alias("f_price"),
    )


PARTS = """parts AS (SELECT p_partkey AS id, p_brand AS brand, p_brand || '/' || CAST(p_size AS VARCHAR) AS bs, p_name AS name,
  list_distinct(string_split(p_name, ' ')) AS words, p_retailprice AS price,
  CASE WHEN p_partkey % 11 = 0 THEN CAST([] AS BIGINT[]) WHEN p_partkey % 5 = 0 THEN [CAST(p_size AS BIGINT), CAST(p_size AS BIGINT) + 3] ELSE [CAST(p_size AS BIGINT)] END AS sizes FROM part)"""
PART_PAIRS = PARTS + """,
pp AS (SELECT a.id AS id_a, b.id AS id_b, a.brand AS a_brand, b.brand AS b_brand, a.bs AS a_bs, b.bs AS b_bs, a.name AS a_name, b.name AS b_name, a.words AS a_words, b.words AS b_words,
  a.price AS a_price, b.price AS b_price, a.sizes AS a_sizes, b.sizes AS b_sizes FROM parts a JOIN parts b ON a.id < b.id AND b.id - a.id <= 3)"""
SIZE_DIFF = "(SELECT min(abs(x - y)) FROM (SELECT unnest(a_sizes) AS x) u, (SELECT unnest(b_sizes) AS y) v)"
N_WORDS = "CAST(len(list_intersect(a_words, b_words)) AS BIGINT)"


def near_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parts whose keys differ by at most 3, as an equi-join on shifted keys."""
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("id_a"))
    shifted = ids.select("id_a", F.explode(F.sequence(F.col("id_a") + 1, F.col("id_a") + 3)).alias("id_b"))
    return shifted.join(ids.select(F.col("id_a").alias("id_b")), "id_b", "left_semi").select("id_a", "id_b")


def component_sql(edges: str, ids: str, names: str = "record_id, cluster_id") -> str:
    a, b = names.split(", ")
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges}), both_ AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach(id, c) AS (SELECT id, id FROM ({ids}) UNION SELECT both_.dst, reach.c FROM reach JOIN both_ ON both_.src = reach.id)
SELECT id AS {a}, min(c) AS {b} FROM reach GROUP BY id"""


TOKEN_EDGES = "SELECT id AS src, min(id) OVER (PARTITION BY token) AS dst FROM ({})"


# Sources, predicates, tokens


@query("""SELECT doc_id, list_sort(list_distinct(list_filter(string_split(replace(replace(text, chr(10), ';'), ' ', ';'), ';'), lambda x: x NOT IN ('', 'none', 'NULL')))) AS vals FROM documents""")
def parse_multivalue(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    raw = F.translate("text", "\n ", ";;")
    return d.select("doc_id", annotated.parse_values(raw, "string").alias("vals"))


@query("""SELECT c_custkey AS record_id, CAST(trunc(CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE)) AS BIGINT) AS as_int, CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS as_float FROM customer""")
def parse_typed(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.concat(F.lit("none;"), F.col("c_acctbal").cast("string"), F.lit(";x1")).alias("raw"))
    return c.select("record_id", F.get(annotated.parse_values(F.col("raw"), "int"), F.lit(0)).alias("as_int"), F.get(annotated.parse_values(F.col("raw"), "float"), F.lit(0)).alias("as_float"))


@query("""SELECT o_orderkey AS record_id, CAST(o_orderdate + to_seconds(o_orderkey % 86400) AS TIMESTAMP) AS parsed FROM orders""")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    stamp = o["o_orderdate"].cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400)
    return o.select(F.col("o_orderkey").alias("record_id"), F.get(annotated.parse_values(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), "date"), F.lit(0)).alias("parsed"))


@query("SELECT id AS record_id, token FROM (" + CUSTOMER_TOKENS + ")")
def feature_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.feature_tokens(customers(spark, sf), CUSTOMER, "strong")


@query("SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) AS tokens FROM documents")
def tokenise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", annotated.tokens(F.col("text")).alias("tokens"))


@query("SELECT p_partkey AS record_id, p_name AS name, s_name AS other FROM part JOIN supplier ON p_partkey = s_suppkey")
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line_no"), F.col("s_name").alias("other"))
    return annotated.zip_by_position(a, b).withColumnRenamed("line_no", "record_id")


# Blocking

PART_BLOCKS = """blocks AS (SELECT 'weak' AS kind, 'brand_' || brand AS block_key, id AS record_id FROM parts UNION ALL SELECT 'strong', 'bs_' || bs, id FROM parts)"""
CLEANED = """, clean AS (SELECT * FROM blocks WHERE (kind, block_key) IN (SELECT (kind, block_key) FROM blocks GROUP BY kind, block_key HAVING count(*) <= 2))"""


@query(f"WITH {PARTS}, {PART_BLOCKS} SELECT * FROM blocks")
def block_generate(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.generate_blocks(parts(spark, sf), PART)


@query(f"WITH {PARTS}, {PART_BLOCKS}{CLEANED} SELECT * FROM clean")
def block_clean(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.clean_blocks(blocking.generate_blocks(parts(spark, sf), PART), 2)


@query(f"WITH {PARTS}, {PART_BLOCKS}{CLEANED} SELECT * FROM clean UNION ALL SELECT 'weak', 'singular_ad_' || CAST(id AS VARCHAR), id FROM parts WHERE id NOT IN (SELECT record_id FROM clean)")
def block_complete(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.blocking_scheme(parts(spark, sf), PART, 2)


@query("SELECT 'weak' AS kind, 'All' AS block_key, p_partkey AS record_id FROM part")
def block_single(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.blocking_scheme(parts(spark, sf), PART, single_block=True)


@query(f"WITH {PARTS}, {PART_BLOCKS} SELECT count(DISTINCT kind || ':' || block_key) AS n_blocks FROM blocks")
def block_count(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.number_of_blocks(blocking.generate_blocks(parts(spark, sf), PART))


def part_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All blocks, whatever their size: nothing is cleaned away as tables grow."""
    return blocking.generate_blocks(parts(spark, sf), PART, ("strong",))


@query(f"WITH {PARTS} SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM parts a JOIN parts b ON a.bs = b.bs AND a.id < b.id WHERE a.bs IN (SELECT bs FROM parts GROUP BY bs HAVING count(*) <= 50)")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The limit on blocks is what is asked for here, and in the SQL."""
    return blocking.candidate_pairs(blocking.clean_blocks(blocking.generate_blocks(parts(spark, sf), PART, ("strong",)), 50))


# Pair features


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.with_records(near_parts(spark, sf), parts(spark, sf))


@query(f"WITH {PART_PAIRS} SELECT id_a, id_b, CASE WHEN len(a_sizes) > 0 AND len(b_sizes) > 0 THEN len(list_intersect(a_sizes, b_sizes)) > 0 END AS value FROM pp")
def pf_binary_match(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id_a", "id_b", sim.binary_match(F.col("a.f_size"), F.col("b.f_size")).alias("value"))


@query(f"WITH {PART_PAIRS} SELECT id_a, id_b, {N_WORDS} AS value FROM pp")
def pf_number_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id_a", "id_b", sim.number_matches(F.col("a.f_words"), F.col("b.f_words")).cast("bigint").alias("value"))


@query(f"WITH {PART_PAIRS} SELECT id_a, id_b, {SIZE_DIFF} AS value FROM pp")
def pf_numerical_difference(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id_a", "id_b", sim.numerical_difference(F.col("a.f_size"), F.col("b.f_size")).alias("value"))


@query(f"WITH {PART_PAIRS} SELECT id_a, id_b, (SELECT min(levenshtein(x, y)) FROM (SELECT unnest(a_words) AS x) u, (SELECT unnest(b_words) AS y) v) AS value FROM pp")
def pf_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id_a", "id_b", sim.levenshtein(F.col("a.f_words"), F.col("b.f_words")).cast("bigint").alias("value"))


ORDER_DATES = "d AS (SELECT o_custkey AS id, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 37 % 86400 AS s FROM orders)"


def _order_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    stamp = o["o_orderdate"].cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") * 37 % 86400)
    dates = o.groupBy(F.col("o_custkey").alias("record_id")).agg(F.array_sort(F.collect_set(stamp.cast("timestamp_ntz"))).alias("f_dates"))
    nxt = dates.select((F.col("record_id") + 1).alias("id_b"), F.col("record_id").alias("id_a"))
    return pairs.with_records(nxt, dates)


@query(f"WITH {ORDER_DATES} SELECT a.id AS id_a, b.id AS id_b, min(((a.s - b.s) % 86400 + 86400) % 86400) AS value FROM d a JOIN d b ON b.id = a.id + 1 GROUP BY 1, 2")
def pf_date_difference(spark: SparkSession, sf: str) -> DataFrame:
    return _order_dates(spark, sf).select("id_a", "id_b", sim.date_difference(F.col("a.f_dates"), F.col("b.f_dates")).alias("value"))


@query(f"WITH {ORDER_DATES} SELECT a.id AS id_a, b.id AS id_b, min(abs(a.s - b.s)) AS value FROM d a JOIN d b ON b.id = a.id + 1 GROUP BY 1, 2")
def pf_date_difference_total(spark: SparkSession, sf: str) -> DataFrame:
    return _order_dates(spark, sf).select("id_a", "id_b", sim.date_difference_total(F.col("a.f_dates"), F.col("b.f_dates")).alias("value"))


WEAK_SQL = f"""SELECT id_a, id_b, CAST(a_brand <> b_brand AS INT)::DOUBLE AS x_brand, {SIZE_DIFF}::DOUBLE AS x_size, round(ln(exp(1) + levenshtein(a_name, b_name)), {R}) AS x_name,
round(exp(-{N_WORDS}::DOUBLE), {R}) AS x_words, round(abs(a_price - b_price), {R}) AS x_price, a_bs = b_bs AS strong FROM pp"""


def _weak(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.weak_features(near_parts(spark, sf), parts(spark, sf), PART)


@query(f"WITH {PART_PAIRS} {WEAK_SQL}")
def weak_feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    names = pairs.weak_names(PART)
    return _weak(spark, sf).select("id_a", "id_b", *[F.round(n, R).alias(n) for n in names], "strong")


@query("SELECT a.id AS id_a, b.id AS id_b, a.bal = b.bal OR a.grp = b.grp AS strong FROM "
       + " JOIN ".join(f"(SELECT c_custkey AS id, floor(c_acctbal) AS bal, CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_custkey / 7) AS BIGINT) AS VARCHAR) AS grp FROM customer) {x}" for x in "ab")
       + " ON b.id = a.id + 1")
def strong_match(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    ids = c.select(F.col("record_id").alias("id_a"), (F.col("record_id") + 1).alias("id_b"))
    return pairs.weak_features(ids, c, [f for f in CUSTOMER if f.strength == "strong"]).select("id_a", "id_b", "strong")


@query(f"WITH {PART_PAIRS}, w AS ({WEAK_SQL}), m AS (SELECT coalesce(avg(x_size), 0) AS s FROM w) SELECT id_a, id_b, round(coalesce(x_size, s), {R}) AS x_size FROM w, m")
def mean_imputation(spark: SparkSession, sf: str) -> DataFrame:
    w = _weak(spark, sf).select("id_a", "id_b", "x_size")
    return pairs.impute(w, pairs.column_means(w, ["x_size"])).withColumn("x_size", F.round("x_size", R))


@query(f"WITH {PART_PAIRS} SELECT id_a, id_b, CAST(a_brand = b_brand AS INT) AS y, round(exp(-{N_WORDS}::DOUBLE), {R}) AS x_words FROM pp")
def pair_matrix(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("cluster_id"))
    found, _ = pairs.pair_matrix(parts(spark, sf), labels, near_parts(spark, sf), PART, fill=False)
    return found.select("id_a", "id_b", "y", F.round("x_words", R).alias("x_words"))


@query(f"WITH {PART_PAIRS} SELECT id_a, id_b, CAST(min(id_b - id_a) AS BIGINT) AS x FROM pp GROUP BY 1, 2")
def precomputed_features(spark: SparkSession, sf: str) -> DataFrame:
    near = near_parts(spark, sf)
    known = near.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), (F.col("id_b") - F.col("id_a")).alias("x"))
    return pairs.merge_precomputed(near, parts(spark, sf), known)


SEED_SQL = """WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), c AS (SELECT CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS p, CAST(sum(n) * (sum(n) - 1) / 2 AS DOUBLE) AS t FROM s),
d AS (SELECT CASE WHEN p / t < 0.5 THEN p ELSE t - p END AS m FROM c), e AS (SELECT m, least(1.0, 5000 / m) AS k FROM d)
SELECT CAST(floor(m * k) AS BIGINT) AS positives, CAST(floor(m * k) AS BIGINT) AS negatives FROM e"""


@query(SEED_SQL)
def pair_seed_counts(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    row = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"), F.sum("n").alias("n")).first()
    p, n = pairs.seed_counts(row["p"], row["n"] * (row["n"] - 1) / 2 - row["p"], 0.5)
    return spark.range(1).select(F.lit(p).cast("bigint").alias("positives"), F.lit(n).cast("bigint").alias("negatives"))


@query()
def pair_seed(spark: SparkSession, sf: str) -> DataFrame:
    labels = clustering.strong_cluster(customers(spark, sf), CUSTOMER)
    return pairs.pair_seed(customers(spark, sf), labels, CUSTOMER, 0.5)


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def cluster_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return pairs.cluster_pairs(e.select(F.col("vec_id").alias("record_id"), F.col("label").alias("cluster_id")))


# Clusters


@query(component_sql(TOKEN_EDGES.format(CUSTOMER_TOKENS), "SELECT c_custkey AS id FROM customer"))
def strong_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.strong_cluster(customers(spark, sf), CUSTOMER)


DOC_EDGES = "SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY text) AS dst FROM documents"


@query(component_sql(DOC_EDGES, "SELECT doc_id AS id FROM documents", "id, component"))
def connected_components_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    least = d.groupBy("h").agg(F.min("doc_id").alias("dst"))
    return connected_components(d.join(least, "h").select(F.col("doc_id").alias("src"), "dst"))


LINE_EDGES = "SELECT DISTINCT l_orderkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem"


@query(f"""WITH RECURSIVE e AS ({LINE_EDGES}), near_ AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e),
l(id, c, r) AS (SELECT DISTINCT src, src, 0 FROM near_ UNION ALL SELECT near_.dst, min(l.c), l.r + 1 FROM l JOIN near_ ON near_.src = l.id WHERE l.r < 40 GROUP BY near_.dst, l.r)
SELECT id, c AS component FROM l WHERE r = 40""")
def bipartite_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and parts, linked by line items. The SQL spreads the least id over 40 links, more than any two are apart."""
    rows = table(spark, sf, "lineitem")
    return connected_components(rows.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")))


@query("SELECT min(p_partkey) AS record_id, list_sort(list(p_partkey)) AS members, list_sort(list_distinct(list(p_name))) AS names FROM part GROUP BY p_brand, p_size")
def merge_records(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    first = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("cluster_id"))
    groups = p.join(first, ["p_brand", "p_size"]).select(F.col("p_partkey").alias("record_id"), "cluster_id")
    return clustering.merge_by(parts(spark, sf), groups, PART).select("record_id", "members", F.col("f_name").alias("names"))


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that carry the next customer's id as well where their key divides by 3 or 4."""
    c = customers(spark, sf)
    more = F.when((F.col("record_id") % 3 == 0) | (F.col("record_id") % 4 == 0), F.array("record_id", F.col("record_id") + 1)).otherwise(F.col("members"))
    return c.withColumn("members", more)


ENTITY_EDGES = "SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer WHERE (c_custkey % 3 = 0 OR c_custkey % 4 = 0) AND c_custkey + 1 IN (SELECT c_custkey FROM customer)"


@query("SELECT cluster_id AS record_id, list_sort(list(record_id)) AS merged FROM (" + component_sql(ENTITY_EDGES, "SELECT c_custkey AS id FROM customer") + ") GROUP BY cluster_id")
def merge_duplicated(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("m"))
    merged = clustering.merge_duplicated(_entities(spark, sf), CUSTOMER)
    known = merged.select("record_id", F.explode("members").alias("m")).join(ids, "m", "left_semi")
    return known.groupBy("record_id").agg(F.array_sort(F.collect_set("m")).alias("merged"))


@query("SELECT o_orderkey AS record_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cluster_id FROM orders")
def labels_of_entities(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("members"))
    return clustering.labels_of(orders)


@query("SELECT c_custkey AS record_id, c_mktsegment AS poster_id, cluster_id FROM customer JOIN (" + component_sql(TOKEN_EDGES.format(CUSTOMER_TOKENS), "SELECT c_custkey AS id FROM customer") + ") ON c_custkey = record_id")
def cluster_and_dump(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return clustering.cluster_table(c, clustering.strong_cluster(c, CUSTOMER), "f_seg")


# Metrics: true clusters are brands, predicted ones types

CELLS = """c AS (SELECT p_brand AS t, p_type AS p, count(*) AS n FROM part GROUP BY 1, 2), ct AS (SELECT t, sum(n) AS n_t FROM c GROUP BY t), cp AS (SELECT p, sum(n) AS n_p FROM c GROUP BY p),
x AS (SELECT t, p, CAST(n AS DOUBLE) AS n, CAST(n_t AS DOUBLE) AS n_t, CAST(n_p AS DOUBLE) AS n_p FROM c JOIN ct USING (t) JOIN cp USING (p)), s AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM part)"""


def _labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "record_id")
    return p.select("record_id", F.col("p_brand").alias("cluster_id")), p.select("record_id", F.col("p_type").alias("cluster_id"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cells(*_labels(spark, sf))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(F.col(n).cast("double"), R).alias(n) for n in (names or df.columns)])


@query(f"WITH {CELLS} SELECT t, p, CAST(n AS BIGINT) AS n, CAST(n_t AS BIGINT) AS n_t, CAST(n_p AS BIGINT) AS n_p FROM x")
def metrics_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf)


PAIRWISE = f"""WITH {CELLS}, b AS (SELECT sum(n * (n - 1) / 2) AS i FROM x), tp AS (SELECT sum(n_t * (n_t - 1) / 2)::DOUBLE AS v FROM ct), pp AS (SELECT sum(n_p * (n_p - 1) / 2)::DOUBLE AS v FROM cp)"""


@query(PAIRWISE + f" SELECT round(i / pp.v, {R}) AS precision, round(i / tp.v, {R}) AS recall, round(2 * i / (pp.v + tp.v), {R}) AS f1, i AS intersection, pp.v AS pred_pairs, tp.v AS true_pairs FROM b, tp, pp")
def metrics_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.pairwise(_cells(spark, sf)))


@query(f"""WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS t, min(doc_id) OVER (PARTITION BY text, lang) AS p FROM documents),
ts AS (SELECT DISTINCT list_sort(list(doc_id)) AS m FROM d GROUP BY t), ps AS (SELECT DISTINCT list_sort(list(doc_id)) AS m FROM d GROUP BY p), k AS (SELECT count(*)::DOUBLE AS same FROM ts JOIN ps USING (m))
SELECT round(same / (SELECT count(*) FROM ps), {R}) AS precision, round(same / (SELECT count(*) FROM ts), {R}) AS recall, round(2 * same / ((SELECT count(*) FROM ps) + (SELECT count(*) FROM ts)), {R}) AS f1 FROM k""")
def metrics_cluster(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "lang", F.md5("text").alias("h"))
    t = d.select("record_id", F.col("h").alias("cluster_id"))
    return _rounded(metrics.exact_clusters(metrics.cells(t, d.select("record_id", F.concat("h", "lang").alias("cluster_id")))))


@query(f"""WITH {CELLS}, j AS (SELECT t, p, n / (n_t + n_p - n) AS j FROM x), a AS (SELECT avg(m) AS v FROM (SELECT max(j) AS m FROM j GROUP BY p)), b AS (SELECT avg(m) AS v FROM (SELECT max(j) AS m FROM j GROUP BY t))
SELECT round(a.v, {R}) AS precision, round(b.v, {R}) AS recall, round(2 * a.v * b.v / (a.v + b.v), {R}) AS f1 FROM a, b""")
def metrics_closest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.closest_clusters(_cells(spark, sf)))


@query(f"""WITH {CELLS} SELECT round(sum(n * n / n_t) / total, {R}) AS aap, round(sum(n * n / n_p) / total, {R}) AS acp, round(sqrt(sum(n * n / n_t) * sum(n * n / n_p)) / total, {R}) AS k,
round((SELECT sum(m) FROM (SELECT max(n) AS m FROM x GROUP BY p)) / total, {R}) AS purity FROM x, s GROUP BY total""")
def metrics_purities(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.purities(_cells(spark, sf)))


INFO = f"""WITH {CELLS}, m AS (SELECT sum(n / total * ln(n * total / (n_t * n_p))) AS mi FROM x, s), ht AS (SELECT -sum(n_t / total * ln(n_t / total)) AS v FROM ct, s), hp AS (SELECT -sum(n_p / total * ln(n_p / total)) AS v FROM cp, s)"""


@query(INFO + f""" SELECT round(mi, {R}) AS mutual_information, round(ht.v, {R}) AS entropy_true, round(hp.v, {R}) AS entropy_pred, round(ht.v + hp.v - 2 * mi, {R}) AS variation,
round(mi / ht.v, {R}) AS homogeneity, round(mi / hp.v, {R}) AS completeness, round(2 * mi / (ht.v + hp.v), {R}) AS v_measure FROM m, ht, hp""")
def metrics_information(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.information(_cells(spark, sf)))


@query("SELECT size, count(*) AS occurrences FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size")
def metrics_entity_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.entity_sizes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("cluster_id")))


@query(f"SELECT round(sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2), {R}) AS class_balance FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def metrics_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.class_balance(table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("cluster_id"))))


@query(PAIRWISE + f", a AS (SELECT total * (total - 1) / 2 AS n FROM s) SELECT round(pp.v - i, {R}) AS split_cost, 0.0::DOUBLE AS merge_cost, round(pp.v - i, {R}) AS distance FROM b, pp, a")
def metrics_gmd_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.merge_distance(_cells(spark, sf), metrics.product, metrics.nothing))


@query(PAIRWISE + f" SELECT 0.0::DOUBLE AS split_cost, round(tp.v - i, {R}) AS merge_cost, round(tp.v - i, {R}) AS distance FROM b, tp")
def metrics_gmd_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.merge_distance(_cells(spark, sf), metrics.nothing, metrics.product))


@query(INFO + f" SELECT round(ht.v + hp.v - 2 * mi, 4) AS distance FROM m, ht, hp")
def metrics_gmd_vi(spark: SparkSession, sf: str) -> DataFrame:
    n = float(table(spark, sf, "part").count())
    cost = metrics.entropy_cost(n)
    return metrics.merge_distance(_cells(spark, sf), cost, cost).select(F.round("distance", 4).alias("distance"))


@query("SELECT p_brand AS cluster_id, list_sort(list(p_partkey)) AS members FROM part GROUP BY p_brand")
def metrics_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.clusters(_labels(spark, sf)[0])


# Curves and bounds: the score of a document is a function of its length

SCORES = "sc AS (SELECT (n_chars % 97) / 100.0::DOUBLE AS score, CASE WHEN n_chars % 97 >= 40 AND doc_id % 3 > 0 OR quality = 0 THEN 1 ELSE 0 END AS label FROM documents JOIN labels USING (doc_id))"
CURVE = f"""{SCORES}, g AS (SELECT score AS prob, sum(label) AS pos, count(*) AS n FROM sc GROUP BY score), al AS (SELECT sum(pos)::DOUBLE AS positives, sum(n)::DOUBLE AS total FROM g),
r AS (SELECT prob, sum(pos) OVER (ORDER BY prob DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY prob DESC)::DOUBLE AS picked FROM g),
curve AS (SELECT prob, false AS "end", tp, picked - tp AS fp, tp / picked AS precision, tp / positives AS recall, (picked - tp) / (total - positives) AS fpr, picked, positives FROM r, al
UNION ALL SELECT 1.0, true, 0, 0, 1.0, 0.0, 0.0, 1, positives FROM al)"""


def _w(p: str, n: str, sign: str) -> str:
    return f"round(({p} + 3.8416 / (2 * {n}) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n}), {R})"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    label = F.when(((F.col("n_chars") % 97 >= 40) & (F.col("doc_id") % 3 > 0)) | (F.col("quality") == 0), 1).otherwise(0)
    return d.select(((F.col("n_chars") % 97) / 100.0).alias("score"), label.alias("label"))


@query(f"""WITH {CURVE} SELECT prob, "end", CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, {R}) AS precision, round(recall, {R}) AS recall, round(fpr, {R}) AS fpr,
round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, {R}) AS f1 FROM curve""")
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    c = roc.roc_curve(_scored(spark, sf))
    return c.select("prob", "end", "tp", "fp", *[F.round(n, R).alias(n) for n in ("precision", "recall", "fpr", "f1")])


@query(f"""WITH {CURVE} SELECT prob, "end", {_w("precision", "picked", "-")} AS precision_lo, {_w("precision", "picked", "+")} AS precision_hi, {_w("recall", "positives", "-")} AS recall_lo, {_w("recall", "positives", "+")} AS recall_hi FROM curve""")
def wilson_ci(spark: SparkSession, sf: str) -> DataFrame:
    c = roc.roc_curve(_scored(spark, sf))
    return c.select("prob", "end", *[F.round(n, R).alias(n) for n in ("precision_lo", "precision_hi", "recall_lo", "recall_hi")])


@query(f"""WITH {SCORES}, rk AS (SELECT label, (rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) / 2.0 - 0.5)::DOUBLE AS r FROM sc)
SELECT round((sum(r * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), {R}) AS auc FROM rk""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(roc.auc(_scored(spark, sf)))


@query(f"""WITH {CURVE} SELECT round(recall, {R}) AS recall FROM curve WHERE prob >= 0.555 ORDER BY prob, "end" LIMIT 1""")
def recall_at(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(roc.recall_at(roc.roc_curve(_scored(spark, sf)), 0.555), "recall")


@query(f"""WITH {CURVE} SELECT round(precision, {R}) AS precision FROM curve WHERE prob <= 0.555 ORDER BY prob DESC LIMIT 1""")
def precision_at(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(roc.precision_at(roc.roc_curve(_scored(spark, sf)), 0.555), "precision")


@query(f"WITH {SCORES} SELECT round(avg(label), {R}) AS class_balance FROM sc")
def class_share(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(roc.class_share(_scored(spark, sf)))


@query(f"""WITH {CURVE} SELECT prob, round(CASE WHEN 0.5 - 0.05 - 0.5 * precision + 0.1 * precision <> 0 THEN 0.5 * 0.1 * precision / (0.5 - 0.05 - 0.5 * precision + 0.1 * precision) END, {R}) AS precision FROM curve WHERE NOT "end" """)
def rebalance_precision(spark: SparkSession, sf: str) -> DataFrame:
    c = roc.roc_curve(_scored(spark, sf)).where("not end")
    return c.select("prob", F.round(roc.rebalance_precision(F.col("precision"), F.lit(0.5), F.lit(0.1)), R).alias("precision"))


@query(f"""WITH {CURVE}, q AS (SELECT precision AS p FROM curve WHERE prob <= 0.5 ORDER BY prob DESC LIMIT 1), e AS (SELECT vec_id, label FROM embeddings),
w AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN (a.vec_id + b.vec_id) % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT round(0.5 * 0.1 * p / (0.5 - 0.05 - 0.5 * p + 0.1 * p) * d / n, {R}) AS precision FROM q, w""")
def precision_lower_bound(spark: SparkSession, sf: str) -> DataFrame:
    p = roc.precision_at(roc.roc_curve(_scored(spark, sf)), 0.5).select("precision")
    direct = cluster_pairs(spark, sf).select(((F.col("id_a") + F.col("id_b")) % 3 == 0).alias("direct"))
    return _rounded(roc.precision_bound(direct, p, 0.5, 0.1))


# MinHash

TOKENS_SQL = "tk AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(replace(text, chr(10), ' ')), ' '), lambda x: x <> ''))) AS token FROM documents), h AS (SELECT doc_id, CAST(concat('0x', substr(sha1(token), 1, 7)) AS BIGINT) AS h FROM tk)"
SIG_SQL = f"{TOKENS_SQL}, sg AS (SELECT doc_id, [" + ", ".join(f"min((h * {a} + {b}) % {lsh.PRIME})" for a, b in lsh.family()) + "] AS signature FROM h GROUP BY doc_id)"
JACCARD = f"len(list_filter(list_zip(a.signature, b.signature), lambda z: z[1] = z[2])) / {lsh.PERMUTATIONS}.0::DOUBLE"


def _band_sql(t: float, sig: str = SIG_SQL) -> str:
    parts_ = [f"SELECT doc_id, {k} AS band_no, sha1(array_to_string(signature[{at}:{at + n - 1}], ',')) AS band_hash FROM sg" for k, (at, n) in enumerate(lsh.bands(lsh.PERMUTATIONS, t))]
    return f"{sig}{', ' if sig else ''}bd AS ({' UNION ALL '.join(parts_)})"


def _link_sql(t: float, sig: str = SIG_SQL) -> str:
    candidates = "SELECT DISTINCT x.doc_id AS id_a, y.doc_id AS id_b FROM bd x JOIN bd y USING (band_no, band_hash) WHERE x.doc_id < y.doc_id"
    return f"{_band_sql(t, sig)}, cd AS ({candidates}), jc AS (SELECT id_a, id_b, {JACCARD} AS jaccard FROM cd JOIN sg a ON a.doc_id = id_a JOIN sg b ON b.doc_id = id_b)"


def _cluster_sql(t: float, sig: str = SIG_SQL) -> str:
    return component_sql(f"WITH {_link_sql(t, sig)} SELECT id_a AS src, id_b AS dst FROM jc WHERE jaccard >= {t}", "SELECT doc_id AS id FROM documents")


BAND_SQL, LINK_SQL, CLUSTER_SQL = _band_sql(0.7), _link_sql(0.7), _cluster_sql(0.7)
STEPS = lsh.thresholds(0.5, 1.0, 30)
SWEEP_SQL = f"WITH {SIG_SQL.replace('sg AS (', 'sg AS MATERIALIZED (')} " + " UNION ALL ".join(f"SELECT {t!r}::DOUBLE AS threshold, record_id, cluster_id FROM ({_cluster_sql(t, '')})" for t in STEPS)
SUMMARY_SQL = f"""WITH {SIG_SQL}, cl AS MATERIALIZED (SELECT * FROM ({CLUSTER_SQL})), e AS (SELECT x.cluster_id, count(*) AS edges FROM cl x JOIN cl y ON x.cluster_id = y.cluster_id AND x.record_id < y.record_id
JOIN sg a ON a.doc_id = x.record_id JOIN sg b ON b.doc_id = y.record_id WHERE {JACCARD} >= 0.7 GROUP BY 1) SELECT cl.cluster_id, count(*) AS size, coalesce(max(edges), 0) AS edges FROM cl LEFT JOIN e USING (cluster_id) GROUP BY 1"""


def _doc_signatures(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return lsh.signatures(d.select("doc_id", annotated.tokens(F.col("text")).alias("tokens")))


@query(f"WITH {SIG_SQL} SELECT * FROM sg")
def minhash_signature(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_signatures(spark, sf)


@query(f"WITH {BAND_SQL} SELECT * FROM bd")
def lsh_bands(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.band_hashes(_doc_signatures(spark, sf), 0.7)


@query(f"WITH {LINK_SQL} SELECT * FROM cd")
def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.candidates(lsh.band_hashes(_doc_signatures(spark, sf), 0.7))


@query(f"WITH {LINK_SQL} SELECT * FROM jc")
def minhash_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    sigs = Scratch(spark, "sigs").keep(_doc_signatures(spark, sf))
    return lsh.with_jaccard(lsh.candidates(lsh.band_hashes(sigs, 0.7)), sigs)


@query(CLUSTER_SQL)
def minhash_clusters(spark: SparkSession, sf: str) -> DataFrame:
    sigs = Scratch(spark, "sigs").keep(_doc_signatures(spark, sf))
    return lsh.minhash_clusters(sigs, 0.7)


@query(SWEEP_SQL)
def minhash_sweep(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", annotated.tokens(F.col("text")).alias("tokens"))
    return lsh.sweep(d, STEPS)


@query(SUMMARY_SQL)
def minhash_cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    sigs = Scratch(spark, "sigs").keep(_doc_signatures(spark, sf))
    return lsh.cluster_summary(lsh.minhash_clusters(sigs, 0.7), sigs, 0.7)


MATCH_AUC_SQL = f"""WITH {SIG_SQL}, cl AS MATERIALIZED (SELECT * FROM ({CLUSTER_SQL}) WHERE record_id IN (SELECT doc_id FROM sg)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(CAST(record_id AS VARCHAR) || ':0'), record_id) AS r FROM cl),
hd AS (SELECT cluster_id, min(CASE WHEN r = 1 THEN record_id END) AS a, min(CASE WHEN r = 2 THEN record_id END) AS b FROM rk GROUP BY cluster_id),
kk AS (SELECT *, row_number() OVER o - 1 AS k, lead(a) OVER o AS c FROM hd WINDOW o AS (ORDER BY md5(CAST(cluster_id AS VARCHAR) || ':0'), cluster_id)),
tr AS (SELECT a, b, c FROM kk WHERE k % 2 = 0 AND b IS NOT NULL AND c IS NOT NULL), pr AS (SELECT a AS id_a, b AS id_b, 1 AS y FROM tr UNION ALL SELECT a, c, 0 FROM tr),
sc AS (SELECT y, {JACCARD} AS s FROM pr JOIN sg a ON a.doc_id = id_a JOIN sg b ON b.doc_id = id_b)
SELECT round(sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), {R}) AS auc FROM sc p, sc n WHERE p.y = 1 AND n.y = 0"""


@query(MATCH_AUC_SQL)
def minhash_match_auc(spark: SparkSession, sf: str) -> DataFrame:
    sigs = Scratch(spark, "sigs").keep(_doc_signatures(spark, sf))
    return _rounded(lsh.match_auc(lsh.minhash_clusters(sigs, 0.7), sigs))


# Samples


@query("WITH r AS (SELECT c_custkey AS record_id, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':0'), c_custkey) AS k FROM customer) SELECT record_id, k <= 100 AS sampled FROM r")
def sample_split(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"))
    taken, rest = sampling.sample_and_remove(c, 100)
    return taken.withColumn("sampled", F.lit(True)).union(rest.withColumn("sampled", F.lit(False)))


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':0'), vec_id) AS r FROM embeddings),
h AS (SELECT label, min(CASE WHEN r = 1 THEN vec_id END) AS a, min(CASE WHEN r = 2 THEN vec_id END) AS b FROM r GROUP BY label),
k AS (SELECT *, row_number() OVER w - 1 AS k, lead(a) OVER w AS c FROM h WINDOW w AS (ORDER BY md5(CAST(label AS VARCHAR) || ':0'), label))
SELECT a, b, c FROM k WHERE k % 2 = 0 AND b IS NOT NULL AND c IS NOT NULL""")
def triplets(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.triplets(table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("label").alias("cluster_id")))


@query("""WITH s AS (SELECT o_custkey AS cluster_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <= 100),
b AS (SELECT cluster_id, coalesce(sum(n) OVER (ORDER BY md5(CAST(cluster_id AS VARCHAR) || ':0'), cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT o_orderkey AS record_id, o_custkey AS cluster_id FROM orders WHERE o_custkey IN (SELECT cluster_id FROM b WHERE before < 500)""")
def sample_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_clusters(table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("cluster_id")), 500)


@query()
def synthetic_records(spark: SparkSession, sf: str) -> DataFrame:
    records, labels = sampling.synthetic(spark, 50, 4, 3)
    records, labels = sampling.add_entities(records, labels, 10, 2)
    return sampling.corrupt(records, 0.001).join(labels, "record_id")


@query()
def synthetic_text(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.corrupted_tokens(spark, 10_000, 10, 0.3)


# Match functions and resolution


def _learn(spark: SparkSession, sf: str, kind) -> tuple:
    records = Scratch(spark, "parts").keep(parts(spark, sf))
    labels = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("cluster_id"))
    seed = Scratch(spark, "seed").keep(pairs.pair_seed(records, labels, PART, 0.5, direct=False))
    return records, labels, seed, kind(records, labels, seed, PART, 0.5)


def _scores(spark: SparkSession, sf: str, kind) -> DataFrame:
    records, _, _, match = _learn(spark, sf, kind)
    return match.score_blocks(part_blocks(spark, sf), records)


@query()
def logistic_match(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, matching.LogisticMatch)


@query()
def tree_match(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, matching.TreeMatch)


@query()
def forest_match(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, matching.ForestMatch)


@query()
def match_roc(spark: SparkSession, sf: str) -> DataFrame:
    records, labels, seed, match = _learn(spark, sf, matching.LogisticMatch)
    return match.test(records, labels, seed)


NEAR_RULE = 1.0  # parts of one brand and size whose names share a word


def _rule() -> matching.RuleMatch:
    return matching.RuleMatch(PART, F.when((F.col("x_words") < 1) & (F.col("x_brand") == 0), 1.0).otherwise(0.0), NEAR_RULE, icar=True)


@query(component_sql(f"WITH {PARTS} SELECT a.id AS src, b.id AS dst FROM parts a JOIN parts b ON a.bs = b.bs AND a.id < b.id WHERE len(list_intersect(a.words, b.words)) > 0", "SELECT p_partkey AS id FROM part"))
def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    records = parts(spark, sf)
    return resolve.weak_components(records, _rule(), blocking.generate_blocks(records, PART, ("strong",)))


@query(component_sql(f"WITH {PARTS} SELECT a.id AS src, b.id AS dst FROM parts a JOIN parts b ON a.bs = b.bs AND a.id < b.id WHERE len(list_intersect(a.words, b.words)) > 0", "SELECT p_partkey AS id FROM part"))
def match_and_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Sharing a word is kept by merging, so the fixpoint is that of components."""
    records = Scratch(spark, "parts").keep(parts(spark, sf))
    blocks = blocking.generate_blocks(records, PART, ("strong",))
    return resolve.resolve(records, _rule(), blocks, PART)[1]


@query()
def supervised_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The whole of it: a forest learns from one half of the parts and resolves the other; metrics against strong clusters."""
    from kindred.plans.experiment import run_pipeline

    records = Scratch(spark, "parts").keep(parts(spark, sf))
    train, test = (records.where(F.col("record_id") % 2 == k) for k in (0, 1))
    return run_pipeline(train, test, PART)[2]


SWEEP = [0.3, 0.5, 0.7]


@query(f"""WITH {PARTS}, sc AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words)))::DOUBLE AS score FROM parts a JOIN parts b ON a.bs = b.bs AND a.id < b.id)
SELECT t AS threshold, count(*) AS n_match FROM sc, (VALUES (0.3::DOUBLE), (0.5), (0.7)) v(t) WHERE score > t GROUP BY t""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a block with the same words meet as one, which counts for all their pairs."""
    met = groups.meet(groups.sliced(groups.block_groups(part_blocks(spark, sf), parts(spark, sf), ["f_words"]), Scratch(spark, "words")))
    scored = groups.first_block(met).select(sim.jaccard(F.col("a.f_words"), F.col("b.f_words")).alias("score"), groups.pair_count().alias("n"))
    each = scored.select("score", "n", F.explode(F.array(*[F.lit(t) for t in SWEEP])).alias("threshold"))
    return each.where("score > threshold").groupBy("threshold").agg(F.sum("n").alias("n_match"))


@query()
def experiment_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from kindred.plans.experiment import synthetic_experiment

    return synthetic_experiment(spark, 100, 10, 10, thresholds=[0.3, 0.7])
