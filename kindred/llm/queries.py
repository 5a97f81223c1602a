"""The opN queries: each operator on its whole table, reduced to the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import license_scan, line_dedup, media, mixing, near_dedup, pieces, quality, toxicity, url_filter, vectors
from kindred.llm.license_texts import DIGESTS, LICENSES
from kindred.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def piece_model() -> str:
    """Where the public tokenizer's file is on this machine; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(table(spark, sf_dir, "embeddings"))


@query
def op3_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store_text(table(spark, sf_dir, "documents")))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("__lines").cast("bigint").alias("n_lines"), F.col("__gone").cast("bigint").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(documents).select("doc_id", "license_digest", "license_id")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    scored = quality.score(documents, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_table(table(spark, sf_dir, "documents"), piece_model())


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), near_dedup.CONTRACT)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies_of_rows(mixing.plan(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def _rule_sql(rules: list[url_filter.Rule], what: str) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block"))
    return "CASE " + " ".join(
        f"WHEN ends_with('.' || host, '.{r.host}') AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in ranked
    )


ORACLES["op1_url_filter"] = f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, {_rule_sql(RULES, "name")} END AS rule, {_rule_sql(RULES, "verdict")} ELSE 'allow' END AS verdict FROM c
"""

_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in LICENSES.items())
_DIGESTS = ", ".join(f"('{k}', '{v}')" for k, v in DIGESTS.items())
ORACLES["op6_license_scan"] = f"""
WITH k AS (SELECT sha256({license_scan.canonical_sql("t")}) AS license_digest, min(license_id) AS license_id
    FROM (VALUES {_VALUES}) v(license_id, t) GROUP BY 1 UNION ALL VALUES {_DIGESTS}),
d AS (SELECT doc_id, sha256({license_scan.canonical_sql("text")}) AS license_digest FROM documents)
SELECT doc_id, license_digest, license_id FROM d LEFT JOIN k USING (license_digest)
"""

ORACLES["op2_embedding_dedup"] = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.dst, reach.c FROM reach JOIN l ON l.src = reach.id),
m AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id), n AS (SELECT src, count(*) AS n_links FROM l GROUP BY src)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM m LEFT JOIN n ON src = id
"""

_SPACE = "[\\x20\\x09-\\x0D]+"
ORACLES["op9_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT src, dst FROM p JOIN n a ON a.doc_id = src JOIN n b ON b.doc_id = dst WHERE 100 * both_ >= 85 * (a.n + b.n - both_)),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.dst, reach.c FROM reach JOIN l ON l.src = reach.id),
m AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM m LEFT JOIN n ON doc_id = id
"""

# One line after another, in order, against those before it that stay.
ORACLES["op5_line_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, i, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT doc_id, i, t, list_filter(string_split_regex(translate(t, '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_SPACE}'), lambda z: z <> '') AS w FROM x),
p AS MATERIALIZED (SELECT *, array_to_string(w, ' ') AS s, row_number() OVER (ORDER BY doc_id, i) AS pos FROM w WHERE len(w) > 0),
u AS MATERIALIZED (SELECT s, min(pos) AS id, any_value(w) AS w FROM p GROUP BY s),
c AS MATERIALIZED (SELECT id, len(w) AS n, j, array_to_string(list_concat(w[:j - 1], w[j + 1:]), ' ') AS v FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS j FROM u WHERE len(w) >= {line_dedup.MIN_WORDS})),
e AS MATERIALIZED (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.v = b.v AND a.j = b.j AND a.n = b.n AND a.id < b.id
    UNION ALL SELECT u.id, c.id FROM u JOIN c ON u.s = c.v WHERE len(u.w) >= {line_dedup.MIN_WORDS})),
k AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT lo AS id FROM e UNION SELECT hi FROM e)),
b AS MATERIALIZED (SELECT k.k, k.id, coalesce(list(o.k) FILTER (WHERE o.k IS NOT NULL), []) AS nb FROM k LEFT JOIN e ON e.hi = k.id LEFT JOIN k o ON o.id = e.lo GROUP BY 1, 2),
step(done, stay) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT done + 1, CASE WHEN list_has_any(stay, nb) THEN stay ELSE list_append(stay, done + 1) END FROM step JOIN b ON b.k = done + 1),
stay AS (SELECT unnest(stay) AS k FROM (SELECT stay FROM step ORDER BY done DESC LIMIT 1)),
gone AS MATERIALIZED (SELECT p.doc_id, p.i FROM p JOIN u USING (s) WHERE p.pos <> u.id OR u.id IN (SELECT id FROM b WHERE k NOT IN (SELECT k FROM stay))),
left_ AS (SELECT x.doc_id, string_agg(t, chr(10) ORDER BY x.i) AS t FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
