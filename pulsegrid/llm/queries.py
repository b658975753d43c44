"""The registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import decontam, descent, jaccard, negatives, packing, phrases, pii, quality, scoring, shards, toxicity, urls, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op1_backoff_scores")
def op1(spark, folder):
    return scoring.score(table(spark, folder, "documents"), order=3)


PLAIN_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?"''()[]{}', 'abcdefghijklmnopqrstuvwxyz              '), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""


@register("op2_spaced_seeds", rf"""
WITH d AS (SELECT doc_id, {PLAIN_SQL} AS w FROM documents),
b AS (SELECT item_id, {PLAIN_SQL} AS w FROM benchmark),
z(k, least, most) AS (VALUES (4, 13, 1000000000), (2, 5, 12)),
dg AS (SELECT doc_id, k, unnest(range(len(w) - k + 1)) AS p, w FROM d, z WHERE len(w) >= k AND EXISTS
  (SELECT 1 FROM b WHERE len(b.w) BETWEEN least AND most)),
bg AS (SELECT item_id, k, unnest(range(len(w) - k + 1)) AS q, w FROM b JOIN z ON len(w) BETWEEN least AND most),
h AS (SELECT DISTINCT doc_id, item_id, p - q AS s FROM (SELECT doc_id, p, array_to_string(w[p+1:p+k], ' ') AS g, k FROM dg) x
  JOIN (SELECT item_id, q, array_to_string(w[q+1:q+k], ' ') AS g, k FROM bg) y USING (g, k)),
e AS (SELECT doc_id, item_id, s, len(b.w) AS n, j,
  CASE WHEN s + j >= 0 AND s + j < len(d.w) AND d.w[greatest(s + j, 0) + 1] = b.w[j + 1] THEN 1 ELSE 0 END AS e
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(len(b.w))) AS o(j)),
m AS (SELECT doc_id, item_id, n, j, sum(e) OVER (PARTITION BY doc_id, item_id, s ORDER BY j ROWS 12 PRECEDING) AS m FROM e)
SELECT doc_id, item_id, max(n) AS item_words, max(m)::BIGINT AS matched FROM m
WHERE j >= least(n, 13) - 1 AND 100 * m >= 80 * least(n, 13) GROUP BY ALL""")
def op2(spark, folder):
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op3_shard_vectors")
def op3(spark, folder):
    return shards.shard(table(spark, folder, "documents"), 24)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine, as on the workers'."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_pack_sequences")
def op4(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"), 2048)


@register("op6_toxicity_trees")
def op6(spark, folder):
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op7_signature_join")
def op7(spark, folder):
    return jaccard.join(table(spark, folder, "documents"))


@register("op8_weak_pii")
def op8(spark, folder):
    return pii.find(table(spark, folder, "documents"))


@register("op9_wavelet_files")
def op9(spark, folder):
    return wavelet.round_trip(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


WORDS = r"[^\x20\x09-\x0D]+"
STOP_SQL = ", ".join(f"'{s}'" for s in sorted({s for w in quality.STOP_WORDS for s in (w, w.capitalize())}))


@register("op5_quality_rules", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORDS}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM d),
x AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS n FROM x),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, unnest(range(0, 8)) AS o(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words,
  len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(l) AS n_lines, len(t) - len(replace(t, '!', '')) AS n_shouts,
  len(list_filter(w, lambda x: x IN ({STOP_SQL}))) AS n_stop
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(n_words >= 20 AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words
  AND n_symbols <= 0.1 * n_words AND n_shouts <= 0.2 * n_words AND n_stop >= 0.03 * n_words
  AND n_dup_lines <= 0.5 * n_lines AND n_repeat_words <= 0.3 * n_words, false) AS kept,
  n_lines, n_shouts, n_stop FROM b""")
def op5(spark, folder):
    return quality.judge(table(spark, folder, "documents"))


@register("op10_url_trie", r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS k FROM pages),
r AS (SELECT page_id, CASE WHEN k > 0 THEN substr(u, k + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id
  ORDER BY len(string_split(rhost, '.')) DESC, len(rpath) DESC) AS n FROM h JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.n = 1""")
def op10(spark, folder):
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


@register("op11_rotated_codes", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
  list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id
  ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10""")
def op11(spark, folder):
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@register("op12_count_transducers", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, m, w[i+1:i+m] AS p FROM w, unnest(range(1, 4)) AS o(m), unnest(range(len(w) - m + 1)) AS s(i) WHERE len(w) >= m),
f AS (SELECT lang, m, p, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r,
  (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score FROM c, unnest(range(1, c.m)) AS o(k)
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k+1:]),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
i AS (SELECT c.lang, c.p[j+1:j+m2] AS p, max(c.f) AS longer FROM c, unnest(range(2, c.m)) AS o(m2), unnest(range(c.m - m2 + 1)) AS s(j)
  GROUP BY ALL),
t AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i USING (lang, p)
  WHERE longer IS NULL OR 100 * longer < 50 * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT z.lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= 2000""")
def op12(spark, folder):
    return phrases.mine(table(spark, folder, "documents"))


@register("op13_neighbour_descent", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)""")
def op13(spark, folder):
    return descent.near(table(spark, folder, "embeddings"))
