"""Queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, fixity, jaccard_join, lattice, mixing, packing, risk_rules, runs, sharding, token_index, topk, url_filter, yinyang
from .common import table


def op1_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op4_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.token_index_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_low_quality", "p_toxic", "quality", "kept")


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit(table(spark, sf_dir, "pages"), fault_every=200)


def op10_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.histogram_top_k(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents"))))


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = yinyang.centroid_clusters(table(spark, sf_dir, "embeddings"))
    digests = [(j, hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest()) for j, row in enumerate(centroids)]
    return found.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").select(*found.columns, "centroid_sha256")


def op13_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_lattice_scores, op2_pareto_mix, op3_jaccard_join, op4_label_propagation_shards, op5_pattern_packing, op6_token_index, op7_risk_controlled_rules, op8_cotraining, op9_merkle_fixity, op10_histogram_top_k, op11_periodic_runs, op12_yinyang_clusters, op13_url_verdicts)}

_NEAREST = """a{r} AS (SELECT rid, vec_id, q, best.j AS j, best.d AS d FROM (SELECT v.rid, v.vec_id, v.q, min({{'d': list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'j': c.j}}) AS best
  FROM v, c{r} c GROUP BY ALL))"""
_ROUND = (
    _NEAREST
    + """,
s{s} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(q) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY j, i),
c{s} AS (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{s} GROUP BY j) m USING (j)),
"""
)

SQL = {
    "op2_pareto_mix": """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
  (source_size * 2)::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
m AS (SELECT source, CAST(floor(log2(size + 1.0::DOUBLE)) AS BIGINT) + 1 AS e, CAST(sum(size) AS BIGINT) AS words FROM sized WHERE size > 0 GROUP BY ALL),
v AS (SELECT m.*, t.target, t.source_size, (t.target - 2 * coalesce(sum(words) OVER (PARTITION BY m.source ORDER BY e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(e * words) OVER (PARTITION BY m.source ORDER BY e DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS part
  FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, max(CASE WHEN target >= 2 * source_size THEN 2.0::DOUBLE ELSE part END) AS level FROM v GROUP BY source),
n AS (SELECT m.source, sum(words * floor(least(2.0::DOUBLE, level * e))) AS given FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source GROUP BY m.source),
q AS (SELECT t.*, coalesce(g.level, 0) AS level, t.target - coalesce(n.given, 0) AS need FROM t LEFT JOIN g ON t.source IS NOT DISTINCT FROM g.source LEFT JOIN n ON t.source IS NOT DISTINCT FROM n.source),
u AS (SELECT d.doc_id, d.size, q.*, least(2.0::DOUBLE, q.level * (floor(log2(d.size + 1.0::DOUBLE)) + 1)) AS expected, (('0x' || substr(md5('17|' || coalesce(d.source, '') || '|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
p AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p FROM u),
x AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
z AS (SELECT *, odds / (1 + odds) AS rank FROM x),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) AS upto, sum(size) OVER (PARTITION BY source, rank) AS tied FROM z WHERE rank IS NOT NULL AND size > 0),
k AS (SELECT source, max(rank) AS cut FROM c WHERE upto - tied / 2 <= need GROUP BY source)
SELECT z.doc_id, z.size, z.source_size, z.target, CAST(z.size * (z.whole + CASE WHEN z.rank <= k.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z LEFT JOIN k ON z.source IS NOT DISTINCT FROM k.source
""",
    "op3_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, string_agg(x, ' ') OVER k AS g, count(*) OVER k AS n FROM e WINDOW k AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE n = 5 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op7_risk_controlled_rules": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
v AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w WHERE len(w) >= 8),
g AS (SELECT rid, i, g FROM (SELECT rid, i, string_agg(x, chr(10)) OVER k AS g, count(*) OVER k AS n FROM v
  WINDOW k AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(8)) AS k) GROUP BY rid),
m AS (SELECT w.doc_id, w.lang, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(w.l) - len(list_distinct(w.l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, greatest(
  n_symbols::DOUBLE / greatest(1, n_words) / 0.5::DOUBLE, n_repeat_words::DOUBLE / greatest(1, n_words) / 0.3::DOUBLE, n_dup_lines::DOUBLE / greatest(1, n_words) / 0.1::DOUBLE) AS badness FROM m),
y AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT b.lang, b.badness, y.good FROM b JOIN y USING (doc_id) WHERE NOT base_failed),
n AS (SELECT lang, count(*) FILTER (WHERE good) AS n FROM h GROUP BY lang),
t AS (SELECT n.lang, n.n, k.i, pow(2::DOUBLE, 6 - k.i) AS cutoff FROM n, (SELECT unnest(range(10)) AS i) k),
q AS (SELECT t.lang, t.n, t.i, t.cutoff, count(*) FILTER (WHERE h.good AND h.badness > t.cutoff) AS hit, count(*) FILTER (WHERE NOT h.good AND h.badness > t.cutoff) AS bad
  FROM t JOIN h ON h.lang IS NOT DISTINCT FROM t.lang GROUP BY ALL),
p AS (SELECT *, CASE WHEN hit > n * 0.03 THEN 1 ELSE list_sum(list_transform(range(0, hit + 1),
  lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.03) + (n - j) * ln(0.97)))) END <= 0.05 / (SELECT count(*) FROM n) AS ok FROM q),
s AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY i) AS certified FROM p),
z AS (SELECT lang, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY bad - 5 * hit DESC, i) AS r FROM s WHERE certified) WHERE r = 1)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  NOT b.base_failed AND coalesce(b.badness <= z.cutoff, true) AS kept
FROM b LEFT JOIN z ON b.lang IS NOT DISTINCT FROM z.lang
""",
    "op10_histogram_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND (b.vec_id IS NULL OR b.vec_id <> a.vec_id))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op11_periodic_runs": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
e AS (SELECT *, len(w) AS n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384::BIGINT * (x & 1)) END)) AS h FROM d),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
x AS (SELECT rid, n, i, array_to_string(w[i + 1:i + 16], ' ') AS k FROM (SELECT *, unnest(range(n - 15)) AS i FROM t WHERE n >= 24)),
m AS (SELECT x.rid, x.i, y.i - x.i AS q FROM x JOIN x y ON x.rid = y.rid AND x.k = y.k AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT rid, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m) GROUP BY rid, q, island),
r AS (SELECT rid, start, length, min(q) AS period FROM s WHERE length >= 24 AND length >= 3 * q GROUP BY rid, start, length),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r) WHERE place = 1),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
o AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
u AS (SELECT rid, i, w[i + 1] AS w FROM (SELECT rid, w, unnest(range(n)) AS i FROM t WHERE rid IN (SELECT rid FROM r))),
c AS (SELECT u.rid, string_agg(u.w, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN o USING (rid, i) WHERE o.rid IS NULL GROUP BY u.rid)
SELECT t.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
  CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(CASE WHEN l.rid IS NULL THEN array_to_string(t.w, ' ') ELSE coalesce(c.kept, '') END) AS collapsed_sha256
FROM t LEFT JOIN l USING (rid) LEFT JOIN b USING (rid) LEFT JOIN c USING (rid)
""",
    "op12_yinyang_clusters": f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS j, q FROM (SELECT *, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, q LIMIT 16)),
{"".join(_ROUND.format(r=r, s=r + 1) for r in range(3))}
{_NEAREST.format(r=3)}
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a3 a JOIN c3 c USING (j)
""",
    "op13_url_verdicts": r"""
WITH RECURSIVE u AS (SELECT row_number() OVER () AS rid, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
seeds AS (SELECT unnest(SEEDS) AS word),
words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '\p{L}{2,}')) AS word FROM u UNION ALL FROM seeds) GROUP BY word),
total AS (SELECT sum(n)::DOUBLE AS total FROM words),
hosts AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
runs AS (SELECT host, generate_subscripts(x, 1) AS place, unnest(x) AS run FROM (SELECT host, regexp_extract_all(host, '\p{L}+|[0-9]+') AS x FROM hosts)),
letters AS (SELECT DISTINCT run FROM runs WHERE NOT regexp_matches(run, '^[0-9]') AND length(run) <= 63),
pieces AS (SELECT DISTINCT run, substr(run, i, k) AS word FROM (SELECT run, i, unnest(range(1, least(24, length(run) - i + 1) + 1)) AS k FROM (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM letters))),
probs AS (SELECT pieces.run, map(list(word), list(ln(n / total))) AS m FROM pieces JOIN words USING (word), total GROUP BY pieces.run),
v AS (SELECT run, 0 AS j, [0.0::DOUBLE] AS score, [''] AS words FROM letters
  UNION ALL
  SELECT run, j, list_append(score, b.s), list_append(words, trim(words[b.i + 1] || ' ' || substr(run, b.i + 1, j - b.i))) FROM (
    SELECT v.run, v.j + 1 AS j, v.score, v.words, list_sort(list_transform(range(greatest(0, v.j - 23), v.j + 1), lambda i: {'r': round(v.score[i + 1] + coalesce(p.m[substr(v.run, i + 1, v.j + 1 - i)], ln(10 / total) - (v.j + 1 - i) * ln(10)), 7),
      'i': i, 's': v.score[i + 1] + coalesce(p.m[substr(v.run, i + 1, v.j + 1 - i)], ln(10 / total) - (v.j + 1 - i) * ln(10))}), 'DESC')[1] AS b
    FROM v LEFT JOIN probs p ON p.run = v.run, total WHERE v.j < length(v.run))),
split AS (SELECT run, words[j + 1] AS words FROM v WHERE j = length(run)),
named AS (SELECT host, flatten(list(string_split(CASE WHEN regexp_matches(runs.run, '^[0-9]') THEN '0' ELSE coalesce(split.words, runs.run) END, ' ') ORDER BY place)) AS words FROM runs LEFT JOIN split USING (run) GROUP BY host),
h AS (SELECT hosts.host, pages, coalesce(words, []) AS words, coalesce(list_has_any(words, SEEDS), false) AS blocked FROM hosts LEFT JOIN named USING (host)),
tokens AS (SELECT rid, h.blocked, unnest(h.words) AS token FROM p JOIN h USING (host)
  UNION SELECT rid, h.blocked, unnest(list_transform(regexp_extract_all(lower(path), '\p{L}+|[0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE x END)) FROM p JOIN h USING (host)),
c AS (SELECT token, count(*) FILTER (WHERE blocked) AS b, count(*) FILTER (WHERE NOT blocked) AS a FROM tokens GROUP BY token),
s AS (SELECT sum(b) AS b, sum(a) AS a, count(*) AS k FROM c),
odds AS (SELECT token, ln((c.b + 0.1::DOUBLE) / (s.b + 0.1::DOUBLE * s.k)) - ln((c.a + 0.1::DOUBLE) / (s.a + 0.1::DOUBLE * s.k)) AS o FROM c, s),
prior AS (SELECT coalesce(sum(pages) FILTER (WHERE blocked), 0) AS b, ln((coalesce(sum(pages) FILTER (WHERE blocked), 0) + 1) / (coalesce(sum(pages) FILTER (WHERE NOT blocked), 0) + 1)) AS o FROM h),
own AS (SELECT rid, sum(o) AS o FROM tokens JOIN odds USING (token) GROUP BY rid)
SELECT page_id, host, path, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN coalesce(own.o, 0) + prior.o > 0 AND prior.b > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN own USING (rid), prior
""".replace("SEEDS", str(list(url_filter.SEEDS))),
}
