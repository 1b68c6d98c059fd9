"""Queries of scans, access control and graph reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, graph, relations
from .model import GRAPH, NODES, edges, nodes, table
from .registry import query

JOBS = ["job1", "job3"]
JOB_SQL = "list_has_any(source_jobs, ['job1', 'job3'])"
SEEN = f"{GRAPH}, vn AS (SELECT * FROM nodes WHERE min_rank <= 100), ve AS (SELECT e.* FROM edges e WHERE min_rank <= 100 AND src_uri IN (SELECT uri FROM vn) AND dst_uri IN (SELECT uri FROM vn)), ud AS (SELECT src_uri AS uri, dst_uri AS other FROM ve UNION ALL SELECT dst_uri, src_uri FROM ve)"


@query(f"WITH {NODES} SELECT uri, name, type FROM nodes WHERE {JOB_SQL}")
def scan_entities_by_jobs(spark, d):
    return nodes(spark, d).filter(access.in_jobs(JOBS)).select("uri", "name", "type")


@query(f"{GRAPH} SELECT x.name AS head, rel_type, y.name AS tail, count(*) AS n FROM edges e JOIN nodes x ON x.uri = src_uri JOIN nodes y ON y.uri = dst_uri WHERE rel_type NOT IN ('CONTAINS', 'SIMILAR_TO') GROUP BY ALL")
def scan_triples(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    e = e.filter(~F.col("rel_type").isin("CONTAINS", "SIMILAR_TO"))
    e = e.join(n.select(F.col("uri").alias("src_uri"), F.col("name").alias("head")), "src_uri").join(n.select(F.col("uri").alias("dst_uri"), F.col("name").alias("tail")), "dst_uri")
    return e.groupBy("head", "rel_type", "tail").agg(F.count("*").alias("n"))


@query(f"{GRAPH} SELECT rel_type, count(*) AS n, sum(confidence) AS confidence FROM (SELECT rel_type, round(confidence, 2)::DECIMAL(10, 2) AS confidence FROM edges) GROUP BY 1")
def join_edge_endpoints(spark, d):
    n = nodes(spark, d).select("uri")
    e = edges(spark, d).join(n.withColumnRenamed("uri", "src_uri"), "src_uri").join(n.withColumnRenamed("uri", "dst_uri"), "dst_uri")
    return e.groupBy("rel_type").agg(F.count("*").alias("n"), F.sum(F.round("confidence", 2).cast("decimal(10,2)")).cast("decimal(38,2)").alias("confidence"))


@query(f"WITH {NODES} SELECT type, count(*) AS n FROM nodes WHERE {JOB_SQL} GROUP BY 1")
def job_scope_filter(spark, d):
    return nodes(spark, d).filter(access.in_jobs(JOBS)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"{SEEN} SELECT src_uri, rel_type, dst_uri FROM ve")
def clearance_filter(spark, d):
    return access.visible_edges(edges(spark, d), nodes(spark, d), 100).select("src_uri", "rel_type", "dst_uri")


def _principals(spark, d):
    c = table(spark, d, "customer")
    principals = c.select(F.col("c_custkey").alias("principal_id"), (F.col("c_custkey") % 4 * 100).cast("int").alias("user_rank"), F.when(F.col("c_custkey") % 3 == 0, F.lit(100)).cast("int").alias("key_rank"), F.when(F.col("c_custkey") % 7 == 0, F.lit(0)).cast("int").alias("override_rank"), (F.col("c_custkey") % 5 == 0).alias("kb_scoped"))
    grants = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("principal_id"), F.concat(F.lit("kb"), (F.col("c_custkey") % 6).cast("string")).alias("compilation_id"), F.when(F.col("c_custkey") % 4 == 0, F.lit(200)).cast("int").alias("granted_rank"))
    return principals, grants


PRINCIPALS = """p AS (SELECT c_custkey AS principal_id, c_custkey % 4 * 100 AS user_rank, CASE WHEN c_custkey % 3 = 0 THEN 100 END AS key_rank, CASE WHEN c_custkey % 7 = 0 THEN 0 END AS override_rank, c_custkey % 5 = 0 AS kb_scoped FROM customer),
g AS (SELECT c_custkey AS principal_id, 'kb' || (c_custkey % 6) AS compilation_id, CASE WHEN c_custkey % 4 = 0 THEN 200 END AS granted_rank FROM customer WHERE c_custkey % 2 = 0)"""


@query(f"""WITH {PRINCIPALS} SELECT p.principal_id, compilation_id, (CASE WHEN compilation_id IS NULL AND kb_scoped THEN -1 WHEN compilation_id IS NULL THEN o WHEN granted_rank IS NULL THEN 2147483647 ELSE greatest(o, granted_rank) END)::INTEGER AS rank
FROM (SELECT *, least(user_rank, coalesce(key_rank, user_rank), coalesce(override_rank, user_rank)) AS o FROM p) p LEFT JOIN g USING (principal_id)""")
def effective_rank(spark, d):
    return access.effective_rank(*_principals(spark, d))


@query(f"WITH {PRINCIPALS} SELECT DISTINCT p.principal_id, unnest(['job' || (right(compilation_id, 1)), 'job7']) AS job FROM p JOIN g USING (principal_id) WHERE kb_scoped")
def kb_scope(spark, d):
    p, g = _principals(spark, d)
    jobs = F.array(F.concat(F.lit("job"), F.right("compilation_id", F.lit(1))), F.lit("job7"))
    return p.filter("kb_scoped").join(g, "principal_id").select("principal_id", F.explode(jobs).alias("job")).distinct()


@query(f"WITH {PRINCIPALS} SELECT principal_id, user_rank::INTEGER AS user_rank FROM p WHERE user_rank <= 100 OR (key_rank IS NULL AND NOT kb_scoped) OR EXISTS (SELECT 1 FROM g WHERE g.principal_id = p.principal_id)")
def visible_compilations(spark, d):
    p, g = _principals(spark, d)
    p = p.join(g.select("principal_id").distinct().withColumn("granted", F.lit(True)), "principal_id", "left")
    return p.filter((F.col("user_rank") <= 100) | (F.col("key_rank").isNull() & ~F.col("kb_scoped")) | F.coalesce("granted", F.lit(False))).select("principal_id", "user_rank")


@query(f"WITH {PRINCIPALS} SELECT compilation_id, count(*) AS members FROM g WHERE principal_id IN (SELECT principal_id FROM p WHERE kb_scoped) GROUP BY 1")
def semi_exists_grant(spark, d):
    p, g = _principals(spark, d)
    return g.join(p.filter("kb_scoped"), "principal_id", "left_semi").groupBy("compilation_id").agg(F.count("*").alias("members"))


@query(f"{GRAPH}, inc AS (SELECT src_uri AS uri, min_rank FROM edges UNION ALL SELECT dst_uri, min_rank FROM edges), r AS (SELECT uri, max(min_rank) AS r FROM inc GROUP BY 1) SELECT lower(name) AS name, max(greatest(n.min_rank, coalesce(r.r, 0)))::INTEGER AS required_rank FROM nodes n LEFT JOIN r USING (uri) GROUP BY 1")
def dossier_required_rank(spark, d):
    e = edges(spark, d)
    around = graph.undirected(e, "min_rank").groupBy("uri").agg(F.max("min_rank").alias("r"))
    return nodes(spark, d).join(around, "uri", "left").groupBy(F.lower("name").alias("name")).agg(F.max(F.greatest("min_rank", F.coalesce("r", F.lit(0)))).cast("int").alias("required_rank"))


@query(f"WITH {NODES} SELECT uri, name, type FROM nodes WHERE contains(lower(name), 'red')")
def entity_search(spark, d):
    return nodes(spark, d).filter(F.contains(F.lower("name"), F.lit("red"))).select("uri", "name", "type")


@query(f"WITH {NODES}, x AS (SELECT uri, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM nodes), y AS (SELECT uri, name, CASE WHEN contains(k, 'suplier00000001') OR contains('suplier00000001', k) THEN 0 ELSE levenshtein(k, 'suplier00000001') END AS distance FROM x) SELECT uri, name, distance::BIGINT AS distance FROM y WHERE distance <= 4 ORDER BY distance, uri LIMIT 3000")
def entity_search_fuzzy(spark, d):
    q = "suplier00000001"
    k = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    distance = F.when(F.contains(k, F.lit(q)) | F.contains(F.lit(q), k), 0).otherwise(F.levenshtein(k, F.lit(q))).cast("long")
    return nodes(spark, d).select("uri", "name", distance.alias("distance")).filter(F.col("distance") <= 1 + len(q) // 5).orderBy("distance", "uri").limit(3000)


@query(f"{GRAPH} SELECT n.uri, count(e.dst_uri) AS n_targets FROM nodes n LEFT JOIN (SELECT src_uri, dst_uri FROM edges WHERE min_rank = 0) e ON e.src_uri = n.uri WHERE n.type = 'part' GROUP BY 1")
def optional_expand(spark, d):
    out = edges(spark, d).filter("min_rank = 0").select(F.col("src_uri").alias("uri"), "dst_uri")
    return nodes(spark, d).filter("type = 'part'").join(out, "uri", "left").groupBy("uri").agg(F.count("dst_uri").alias("n_targets"))


@query(f"{GRAPH}, u AS (SELECT src_uri AS uri, dst_uri AS other, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst_uri, src_uri, 0, 1 FROM edges) SELECT uri, count(DISTINCT other) AS degree, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM u GROUP BY 1")
def degree_centrality(spark, d):
    return graph.degrees(edges(spark, d)).select("uri", "degree", "out_degree", "in_degree")


@query(f"{SEEN} SELECT (SELECT count(*) FROM vn) AS nodes, (SELECT count(*) FROM ve) AS edges")
def graph_counts(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    seen = access.visible_edges(e, n, 100).select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    return access.visible_nodes(n, 100).select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(seen).agg(F.sum("a").cast("long").alias("nodes"), F.sum("b").cast("long").alias("edges"))


@query(f"{GRAPH} SELECT 'entity' AS kind, type AS label, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', rel_type, count(*) FROM edges GROUP BY 2")
def schema_histogram(spark, d):
    kinds = nodes(spark, d).groupBy(F.lit("entity").alias("kind"), F.col("type").alias("label")).agg(F.count("*").alias("n"))
    return kinds.unionByName(edges(spark, d).groupBy(F.lit("relation").alias("kind"), F.col("rel_type").alias("label")).agg(F.count("*").alias("n"))).orderBy(F.desc("n"), "label").limit(50)


@query(f"{GRAPH}, u AS (SELECT src_uri AS uri, rel_type FROM edges UNION ALL SELECT dst_uri, rel_type FROM edges), t AS (SELECT uri, count(*) AS degree FROM u GROUP BY 1) SELECT n.name, n.type, coalesce(degree, 0)::BIGINT AS degree FROM nodes n LEFT JOIN t USING (uri)")
def graph_summary(spark, d):
    degree = graph.undirected(edges(spark, d)).groupBy("uri").agg(F.count("*").alias("degree"))
    return nodes(spark, d).join(degree, "uri", "left").select("name", "type", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


TOP = f"{SEEN}, g AS (SELECT uri, count(*) AS degree FROM ud GROUP BY 1), best AS (SELECT vn.uri, coalesce(degree, 0) AS degree FROM vn LEFT JOIN g USING (uri) ORDER BY 2 DESC, 1 LIMIT 200)"


@query(f"{TOP} SELECT src_uri, rel_type, dst_uri FROM ve WHERE src_uri IN (SELECT uri FROM best) AND dst_uri IN (SELECT uri FROM best)")
def degree_topn_subgraph(spark, d):
    return graph.top_subgraph(nodes(spark, d), edges(spark, d), 200, 100)[1].select("src_uri", "rel_type", "dst_uri")


@query(f"{TOP} SELECT uri, degree::BIGINT AS degree FROM best ORDER BY 2 DESC, 1 LIMIT 50")
def top_entities_by_degree(spark, d):
    return graph.top_subgraph(nodes(spark, d), edges(spark, d), 50, 100)[0].select("uri", F.col("degree").cast("long").alias("degree"))


@query(f"{SEEN}, s AS (SELECT uri FROM vn WHERE type = 'nation'), a AS (SELECT DISTINCT s.uri AS start, other AS uri FROM s JOIN ud USING (uri)), b AS (SELECT DISTINCT start, other AS uri FROM a JOIN ud ON ud.uri = a.uri) SELECT start, uri, min(h)::BIGINT AS hops FROM (SELECT *, 1 AS h FROM a UNION ALL SELECT *, 2 FROM b) WHERE start <> uri GROUP BY ALL")
def neighbors_k(spark, d):
    n = nodes(spark, d)
    return graph.neighbours(n, edges(spark, d), access.visible_nodes(n, 100).filter("type = 'nation'").select("uri"), 2, 100)


@query(f"{SEEN}, s AS (SELECT uri FROM vn WHERE type = 'region'), a AS (SELECT DISTINCT s.uri AS start, other AS uri FROM s JOIN ud USING (uri)), b AS (SELECT DISTINCT start, other AS uri FROM a JOIN ud ON ud.uri = a.uri), h AS (SELECT start, uri, min(h)::BIGINT AS hops FROM (SELECT *, 1 AS h FROM a UNION ALL SELECT *, 2 FROM b) WHERE start <> uri GROUP BY ALL) SELECT start, h.uri, hops, name, type FROM h JOIN vn USING (uri)")
def neighbors_1_2(spark, d):
    n = nodes(spark, d)
    found = graph.neighbours(n, edges(spark, d), access.visible_nodes(n, 100).filter("type = 'region'").select("uri"), 2, 100)
    return found.join(n.select("uri", "name", "type"), "uri").select("start", "uri", "hops", "name", "type")


@query(f"{GRAPH}, se AS (SELECT uri FROM nodes WHERE min_rank <= 100 AND (type IN ('nation', 'supplier') OR contains(name, 'widget'))) SELECT src_uri, rel_type, dst_uri FROM edges WHERE min_rank <= 100 AND src_uri IN (SELECT uri FROM se) AND dst_uri IN (SELECT uri FROM se)")
def subgraph_induced(spark, d):
    """The edges between the nations, suppliers and widgets that rank 100 may see."""
    n = nodes(spark, d)
    chosen = n.filter(F.col("type").isin("nation", "supplier") | F.contains("name", F.lit("widget"))).select("uri")
    return graph.induced(n, edges(spark, d), chosen, 100)[1].select("src_uri", "rel_type", "dst_uri")


@query(f"{SEEN}, t AS (SELECT uri, count(DISTINCT other) AS degree FROM ud GROUP BY 1), x AS (SELECT name, vn.uri, degree, row_number() OVER (ORDER BY degree DESC, name, vn.uri) AS place, count(*) OVER () AS n FROM vn JOIN t USING (uri)) SELECT uri, degree::BIGINT AS degree FROM x WHERE place <= least(25, greatest(1, round_even(n * 0.05, 0)))")
def god_nodes(spark, d):
    n = nodes(spark, d)
    seen = access.visible_edges(edges(spark, d), n, 100)
    degree = graph.undirected(seen).groupBy("uri").agg(F.countDistinct("other").alias("degree")).join(n.select("uri", F.concat_ws("\u0001", "name", "uri").alias("name")), "uri")
    return graph.god_nodes(degree).select("uri", F.col("degree").cast("long").alias("degree"))


@query(f"{GRAPH} SELECT rel_type, count(*) AS n FROM edges WHERE len(list_filter(source_jobs, lambda j: j NOT IN ('job1', 'job3'))) > 0 GROUP BY 1")
def purge_jobs(spark, d):
    return graph.purge_jobs(edges(spark, d), JOBS).groupBy("rel_type").agg(F.count("*").alias("n"))


@query(f"{GRAPH} SELECT type, count(*) AS n FROM nodes WHERE NOT list_has_any(source_jobs, (SELECT list(DISTINCT 'job' || (o_orderkey % 5)) FROM orders)) GROUP BY 1")
def orphan_sweep(spark, d):
    known = table(spark, d, "orders").select(F.concat(F.lit("job"), (F.col("o_orderkey") % 5).cast("string")).alias("job")).distinct()
    member = nodes(spark, d).select("uri", "type", F.explode("source_jobs").alias("job"))
    left = member.join(known, "job", "left_semi").select("uri").distinct()
    return nodes(spark, d).join(left, "uri", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT uri, coalesce(source_jobs, [source_job]) AS source_jobs FROM nodes")
def backfill_membership(spark, d):
    return nodes(spark, d).select("uri", F.coalesce("source_jobs", F.array("source_job")).alias("source_jobs"))


@query(f"{GRAPH} SELECT uri FROM nodes WHERE uri IN (SELECT src_uri FROM edges WHERE min_rank = 0 UNION SELECT dst_uri FROM edges WHERE min_rank = 0) OR type IN ('region', 'nation')")
def prune_isolated(spark, d):
    ends = graph.undirected(edges(spark, d).filter("min_rank = 0")).select("uri").distinct()
    n = nodes(spark, d)
    return n.join(ends, "uri", "left_semi").select("uri").union(n.filter(F.col("type").isin("region", "nation")).select("uri")).distinct()


@query(f"{GRAPH} SELECT rel_type, count(*) AS n FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes s, nodes p WHERE s.type = 'supplier' AND p.type = 'part' AND s.key % 10 = 0 AND e.dst_uri = s.uri AND e.src_uri = p.uri AND p.key % 2 = 0) GROUP BY 1")
def corrected_triple_filter(spark, d):
    n = nodes(spark, d)
    p = n.filter("type = 'part' AND key % 2 = 0").select(F.col("uri").alias("src_uri"))
    s = n.filter("type = 'supplier' AND key % 10 = 0").select(F.col("uri").alias("dst_uri"))
    e = edges(spark, d)
    wrong = e.join(p, "src_uri", "left_semi").join(s, "dst_uri", "left_semi").select("src_uri", "rel_type", "dst_uri")
    return e.join(wrong, ["src_uri", "rel_type", "dst_uri"], "left_anti").groupBy("rel_type").agg(F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT uri, name, min_rank FROM nodes WHERE min_rank <= 100")
def embed_redaction(spark, d):
    n = access.visible_nodes(nodes(spark, d), 100).select("uri", "name", "min_rank", F.col("source_jobs").alias("_jobs"))
    return access.public_columns(n)


@query("SELECT l_shipmode_like AS label, count(*) AS n FROM (SELECT CASE WHEN x = '' THEN 'RELATED_TO' WHEN regexp_matches(x, '^[0-9]') THEN 'REL_' || x ELSE x END AS l_shipmode_like FROM (SELECT trim(regexp_replace(upper(p_type || ' ' || p_size), '[^A-Z0-9]+', '_', 'g'), '_') AS x FROM part)) GROUP BY 1")
def rel_type_sanitize(spark, d):
    return table(spark, d, "part").groupBy(T.rel_type(F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))).alias("label")).agg(F.count("*").alias("n"))


@query(f"{GRAPH}, t AS (SELECT src_uri, count(DISTINCT dst_uri) AS n FROM edges WHERE rel_type = 'SUPPLIED_BY' GROUP BY 1) SELECT src_uri, n FROM t WHERE n > 1")
def distinct_count_having(spark, d):
    return edges(spark, d).filter("rel_type = 'SUPPLIED_BY'").groupBy("src_uri").agg(F.countDistinct("dst_uri").alias("n")).filter("n > 1")


RANKED = f"{GRAPH}, f AS (SELECT *, row_number() OVER (PARTITION BY src_uri ORDER BY source_doc_modified_at DESC NULLS LAST, asserted_at DESC NULLS LAST, confidence DESC, dst_uri) AS place, count(*) OVER (PARTITION BY src_uri) AS n FROM edges WHERE rel_type = 'SUPPLIED_BY')"


def ranked_facts(e):
    return relations.competing(e, "SUPPLIED_BY")


@query(f"{RANKED} SELECT src_uri, dst_uri, place, CASE WHEN place = 1 THEN 'current' ELSE 'superseded' END AS authority FROM f WHERE n > 1")
def authority_rank(spark, d):
    f = ranked_facts(edges(spark, d)).filter("n > 1")
    return f.select("src_uri", "dst_uri", "place", F.when(F.col("place") == 1, "current").otherwise("superseded").alias("authority"))


@query(f"{RANKED} SELECT src_uri, dst_uri AS current_value, n - 1 AS superseded FROM f WHERE place = 1 AND n > 1")
def current_vs_superseded(spark, d):
    return ranked_facts(edges(spark, d)).filter("place = 1 AND n > 1").select("src_uri", F.col("dst_uri").alias("current_value"), (F.col("n") - 1).alias("superseded"))


@query(f"{RANKED}, found AS (SELECT src_uri AS key_uri, list(dst_uri ORDER BY place) AS tails FROM f WHERE n > 1 GROUP BY src_uri), stored AS (SELECT uri AS key_uri, CASE key % 4 WHEN 1 THEN 'dismissed' WHEN 2 THEN 'resolved' ELSE 'open' END AS status, ['old'] AS tails FROM nodes WHERE type IN ('part', 'supplier') AND key % 4 > 0) SELECT coalesce(f.key_uri, s.key_uri) AS key_uri, 'SUPPLIED_BY' AS relation, coalesce(f.tails, s.tails) AS tails, CASE WHEN s.status = 'dismissed' THEN 'dismissed' WHEN f.key_uri IS NULL THEN 'resolved' ELSE 'open' END AS status FROM found f FULL JOIN stored s ON s.key_uri = f.key_uri")
def fact_conflicts(spark, d):
    """The register after a run: conflicts of this graph, upserted into one that had some of them, and others, in every status."""
    f = ranked_facts(edges(spark, d)).filter("n > 1").groupBy(F.col("src_uri").alias("key_uri"))
    tails = F.transform(F.array_sort(F.collect_list(F.struct("place", "dst_uri"))), lambda x: x["dst_uri"])
    found = f.agg(tails.alias("tails")).withColumn("relation", F.lit("SUPPLIED_BY"))
    status = F.when(F.col("key") % 4 == 1, "dismissed").when(F.col("key") % 4 == 2, "resolved").otherwise("open")
    stored = nodes(spark, d).filter("type IN ('part', 'supplier') AND key % 4 > 0").select(F.col("uri").alias("key_uri"), F.lit("SUPPLIED_BY").alias("relation"), F.array(F.lit("old")).alias("tails"), status.alias("status"))
    return relations.registered(found, stored)


@query(f"{RANKED} SELECT src_uri, dst_uri FROM f WHERE place > 1")
def resolve_conflict(spark, d):
    """Accepting the winners: the other facts go, to be kept as corrections."""
    return ranked_facts(edges(spark, d)).filter("place > 1").select("src_uri", "dst_uri")


@query(f"{GRAPH}, b AS (SELECT * FROM edges UNION ALL SELECT src_uri, rel_type, dst_uri, confidence - 0.5, asserted_at + INTERVAL 1 DAY, source_doc_modified_at, 0, 'job9', ['job9'] FROM edges) SELECT src_uri, rel_type, dst_uri, max(confidence) AS confidence, max(asserted_at) AS asserted_at, list_sort(list_distinct(flatten(list(source_jobs)))) AS source_jobs, min(min_rank)::INTEGER AS min_rank FROM b GROUP BY 1, 2, 3")
def sink_graph_edges(spark, d):
    """Upsert of the edges with a later batch about the same."""
    e = edges(spark, d)
    later = e.withColumns({"confidence": F.col("confidence") - 0.5, "asserted_at": F.expr("asserted_at + INTERVAL 1 DAY"), "min_rank": F.lit(0), "source_job": F.lit("job9"), "source_jobs": F.array(F.lit("job9"))})
    return upserted_edges(e, later)


def upserted_edges(old, new):
    """One edge for each (src_uri, rel_type, dst_uri): highest confidence, latest assertion, all jobs, lowest rank."""
    return old.unionByName(new).groupBy("src_uri", "rel_type", "dst_uri").agg(F.max("confidence").alias("confidence"), F.max("asserted_at").alias("asserted_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_jobs")))).alias("source_jobs"), F.min("min_rank").alias("min_rank"))


@query(f"WITH {NODES}, b AS (SELECT * FROM nodes UNION ALL SELECT uri, name, type, coarse_type, key, 200, 'job9', ['job9'] FROM nodes) SELECT uri, any_value(name) AS name, min(min_rank)::INTEGER AS min_rank, list_sort(list(DISTINCT min_rank))::INTEGER[] AS label_ranks, count(DISTINCT min_rank) > 1 AS class_conflict, list_sort(list_distinct(flatten(list(source_jobs)))) AS source_jobs FROM b GROUP BY uri")
def sink_graph_nodes(spark, d):
    n = nodes(spark, d)
    return upserted_nodes(n, n.withColumns({"min_rank": F.lit(200), "source_job": F.lit("job9"), "source_jobs": F.array(F.lit("job9"))}))


def upserted_nodes(old, new):
    """One node for each uri: jobs united, every rank once, the least as min_rank, and whether ranks disagree."""
    g = old.unionByName(new).groupBy("uri").agg(F.min("name").alias("name"), F.min("min_rank").alias("min_rank"), F.array_sort(F.collect_set("min_rank")).alias("label_ranks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_jobs")))).alias("source_jobs"))
    return g.withColumn("class_conflict", F.size("label_ranks") > 1)


@query(f"WITH {NODES}, b AS (SELECT uri, [min_rank, 200] AS r FROM nodes) SELECT uri, len(list_filter(list_distinct(r), lambda x: x <> 200)) AS left_labels, list_min(list_filter(r, lambda x: x <> 200))::INTEGER AS min_rank FROM b")
def remove_label(spark, d):
    left = F.array_distinct(F.filter(F.array("min_rank", F.lit(200)), lambda x: x != 200))
    return nodes(spark, d).select("uri", F.size(left).cast("long").alias("left_labels"), F.array_min(left).alias("min_rank"))


@query(f"WITH {NODES} SELECT uri, CASE WHEN min_rank < 200 THEN 'remove lowest' ELSE 'keep' END AS suggestion FROM nodes WHERE min_rank <> 200")
def class_conflicts(spark, d):
    ranks = F.array_distinct(F.array("min_rank", F.lit(200)))
    return nodes(spark, d).filter(F.size(ranks) > 1).select("uri", F.when(F.col("min_rank") < 200, "remove lowest").otherwise("keep").alias("suggestion"))


@query(f"{GRAPH}, p AS (SELECT name, uri, source_job FROM nodes WHERE type = 'part') SELECT p.uri, 'source' || s.n AS origin FROM p JOIN (SELECT 'job' || i AS job, i AS n FROM range(8) t(i)) s ON s.job = p.source_job")
def provenance_join(spark, d):
    jobs = spark.range(8).select(F.concat(F.lit("job"), F.col("id").cast("string")).alias("source_job"), F.concat(F.lit("source"), F.col("id").cast("string")).alias("origin"))
    return nodes(spark, d).filter("type = 'part'").join(jobs, "source_job").select("uri", "origin")


@query(f"WITH {NODES} SELECT 'kb' || (key % 3) AS compilation, source_job AS job, count(*) AS entities FROM nodes GROUP BY 1, 2")
def lineage_join(spark, d):
    return nodes(spark, d).groupBy(F.concat(F.lit("kb"), (F.col("key") % 3).cast("string")).alias("compilation"), F.col("source_job").alias("job")).agg(F.count("*").alias("entities"))


@query("WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent_id FROM part), c AS (SELECT id, id AS ancestor, 0::BIGINT AS depth FROM t UNION ALL SELECT c.id, t.parent_id, depth + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent_id IS NOT NULL AND depth < 32) SELECT ancestor AS folder, count(*) AS total FROM c GROUP BY 1")
def folder_tree_totals(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey DIV 2 END").alias("parent_id"))
    return graph.closure(t).groupBy(F.col("ancestor").alias("folder")).agg(F.count("*").alias("total"))


@query("WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent_id FROM part), c AS (SELECT id, id AS ancestor, 0::BIGINT AS depth FROM t UNION ALL SELECT c.id, t.parent_id, depth + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent_id IS NOT NULL AND depth < 32) SELECT id, depth FROM c WHERE ancestor = 3")
def folder_cycle_check(spark, d):
    """Everything below folder 3: none of it may become its parent."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey DIV 2 END").alias("parent_id"))
    return graph.closure(t).filter("ancestor = 3").select("id", "depth")
