"""Queries of sources, sinks, streams and ordered operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import html_text, wiki_slug
from ..operators import communities, edit_join, graph, resolution, sequences, wiki
from ..operators.lineage import shared_dir
from ..sources import exports, files
from ..streaming import ingest, timers
from .model import CHUNKS, GRAPH, NODES, chunks, edges, nodes, table
from .registry import query

HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("WITH x AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/a/x.CSV' WHEN 1 THEN '/a/x.doc' WHEN 2 THEN '/a/x' WHEN 3 THEN '/a.b/x.html' WHEN 4 THEN '/a/x.eml' ELSE '/a/x.zip' END AS path, CASE WHEN page_id % 12 = 2 THEN 'text/html' ELSE 'what/ever' END AS mime FROM pages) SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'rejected' WHEN 2 THEN CASE WHEN mime = 'text/html' THEN 'markup' END WHEN 3 THEN 'markup' WHEN 4 THEN 'mail' END AS extractor FROM x")
def src_file_dispatch(spark, d):
    path = F.expr("CASE page_id % 6 WHEN 0 THEN '/a/x.CSV' WHEN 1 THEN '/a/x.doc' WHEN 2 THEN '/a/x' WHEN 3 THEN '/a.b/x.html' WHEN 4 THEN '/a/x.eml' ELSE '/a/x.zip' END")
    mime = F.when(F.col("page_id") % 12 == 2, "text/html").otherwise("what/ever")
    return table(spark, d, "pages").select("page_id", files.extractor(path, mime).alias("extractor"))


@query("SELECT p_partkey, 'p_name: ' || p_name || ' | p_brand: ' || p_brand || ' | p_size: ' || p_size AS text FROM part")
def src_db(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", files.row_text(p, ["p_name", "p_brand", "p_size"]).alias("text"))


@query("SELECT c_custkey, 'Row ' || c_custkey || ': c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment AS text FROM customer")
def src_csv(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.format_string("Row %d: ", "c_custkey"), files.row_text(c, ["c_name", "c_mktsegment"])).alias("text"))


@query("SELECT event_id, CASE WHEN len(event_type) > 3 THEN event_type ELSE '' END AS text FROM events")
def src_json(spark, d):
    made = F.to_json(F.struct("event_id", F.struct(F.array("event_type", F.lit("abc")).alias("kinds")).alias("deep")))
    return table(spark, d, "events").select("event_id", files.json_strings(made).alias("text"))


@query(f"SELECT page_id, {HTML} AS text FROM pages")
def src_html(spark, d):
    return table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {HTML} AS text FROM pages")
def src_xml(spark, d):
    return table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query(f"SELECT url, len({HTML})::BIGINT AS chars FROM pages")
def src_url(spark, d):
    return table(spark, d, "pages").select("url", F.length(html_text(F.col("html"))).cast("long").alias("chars"))


LINKS = """l AS (SELECT regexp_replace(url, '#.*$', '') AS src, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '#.*$', '') AS dst0 FROM pages),
m AS (SELECT src, CASE WHEN starts_with(dst0, '/') THEN regexp_extract(src, '^(https?://[^/?#]+)', 1) || dst0 ELSE dst0 END AS dst FROM l),
links AS (SELECT DISTINCT src, dst FROM m WHERE regexp_extract(lower(src), '^https?://([^/?#]+)', 1) = regexp_extract(lower(dst), '^https?://([^/?#]+)', 1) AND src <> dst)"""


@query(f"WITH {LINKS}, s AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS start FROM pages), a AS (SELECT DISTINCT start, dst AS url FROM s JOIN links ON src = start), b AS (SELECT DISTINCT start, dst AS url FROM a JOIN links ON src = url), u AS (SELECT start, start AS url, 0 AS depth FROM s UNION ALL SELECT *, 1 FROM a UNION ALL SELECT *, 2 FROM b), t AS (SELECT start, url, min(depth)::BIGINT AS depth FROM u GROUP BY 1, 2) SELECT start, url, depth FROM t QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, url) <= 50")
def crawl_bfs(spark, d):
    pages = table(spark, d, "pages")
    start = pages.select(files.without_fragment(F.col("url")).alias("url")).distinct()
    return files.crawl(files.link_table(pages), start, 2, 50)


@query(f"{GRAPH}, pg AS (SELECT * FROM nodes WHERE type IN ('region', 'nation', 'supplier') AND min_rank <= 200), sl AS (SELECT uri, replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), '--', '-') AS slug FROM pg) SELECT DISTINCT x.slug AS source, y.slug AS target FROM edges JOIN sl x ON x.uri = src_uri JOIN sl y ON y.uri = dst_uri WHERE rel_type = 'LOCATED_IN' AND x.slug <> y.slug")
def wiki_graph(spark, d):
    """Pages of places and suppliers that link to where they are, by slug, title or something that slugifies to it."""
    n = nodes(spark, d).filter(F.col("type").isin("region", "nation", "supplier"))
    to = n.select(F.col("uri").alias("dst_uri"), F.expr("CASE key % 3 WHEN 0 THEN name WHEN 1 THEN concat(upper(name), ' !') END").alias("form"), wiki_slug(F.col("name")).alias("to_slug"))
    body = edges(spark, d).filter("rel_type = 'LOCATED_IN'").join(to, "dst_uri").select(F.col("src_uri").alias("uri"), F.concat(F.lit("see [["), F.coalesce("form", "to_slug"), F.lit("|there]] and [[nowhere]]")).alias("body"))
    pages = n.join(body, "uri", "left").select(wiki_slug(F.col("name")).alias("slug"), F.col("name").alias("title"), F.coalesce("body", F.lit("")).alias("body"), "min_rank")
    return wiki.page_links(pages, 200)


@query()
def src_code_repo(spark, d):
    """Python made of the parts' names: a class for each brand with a method for each type, that calls another."""
    name = F.regexp_replace(F.lower("p_type"), "[^a-z]+", "_")
    p = table(spark, d, "part").groupBy(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("brand")).agg(F.array_sort(F.collect_set(name)).alias("types"))
    body = F.array_join(F.transform("types", lambda t: F.concat(F.lit("    def "), t, F.lit("(self):\n        return helper(1)\n"))), "")
    code = p.select(F.concat(F.lower("brand"), F.lit(".py")).alias("path"), F.concat(F.lit("import os\n\nclass "), "brand", F.lit(":\n"), body).alias("content"))
    helper = spark.createDataFrame([("helper.py", "def helper(x):\n    return x\n"), ("bad.py", "def (")], "path string, content string")
    return files.code_graph(files.code_facts(code.unionByName(helper)))


@query("""SELECT '{"@id":"kg:0123456789ab/region/' || trim(regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || r_regionkey || '","@type":"region","name":"' || r_name || '"}' AS value FROM region""")
def sink_export_jsonld(spark, d):
    return exports.jsonld(nodes(spark, d).filter("type = 'region'"))


@query(f"{GRAPH} SELECT '<' || src_uri || '> <rel:' || rel_type || '> <' || dst_uri || '> .' AS value FROM edges")
def sink_export_turtle(spark, d):
    return exports.turtle(edges(spark, d))


@query(f"""{GRAPH} SELECT '<node id="' || uri || '"><data key="name">' || replace(replace(name, '&', '&amp;'), '<', '&lt;') || '</data></node>' AS value FROM nodes UNION ALL SELECT '<edge source="' || src_uri || '" target="' || dst_uri || '" label="' || rel_type || '"/>' FROM edges""")
def sink_export_graphml(spark, d):
    return exports.graphml(nodes(spark, d), edges(spark, d))


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id, seq, content FROM chunks WHERE doc_id >= 50")
def sink_chunks(spark, d):
    """Chunks that aren't stored yet, by id."""
    c = chunks(spark, d).select("chunk_id", "doc_id", "seq", "content")
    return c.join(c.filter("doc_id < 50").select("chunk_id"), "chunk_id", "left_anti")


@query(f"WITH {CHUNKS} SELECT chunk_id, content FROM chunks WHERE owner_id = 'src4'")
def scan_chunks(spark, d):
    return chunks(spark, d).filter("owner_id = 'src4'").select("chunk_id", "content")


@query()
def chunk_text(spark, d):
    return sequences.chunk_text(table(spark, d, "documents"))


@query()
def window_split(spark, d):
    return sequences.chunk_text(table(spark, d, "documents"), 6000, 200).filter("chunk_sequence < 8")


@query()
def span_overlap_antijoin(spark, d):
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 20).cast("int").alias("start"), (F.col("l_partkey") % 20 + 5 + F.col("l_linenumber")).cast("int").alias("end"), F.col("l_extendedprice").alias("score"))
    return sequences.without_overlaps(spans)


@query()
def seq_ratio(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size", "p_brand")
    return sequences.alike_in_blocks(p, ["p_size", "p_brand"])


def _linked(spark, d):
    return edges(spark, d).select(F.col("src_uri").alias("a"), F.col("dst_uri").alias("b"))


@query()
def communities_louvain(spark, d):
    """Communities of all of the graph."""
    return communities.communities(_linked(spark, d))


@query()
def community_summary(spark, d):
    """Each community's name, that of its member of highest degree, and its size."""
    e = _linked(spark, d)
    degree = communities.both_ways(e).groupBy("node").agg(F.count("*").alias("k"))
    c = communities.communities(e).join(degree, "node").join(nodes(spark, d).select(F.col("uri").alias("node"), "name"), "node")
    best = F.min(F.struct((-F.col("k")).alias("k"), "name", "node")).alias("best")
    return c.groupBy("community").agg(best, F.count("*").alias("size")).select("community", F.col("best.name").alias("name"), "size")


@query(f"{GRAPH}, e AS (SELECT DISTINCT least(src_uri, dst_uri) AS a, greatest(src_uri, dst_uri) AS b FROM edges WHERE rel_type = 'LOCATED_IN'), u AS (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e), k AS (SELECT node, count(*) AS k FROM u GROUP BY 1), t AS (SELECT count(*) AS total FROM u), kind AS (SELECT uri AS node, type FROM nodes), w AS (SELECT type, sum(k) AS weight FROM k JOIN kind USING (node) GROUP BY 1), l AS (SELECT u.node, type, count(*) AS links FROM u JOIN kind ON kind.node = u.other GROUP BY ALL) SELECT l.node, l.type AS community, round(links - k.k * (weight - CASE WHEN kind.type = l.type THEN k.k ELSE 0 END)::DOUBLE / total, 6)::DOUBLE AS gain FROM l JOIN k USING (node) JOIN kind USING (node) JOIN w ON w.type = l.type, t")
def modularity_gain(spark, d):
    """What every place, customer and supplier would gain by joining each kind of node around it, with kinds as communities."""
    around = communities.both_ways(edges(spark, d).filter("rel_type = 'LOCATED_IN'").select(F.col("src_uri").alias("a"), F.col("dst_uri").alias("b")))
    kind = nodes(spark, d).select(F.col("uri").alias("node"), F.col("type").alias("community"))
    return communities.gains(around, kind).select("node", "community", F.round("gain", 6).alias("gain"))


@query(f"{GRAPH}, vn AS (SELECT uri, type, key FROM nodes WHERE min_rank <= 200), ve AS (SELECT src_uri AS a, dst_uri AS b FROM edges WHERE min_rank <= 200), ud AS (SELECT a AS uri, b AS other FROM ve UNION SELECT b, a FROM ve), st AS (SELECT uri, other FROM ud WHERE other IN (SELECT uri FROM vn)), pr AS (SELECT x.uri AS a, y.uri AS b FROM vn x JOIN vn y ON x.type = 'customer' AND y.type = 'supplier' AND x.key = y.key), r AS (SELECT DISTINCT a AS start, a AS uri, 0 AS hops FROM pr UNION SELECT r.start, st.other, r.hops + 1 FROM r JOIN st ON st.uri = r.uri WHERE r.hops < 5) SELECT a, b, min(hops)::BIGINT AS hops FROM pr JOIN r ON r.start = a AND r.uri = b GROUP BY ALL")
def shortest_path(spark, d):
    """Hops between every supplier and the customer of the same number, over all that rank 200 may see, five at most."""
    n = nodes(spark, d)
    one = lambda kind, name: n.filter(F.col("type") == kind).select("key", F.col("uri").alias(name))
    pairs = one("customer", "a").join(one("supplier", "b"), "key")
    return graph.paths_between(n, edges(spark, d), pairs, 5, 200).select("a", "b", "hops")


@query("SELECT conv_id, turn, lower(text) AS text FROM conversations")
def decloak(spark, d):
    """Texts with pseudonyms turned back into names: as they were."""
    c = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", F.lit("kb").alias("compilation_id"), F.lower("text").alias("text"))
    names = spark.createDataFrame([("kb", "the", "Entity-1"), ("kb", "and", "Entity-2")], "compilation_id string, entity_key string, pseudonym string")
    there = sequences.pseudonymized(c, names)
    back = sequences.pseudonymized(there, names, reverse=True)
    at = F.split("id", ":")
    return back.select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "text")


@query()
def pseudonymize(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("kb").alias("compilation_id"), "text")
    names = spark.createDataFrame([("kb", "the", "Entity-1"), ("kb", "and", "Entity-2")], "compilation_id string, entity_key string, pseudonym string")
    return sequences.pseudonymized(c, names)


@query('''SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[]' ELSE '[{"k": ' || event_id || '}]' END AS salvaged FROM events''')
def json_salvage(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, '[{"k": 1').otherwise(F.concat(F.lit('[{"k": '), F.col("event_id").cast("string"), F.lit('}, {"k": ')))
    return table(spark, d, "events").select("event_id", sequences.salvaged_json(raw).alias("salvaged"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def ingest_queue(spark, d):
    """The stream of events, upserted by user in a target of versions; the last version is the newest event of each."""
    at = f"{shared_dir(spark)}/graphloom/queue-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select("user_id", "event_id")
    ingest.upsert_queue(stream, f"{at}/target", "user_id", "event_id", f"{at}/checkpoint", 16).awaitTermination()
    return spark.read.schema("user_id long, event_id long").parquet(f"{at}/target").select("user_id", "event_id")


def _event_stream(spark, d, kind, key="user_id"):
    """The events as a stream: key, ts, kind (rows without are left out)."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return stream.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.expr(kind).alias("kind")).filter("kind IS NOT NULL")


def _run(spark, stream):
    """What the stream has appended to a target in the shared folder."""
    at = f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"
    timers.run_once(stream, f"{at}/target", f"{at}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{at}/target")


ASKED = "CASE event_type WHEN 'purchase' THEN 'ask' WHEN 'error' THEN 'done' END"


@query(f"WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, {ASKED} AS kind FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, kind) AS i FROM e WHERE kind IS NOT NULL), r AS (SELECT user_id, i, kind = 'ask' AS made, ms, CASE WHEN kind = 'ask' THEN ms + 86400000 END AS until FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.kind = 'ask' AND coalesce(o.ms >= r.until, true), o.ms, CASE WHEN o.kind = 'done' THEN NULL WHEN coalesce(o.ms >= r.until, true) THEN o.ms + 86400000 ELSE r.until END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id::VARCHAR AS key, ms AS at FROM r WHERE made")
def debounced_refresh(spark, d):
    """Refreshes as a stream makes them: at once where none is pending, which lasts until it is done or a day has passed."""
    timers.use_timers(spark)
    return _run(spark, timers.debounced(_event_stream(spark, d, ASKED), 86_400_000))


STATUS = "CASE event_type WHEN 'purchase' THEN 'processing' WHEN 'click' THEN 'pending' ELSE 'done' END"


@query(f"WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, {STATUS} AS status FROM events), w AS (SELECT max(ms) AS last FROM e), l AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, status) AS next, ms + CASE status WHEN 'processing' THEN 300000 WHEN 'pending' THEN 600000 END AS due FROM e) SELECT user_id::VARCHAR AS key, status, due AS at FROM l, w WHERE next > due OR (next IS NULL AND due <= last)")
def stale_job_recovery(spark, d):
    """Jobs that say nothing for five minutes in work, or ten while they wait, fail by a timer in the stream."""
    timers.use_timers(spark)
    return _run(spark, timers.fallen_silent(_event_stream(spark, d, STATUS), {"processing": 300_000, "pending": 600_000}))


@query("WITH e AS (SELECT event_type, epoch_us(ts) // 1000 AS ms FROM events), t AS (SELECT event_type, ms - ms % 3600000 AS tick, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type AS key, tick AS at, n FROM t WHERE tick + 3600000 <= (SELECT max(ms) FROM e)")
def periodic_ticks(spark, d):
    """What is due at each full hour, told by a timer when the hour ends."""
    timers.use_timers(spark)
    return _run(spark, timers.ticks(_event_stream(spark, d, "event_type", "event_type"), 3_600_000))


@query("SELECT event_type AS channel, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY 1")
def result_subscriber(spark, d):
    """Status changes of all channels, batch by batch, into a table of each channel's last."""
    at = f"{shared_dir(spark)}/graphloom/results-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = stream.select(F.col("event_type").alias("channel"), F.struct("ts", "event_id").alias("at"))
    ingest.upsert_queue(rows, f"{at}/target", "channel", "at", f"{at}/checkpoint", 4).awaitTermination()
    return spark.read.schema("channel string, at struct<ts: timestamp_ntz, event_id: bigint>").parquet(f"{at}/target").select("channel", F.col("at.event_id").alias("last"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(round(value, 2)::DECIMAL(18, 2)) AS spent FROM events GROUP BY 1, 2")
def windowed_usage(spark, d):
    """The batch twin of the stream."""
    return ingest.windowed_usage(table(spark, d, "events")).withColumn("spent", F.col("spent").cast("decimal(38,2)"))


@query(f"WITH {NODES}, p AS (SELECT lower(name) AS name, source_job AS job FROM nodes WHERE type = 'part' GROUP BY ALL), n AS (SELECT DISTINCT name FROM p), c AS (SELECT x.name AS a, y.name AS b, levenshtein(x.name, y.name)::BIGINT AS distance FROM n x JOIN n y ON x.name <> y.name AND levenshtein(x.name, y.name) <= 2) SELECT a, p.job AS ja, b, q.job AS jb, distance FROM c JOIN p ON p.name = a JOIN p q ON q.name = b WHERE p.job < q.job")
def theta_name_join(spark, d):
    """Names of other jobs at an edit distance of 1 or 2, found by segments of the distinct names."""
    p = nodes(spark, d).filter("type = 'part'").select(F.lower("name").alias("name"), F.col("source_job").alias("job")).distinct()
    a, b = (p.withColumnsRenamed({"name": x, "job": f"j{x}"}) for x in "ab")
    near = edit_join.edit_pairs(p.select(F.col("name").alias("a")), p.select(F.col("name").alias("b")), 2).filter("distance > 0")
    return near.join(a, "a").join(b, "b").filter("ja < jb").select("a", "ja", "b", "jb", "distance")


@query("WITH t AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, string_split(lower(p_name), ' ') AS w FROM t), a AS (SELECT p_name, list_aggregate(list_transform(w, lambda x: x[1]), 'string_agg', '') AS acronym FROM w WHERE len(w) >= 2), n AS (SELECT DISTINCT 'v' || acronym AS short FROM a UNION SELECT acronym FROM a) SELECT p_name AS name, short FROM a JOIN n ON short = acronym")
def acronym_match(spark, d):
    """Names of two words or more and the short names that are their initials; short names with another letter before match nothing."""
    a = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("words", F.split(F.lower("name"), " ")).filter(F.size("words") >= 2)
    a = a.select("name", resolution.acronym(F.col("words")).alias("acronym"))
    short = a.select(F.concat(F.lit("v"), "acronym").alias("short")).union(a.select("acronym")).distinct()
    return a.join(short, F.col("acronym") == F.col("short")).select("name", "short")


@query("SELECT doc_id, sum(c)::BIGINT AS chars FROM (SELECT doc_id, len(unnest(string_split(text, chr(10)))) AS c FROM documents) GROUP BY 1")
def src_plain(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).groupBy("doc_id").agg(F.sum(F.length("l")).cast("long").alias("chars"))
