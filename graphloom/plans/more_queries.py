"""Queries of the wiki, of names and letterheads, of office files, and of catalog upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, prediction, retrieval
from ..sources import office
from .function_queries import LETTERS, WIKI
from .model import CHUNKS, GRAPH, NODES, chunks, edges, nodes, table
from .registry import query
from .retrieval_queries import WORDS_OF


@query(f"WITH {NODES} SELECT uri FROM nodes WHERE key % 5 = 0 OR list_has_any(source_jobs, ['job2'])")
def node_auth(spark, d):
    """Own elements, or those of granted jobs."""
    from ..operators.access import in_jobs

    return nodes(spark, d).filter((F.col("key") % 5 == 0) | in_jobs(["job2"])).select("uri")


@query("WITH by_id AS (SELECT p_partkey AS id, 'SECRET' AS level FROM part WHERE p_size > 40), by_name AS (SELECT p_name AS name, 'INTERNAL' AS level FROM part GROUP BY 1 HAVING count(*) > 1) SELECT p_partkey, coalesce(i.level, n.level, 'PUBLIC') AS level FROM part LEFT JOIN by_id i ON id = p_partkey LEFT JOIN by_name n ON name = p_name")
def classification_lookup(spark, d):
    """By id, then by name, otherwise PUBLIC."""
    p = table(spark, d, "part")
    by_id = p.filter("p_size > 40").select("p_partkey", F.lit("SECRET").alias("own"))
    by_name = p.groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1").select("p_name", F.lit("INTERNAL").alias("named"))
    return p.join(by_id, "p_partkey", "left").join(by_name, "p_name", "left").select("p_partkey", F.coalesce("own", "named", F.lit("PUBLIC")).alias("level"))


@query(f"{GRAPH}, n AS (SELECT source_job AS job, count(*) AS nodes FROM nodes GROUP BY 1), e AS (SELECT source_job AS job, count(*) AS edges FROM edges GROUP BY 1) SELECT job, coalesce(nodes, 0)::BIGINT AS nodes, coalesce(edges, 0)::BIGINT AS edges FROM n FULL JOIN e USING (job)")
def live_counts(spark, d):
    one = lambda df, a, b: df.select(F.col("source_job").alias("job"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = one(nodes(spark, d), 1, 0).unionByName(one(edges(spark, d), 0, 1))
    return both.groupBy("job").agg(F.sum("a").alias("nodes"), F.sum("b").alias("edges"))


#: Particles of names.
PARTICLES = ("von", "van", "de", "der", "la")


def author_words(x):
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(T.fold(x), r"[,;&]| and ", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*PARTICLES))))


AUTHORS = f"x AS (SELECT p_partkey, p_brand || ', ' || replace(lower(p_name), ' ', ' and ') AS a FROM part), aw AS (SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(translate(lower(a), {LETTERS}), '[,;&]| and ', ' ', 'g'), '\\s+'), lambda w: len(w) > 1 AND w NOT IN ('von', 'van', 'de', 'der', 'la')))) AS w FROM x)"


def _authors(spark, d):
    a = F.concat(F.col("p_brand"), F.lit(", "), F.replace(F.lower("p_name"), F.lit(" "), F.lit(" and ")))
    return table(spark, d, "part").select("p_partkey", "p_size", author_words(a).alias("w"))


@query(f"WITH {AUTHORS} SELECT p_partkey, w AS authors FROM aw")
def author_token_set(spark, d):
    return _authors(spark, d).select("p_partkey", F.col("w").alias("authors"))


@query(f"WITH {AUTHORS}, z AS (SELECT aw.*, p_size, min(p_partkey) OVER (PARTITION BY p_size) AS first FROM aw JOIN part USING (p_partkey)) SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS score FROM z a JOIN z b ON a.p_partkey = b.first")
def authors_jaccard(spark, d):
    """Of every record's authors with those of the first record of its size."""
    z = _authors(spark, d)
    first = z.groupBy("p_size").agg(F.min("p_partkey").alias("a"), F.min_by("w", "p_partkey").alias("x"))
    return z.join(first, "p_size").select("a", F.col("p_partkey").alias("b"), F.round(T.set_jaccard(F.col("x"), F.col("w")), 6).alias("score"))


@query("WITH c AS (SELECT DISTINCT string_split(lower(p_name), ' ') AS w FROM part), f AS (SELECT w FROM c WHERE len(w) = 2), i AS (SELECT DISTINCT substr(w[1], 1, 1) AS initial, w[2] AS last FROM f) SELECT w[1] || ' ' || w[2] AS name, initial || ' ' || last AS short FROM f JOIN i ON i.last = w[2] AND starts_with(w[1], initial)")
def person_initial_match(spark, d):
    """Names of two words and the forms with an initial that they match: same last word, the first begins with the initial."""
    f = table(spark, d, "part").select(F.split(F.lower("p_name"), " ").alias("w")).distinct().filter(F.size("w") == 2).select(F.col("w")[0].alias("first"), F.col("w")[1].alias("last"))
    i = f.select(F.substring("first", 1, 1).alias("initial"), "last").distinct()
    return f.withColumn("initial", F.substring("first", 1, 1)).join(i, ["initial", "last"]).select(F.concat_ws(" ", "first", "last").alias("name"), F.concat_ws(" ", "initial", "last").alias("short"))


@query("WITH r AS (SELECT c_custkey, c_nationkey, trim(regexp_replace(regexp_replace(lower(c_name), '[0-9#]+', ' ', 'g'), '\\s+', ' ', 'g')) AS root FROM customer), f AS (SELECT c_nationkey, min(c_custkey) AS first FROM customer GROUP BY 1) SELECT r.c_custkey, x.root = r.root OR contains(x.root, r.root) OR contains(r.root, x.root) AS match FROM r JOIN f USING (c_nationkey) JOIN r x ON x.c_custkey = f.first")
def roots_match(spark, d):
    """Whether every customer's name has the root of the first customer's of its nation, or one root holds the other."""
    root = F.trim(F.regexp_replace(F.regexp_replace(F.lower("c_name"), "[0-9#]+", " "), r"\s+", " "))
    r = table(spark, d, "customer").select("c_custkey", "c_nationkey", root.alias("root"))
    first = r.groupBy("c_nationkey").agg(F.min_by("root", "c_custkey").alias("x"))
    return r.join(first, "c_nationkey").select("c_custkey", ((F.col("x") == F.col("root")) | F.contains("x", "root") | F.contains("root", "x")).alias("match"))


BACK = "'made by ' || p_brand || chr(10) || '## Backlinks' || chr(10) || '- [[' || p_type || ']]' || chr(10) || '<!-- core: ' || sha256(p_name) || ' -->'"


def _page(spark, d):
    nl = F.lit("\n")
    body = F.concat(F.lit("made by "), "p_brand", nl, F.lit("## Backlinks"), nl, F.lit("- [["), "p_type", F.lit("]]"), nl, F.lit("<!-- core: "), F.sha2("p_name", 256), F.lit(" -->"))
    return table(spark, d, "part").select("p_partkey", body.alias("body"))


@query(f"SELECT p_partkey, regexp_replace(b, '(?s)\\n## Backlinks.*$', '') AS body FROM (SELECT p_partkey, {BACK} AS b FROM part)")
def backlinks_strip(spark, d):
    return _page(spark, d).select("p_partkey", F.regexp_replace("body", r"(?s)\n## Backlinks.*$", "").alias("body"))


@query(f"SELECT p_partkey, regexp_extract(b, '<!-- core: ([0-9a-f]+) -->', 1) AS hash FROM (SELECT p_partkey, {BACK} AS b FROM part)")
def core_hash_read(spark, d):
    return _page(spark, d).select("p_partkey", F.regexp_extract("body", "<!-- core: ([0-9a-f]+) -->", 1).alias("hash"))


@query("SELECT conv_id, turn, name FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), lambda w: w NOT IN ('The', 'What', 'Who', 'How')) AS f, CASE WHEN len(f) > 0 THEN f[list_position(list_transform(f, lambda w: len(w)), list_max(list_transform(f, lambda w: len(w))))] END AS name FROM conversations)")
def proper_name_guess(spark, d):
    """The longest run of capitalised words that isn't a question word, of several the first."""
    found = F.filter(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)), lambda w: ~w.isin("The", "What", "Who", "How"))
    best = F.array_max(F.transform(found, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    return table(spark, d, "conversations").select("conv_id", "turn", best["w"].alias("name"))


@query("SELECT c_custkey, c_name AS organisation, n_name AS city FROM customer JOIN nation ON n_nationkey = c_nationkey")
def letterhead_pairs(spark, d):
    """Organisation and city from letterheads: the city of a postal line, the organisation at most three lines above."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    letter = F.concat(F.lit("ORG "), "c_name", F.lit("\nStreet 1\nD-12345 "), "n_name", F.lit("\nDear all"))
    lines = c.select("c_custkey", F.posexplode(F.split(letter, "\n")).alias("i", "line"))
    city = lines.withColumn("city", F.regexp_extract("line", r"^D-\d{5} (.+)$", 1)).filter("city <> ''").select("c_custkey", F.col("i").alias("at"), "city")
    org = lines.withColumn("organisation", F.regexp_extract("line", r"^ORG (.+)$", 1)).filter("organisation <> ''")
    return org.join(city, "c_custkey").filter("i < at AND i >= at - 3").select("c_custkey", "organisation", "city")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'READ' WHEN 'purchase' THEN 'SPEND' END AS action FROM events")
def map_lookup(spark, d):
    known = F.create_map(*[F.lit(x) for kv in (("view", "READ"), ("click", "READ"), ("purchase", "SPEND")) for x in kv])
    return table(spark, d, "events").select("event_id", F.try_element_at(known, F.col("event_type")).alias("action"))


@query(f"{GRAPH} SELECT src_uri AS node, 'from' AS side FROM edges WHERE min_rank = 0 AND rel_type = 'LOCATED_IN' UNION SELECT dst_uri, 'to' FROM edges WHERE min_rank = 0 AND rel_type = 'LOCATED_IN'")
def graph_trace(spark, d):
    e = edges(spark, d).filter("min_rank = 0 AND rel_type = 'LOCATED_IN'")
    return e.select(F.col("src_uri").alias("node"), F.lit("from").alias("side")).union(e.select("dst_uri", F.lit("to"))).distinct()


@query(f"WITH n AS (SELECT DISTINCT array_to_string({WORDS_OF}[1:3], ' ') AS title FROM benchmark UNION SELECT DISTINCT {WORDS_OF}[1] FROM documents), c AS (SELECT conv_id, turn, ' ' || array_to_string({WORDS_OF}, ' ') || ' ' AS t FROM conversations) SELECT conv_id, turn, title FROM c JOIN n ON title <> '' AND contains(t, ' ' || title || ' ') QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(title) DESC, title) = 1")
def wiki_page_match(spark, d):
    """The longest page title that a message holds as whole words; titles are the first words of documents and of benchmark items."""
    first = lambda name, n: table(spark, d, name).select(F.array_join(F.slice(T.tokens(F.col("text")), 1, n), " ").alias("title"))
    hit = retrieval.names_in(table(spark, d, "conversations"), "text", first("benchmark", 3).union(first("documents", 1)).distinct(), "title")
    best = F.min(F.struct((-F.length("title")).alias("n"), "title"))
    return hit.groupBy("conv_id", "turn").agg(best["title"].alias("title"))


@query(f"WITH {WIKI} SELECT p_name AS title, count(*) AS entities, list_sort(list(DISTINCT p_type)) AS concepts, md5(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS hash FROM part GROUP BY 1")
def wiki_distill(spark, d):
    """A page for each name: what it is made of, its concepts, and the hash by which unchanged pages are passed over."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return table(spark, d, "part").groupBy(F.col("p_name").alias("title")).agg(F.count("*").alias("entities"), F.array_sort(F.collect_set("p_type")).alias("concepts"), F.md5(ids).alias("hash"))


@query(f"{GRAPH}, k AS (SELECT lower(name) AS n, uri, type FROM nodes), x AS (SELECT a.uri AS a, b.uri AS b FROM k a JOIN k b ON a.n = b.n AND a.type < b.type), around AS (SELECT src_uri AS uri, dst_uri AS o FROM edges UNION SELECT dst_uri, src_uri FROM edges) SELECT x.a, x.b, count(z.o) AS shared FROM x LEFT JOIN around y ON y.uri = x.a LEFT JOIN around z ON z.uri = x.b AND z.o = y.o GROUP BY 1, 2")
def er_canonical(spark, d):
    """Same name, other type, with the number of shared neighbours as context."""
    n = nodes(spark, d).select("uri", "type", F.lower("name").alias("n"))
    x = n.select("n", F.col("uri").alias("a"), F.col("type").alias("ta")).join(n.select("n", F.col("uri").alias("b"), F.col("type").alias("tb")), "n").filter("ta < tb").select("a", "b")
    around = graph.undirected(edges(spark, d)).distinct()
    shared = x.join(around.withColumnRenamed("uri", "a"), "a").join(around.withColumnsRenamed({"uri": "b"}), ["b", "other"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return x.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


@query("SELECT o_custkey AS compilation, list_sort(list_distinct(list_append(list(o_orderkey), 1::BIGINT))) AS jobs FROM orders GROUP BY 1")
def link_job(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("compilation")).agg(F.array_sort(F.array_union(F.collect_set("o_orderkey"), F.array(F.lit(1).cast("long")))).alias("jobs"))


@query("SELECT o_custkey AS owner, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS compilation FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def default_compilation(spark, d):
    first = F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"]
    return table(spark, d, "orders").filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("owner")).agg(first.alias("compilation"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'denied' ELSE 'granted' END AS outcome, 'user/' || user_id AS resource FROM events")
def audit_write(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "denied").otherwise("granted").alias("outcome"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("resource"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def backfill_mentions(spark, d):
    known = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(known, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey // 10 * 10 END AS parent_id FROM part")
def backfill_folder_hygiene(spark, d):
    """Folders that are their own parent lose it."""
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.floor(F.col("p_partkey") / 10) * 10).alias("parent_id"))
    return f.select("id", F.when(F.col("id") != F.col("parent_id"), F.col("parent_id")).alias("parent_id"))


@query(f"WITH {CHUNKS} SELECT owner_id, count(*) AS chunks FROM chunks GROUP BY 1")
def reindex_queue(spark, d):
    return chunks(spark, d).groupBy("owner_id").agg(F.count("*").alias("chunks"))


@query("SELECT p_partkey, 'the name is ' || p_name || chr(10) || 'made by ' || p_brand AS text FROM part")
def src_obsidian(spark, d):
    note = F.concat(F.lit("---\ntag: x\n---\n# the name is *"), "p_name", F.lit("*\nmade by [["), "p_brand", F.lit("]]"))
    return table(spark, d, "part").select("p_partkey", T.markdown_text(note).alias("text"))


def _office(kind: str):
    def run(spark, d):
        p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
        return p.select("p_partkey", office.office_text(office.office_file("text", F.lit(kind)), F.lit(kind)).alias("text"))

    return run


for _kind in office.KINDS:
    query("SELECT p_partkey, p_name AS text FROM part", name=f"src_{_kind}")(_office(_kind))


@query("SELECT conv_id, turn, 'Subject: ' || role || chr(10) || chr(10) || text AS text FROM conversations")
def src_eml(spark, d):
    from ..sources import files

    raw = F.concat(F.lit("Subject: "), "role", F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text").cast("binary")
    return table(spark, d, "conversations").select("conv_id", "turn", files.mail_text(raw).alias("text"))


@query("SELECT p_partkey, p_name AS text FROM part")
def src_rtf(spark, d):
    from ..sources import files

    return table(spark, d, "part").select("p_partkey", files.rtf_text(F.concat(F.lit(r"{\rtf1\ansi "), "p_name", F.lit("}"))).alias("text"))


@query("SELECT p_partkey, 'name: ' || p_name || chr(10) || 'size: ' || p_size AS text FROM part")
def src_yaml(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("name: "), "p_name", F.lit("\nsize: "), F.col("p_size").cast("string")).alias("text"))


@query("SELECT event_id, trim(split_part(q, ' ', 1)) IN ('SELECT', 'WITH') AND NOT regexp_matches(q, 'DROP|DELETE|INSERT') AS ok FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'SELECT 1' WHEN 'click' THEN 'DROP TABLE t' WHEN 'purchase' THEN 'WITH x AS (DELETE FROM t) SELECT 1' ELSE 'SHOW' END AS q FROM events)")
def readonly_query_guard(spark, d):
    q = F.expr("CASE event_type WHEN 'view' THEN 'SELECT 1' WHEN 'click' THEN 'DROP TABLE t' WHEN 'purchase' THEN 'WITH x AS (DELETE FROM t) SELECT 1' ELSE 'SHOW' END")
    return table(spark, d, "events").select("event_id", (q.rlike(r"^\s*(SELECT|WITH)\b") & ~q.rlike(r"\b(DROP|DELETE|INSERT)\b")).alias("ok"))


@query(f"{GRAPH}, u AS (SELECT DISTINCT src_uri AS a, dst_uri AS m FROM edges WHERE rel_type = 'ORDERED'), g AS (SELECT m, count(*) AS k FROM u GROUP BY 1 HAVING count(*) >= 2) SELECT x.a AS a, y.a AS b, round(sum(1 / ln(k + 1)), 6) AS score FROM u x JOIN u y ON x.m = y.m AND x.a < y.a JOIN g ON g.m = x.m GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50")
def link_prediction(spark, d):
    """The 50 best pairs of customers by what both ordered, rare things counting more."""
    u = edges(spark, d).filter("rel_type = 'ORDERED'").select(F.col("src_uri").alias("a"), F.col("dst_uri").alias("m")).distinct()
    return prediction.best_pairs(u, 50)


@query("SELECT p_partkey, CASE WHEN rn = 1 THEN 'fresh' ELSE 'kept' END AS state FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def src_drive(spark, d):
    """An incremental listing: the first file of a name is fetched, later ones are known."""
    place = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.when(place == 1, "fresh").otherwise("kept").alias("state"))


@query()
def src_sdk(spark, d):
    """The connector interface on the folder of the tables: what lies there."""
    from ..sources import connector

    connector.register(spark)
    return spark.read.format("file_listing").load(d).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), (F.col("size") > 0).alias("filled"))


@query("SELECT o_orderkey, '[issue] order ' || o_orderkey || chr(10) || 'by ' || o_custkey || chr(10) || o_orderpriority AS text FROM orders")
def src_saas(spark, d):
    from ..sources import connector

    text = connector.record_text("issue", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


@query("SELECT event_id, '{\"event\":\"' || event_type || '\",\"user\":' || user_id || '}' AS payload FROM events WHERE event_type = 'purchase'")
def sink_webhook(spark, d):
    """What is posted when a job completes; a stream hands it out in foreachBatch."""
    return table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user"))).alias("payload"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 AND toxic = 0 THEN 'PUBLIC' WHEN toxic = 1 THEN 'RESTRICTED' END, 'INTERNAL') AS level FROM documents LEFT JOIN labels USING (doc_id)")
def auto_classify(spark, d):
    """A label where there is one from a model or a person, otherwise INTERNAL."""
    level = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "PUBLIC").when(F.col("toxic") == 1, "RESTRICTED")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(level, F.lit("INTERNAL")).alias("level"))


@query(f"WITH {NODES} SELECT uri FROM nodes WHERE contains(lower(name), 'asia') OR contains(lower(name), 'africa')")
def nl_to_graph_query(spark, d):
    """The fallback without a model: entities whose names hold a long word of the question."""
    words = [w for w in "what links asia to africa".split() if len(w) > 3 and w not in ("what", "links")]
    name = F.lower("name")
    return nodes(spark, d).filter(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))).select("uri")


@query("SELECT doc_id, count(*) AS tokens FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) FROM documents) GROUP BY 1")
def tokenize(spark, d):
    """The table function for SQL users."""
    from ..functions import udtf

    udtf.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("graphloom_documents")
    return spark.sql("SELECT doc_id, count(*) AS tokens FROM graphloom_documents, LATERAL text_tokens(text) GROUP BY doc_id")


@query("SELECT p_partkey, 'name = ' || p_name AS text FROM part")
def src_toml(spark, d):
    from ..sources import files

    return table(spark, d, "part").select("p_partkey", files.toml_text(F.concat(F.lit('[a]\nname = "'), "p_name", F.lit('"'))).alias("text"))
