"""Queries of the graph and of revisions, over a graph drawn from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import graph, ingest, vector
from quernstone.operators.visibility import fully_evidenced, overlap, visible
from quernstone.plans.registry import CONTEXT, SEEN, query, table, units

EDGES = """e AS (
  SELECT 'n' || n_nationkey AS id, 'nation:' || n_nationkey AS subject_id, 'part_of' AS predicate, 'region:' || n_regionkey AS object_id, 'accepted' AS status, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, CASE WHEN s_suppkey % 9 = 0 THEN 'revoked' ELSE 'accepted' END, NULL, NULL FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, 'accepted', NULL, NULL FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, 'accepted', o_orderdate, o_orderdate + INTERVAL 90 DAY FROM orders)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")

    def rows(name: str, letter: str, key: str, subject: str, predicate: str, obj: str, to: str, status=None, start=None, end=None) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(letter), key).alias("id"),
            F.concat(F.lit(f"{subject}:"), key).alias("subject_id"),
            F.lit(predicate).alias("predicate"),
            F.concat(F.lit(f"{obj}:"), to).alias("object_id"),
            (F.lit("accepted") if status is None else status).alias("status"),
            (none if start is None else start).alias("valid_from"),
            (none if end is None else end).alias("valid_to"),
        )

    revoked = F.when(F.col("s_suppkey") % 9 == 0, "revoked").otherwise("accepted")
    return (
        rows("nation", "n", "n_nationkey", "nation", "part_of", "region", "n_regionkey")
        .unionByName(rows("supplier", "s", "s_suppkey", "supplier", "located_in", "nation", "s_nationkey", revoked))
        .unionByName(rows("customer", "c", "c_custkey", "customer", "located_in", "nation", "c_nationkey"))
        .unionByName(rows("orders", "o", "o_orderkey", "order", "placed_by", "customer", "o_custkey", None, F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")))
    )


NOW = "1998-06-01"
LIVE = EDGES + f", live AS (SELECT * FROM e WHERE status = 'accepted' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '{NOW}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{NOW}'))"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.live(edges(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@query(f"""WITH {LIVE}, b AS (SELECT id, valid_from, subject_id AS entity_id, object_id AS neighbor_id FROM live UNION ALL SELECT id, valid_from, object_id, subject_id FROM live),
r AS (SELECT entity_id, id, neighbor_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC NULLS LAST, id) AS INT) AS position FROM b WHERE entity_id LIKE 'nation:%')
SELECT * FROM r WHERE position <= 20""")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("entity_id"))
    return graph.neighbors(_live(spark, sf_dir), start, "both", 20)


@query(f"""WITH RECURSIVE {EDGES}, f AS (SELECT * FROM e WHERE predicate IN ('part_of', 'located_in') AND status = 'accepted'),
s AS (SELECT id, subject_id AS here, object_id AS there FROM f UNION ALL SELECT id, object_id, subject_id FROM f),
pairs AS (SELECT 'supplier:' || s_suppkey AS start_id, 'region:' || r_regionkey AS end_id FROM supplier, region),
w AS (SELECT start_id, end_id, [start_id] AS nodes, []::VARCHAR[] AS edge_ids, 0 AS depth FROM pairs
  UNION ALL SELECT start_id, end_id, list_append(nodes, there), list_append(edge_ids, id), depth + 1 FROM w JOIN s ON nodes[-1] = here WHERE depth < 4 AND nodes[-1] <> end_id AND NOT list_contains(nodes, there)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY start_id, end_id ORDER BY depth, array_to_string(edge_ids, ',')) AS INT) AS position FROM w WHERE nodes[-1] = end_id)
SELECT start_id, end_id, nodes, edge_ids, depth, position FROM r WHERE position <= 20""")
def graph_paths_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = graph.live(edges(spark, sf_dir), None, ("part_of", "located_in"))
    start = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("start_id"))
    # each supplier with the few regions, which one row carries
    ends = table(spark, sf_dir, "region").agg(F.collect_list(F.concat(F.lit("region:"), "r_regionkey")).alias("ends"))
    start = start.crossJoin(F.broadcast(ends)).select("start_id", F.explode("ends").alias("end_id"))
    return graph.paths(own, start, 4, 20)


@query("""WITH q AS (SELECT c_custkey AS query_id, 'orders of ' || n_name || ' for ' || c_mktsegment AS query FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT 'nation:' || n_nationkey AS entity_id, n_name AS alias FROM nation UNION ALL SELECT 'segment:' || c_mktsegment, c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT query_id, entity_id, CAST(min(instr(lower(query), lower(alias))) AS INT) AS position, CAST(max(length(alias)) AS INT) AS longest FROM q, a WHERE contains(lower(query), lower(alias)) GROUP BY query_id, entity_id""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.operators.rank import resolve

    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    q = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("orders of "), "n_name", F.lit(" for "), "c_mktsegment").alias("query"))
    a = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("alias"))
    return resolve(q, a.unionByName(c.select(F.concat(F.lit("segment:"), "c_mktsegment").alias("entity_id"), F.col("c_mktsegment").alias("alias")).distinct()))


CLAIMS = "k AS (SELECT o_orderkey AS id, o_custkey AS subject_id, 'has_status' AS predicate, o_orderstatus AS object_id, o_orderdate AS valid_from, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 60 DAY END AS valid_to FROM orders)"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), F.lit("has_status").alias("predicate"), F.col("o_orderstatus").alias("object_id"), F.col("o_orderdate").alias("valid_from"), end.alias("valid_to"))


@query(f"""WITH {CLAIMS} SELECT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.subject_id = b.subject_id AND a.predicate = b.predicate
WHERE a.id < b.id AND a.object_id <> b.object_id AND coalesce(a.valid_to > b.valid_from, true) AND coalesce(b.valid_to > a.valid_from, true)""")
def contradiction_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contradictions(_claims(spark, sf_dir))


@query(f"WITH {CLAIMS} SELECT count(*) AS n FROM k WHERE coalesce(valid_to > TIMESTAMP '1997-01-01', true) AND valid_from < TIMESTAMP '1997-02-01'")
def interval_overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return _claims(spark, sf_dir).where(overlap((F.col("valid_from"), F.col("valid_to")), (day("1997-01-01"), day("1997-02-01")))).agg(F.count("*").alias("n"))


TYPES = [("thing", None), ("place", "thing"), ("region", "place"), ("nation", "place"), ("party", "thing"), ("customer", "party"), ("supplier", "party"), ("document", "thing"), ("order", "document")]
TYPES_SQL = "ty AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in TYPES) + ") AS t(type, parent))"
CLOSURE_SQL = f"{TYPES_SQL}, cl AS (SELECT type, type AS ancestor, 0 AS distance FROM ty UNION ALL SELECT cl.type, ty.parent, distance + 1 FROM cl JOIN ty ON cl.ancestor = ty.type WHERE ty.parent IS NOT NULL)"


PLACES_SQL = """pl AS (SELECT 'customer:' || c_custkey AS type, 'nation:' || c_nationkey AS parent FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'place' FROM region UNION ALL SELECT 'place', NULL)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types (type, parent): customers and suppliers of their nations, these of their regions."""
    out = spark.createDataFrame([("place", None)], "type string, parent string")
    for t, key, above, parent in (("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "n_nationkey", "region", "n_regionkey")):
        out = out.unionByName(table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), key).alias("type"), F.concat(F.lit(f"{above}:"), parent).alias("parent")))
    return out.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("type"), F.lit("place").alias("parent")))


@query(f"""WITH RECURSIVE {PLACES_SQL}, cl AS (SELECT type, type AS ancestor, 0 AS distance FROM pl UNION ALL SELECT cl.type, pl.parent, distance + 1 FROM cl JOIN pl ON cl.ancestor = pl.type WHERE pl.parent IS NOT NULL)
SELECT type, ancestor, min(distance) AS distance FROM cl GROUP BY type, ancestor""")
def type_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_places(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, {EDGES}, x AS (SELECT id, subject_id, object_id, predicate, split_part(subject_id, ':', 1) AS st, split_part(object_id, ':', 1) AS ot FROM e WHERE predicate <> 'placed_by')
SELECT id, 'subject' AS side FROM x WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.type = st AND ancestor = CASE predicate WHEN 'located_in' THEN 'customer' ELSE 'place' END)
UNION ALL SELECT id, 'object' FROM x WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.type = ot AND ancestor = 'place')""")
def domain_range_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("predicate <> 'placed_by'")
    ids = e.select(F.col("subject_id").alias("id")).union(e.select("object_id")).distinct()
    rules = spark.createDataFrame([("located_in", ["customer"], ["place"]), ("part_of", ["place"], ["place"])], "predicate string, domain array<string>, range array<string>")
    return graph.violations(e, ids.withColumn("entity_type", F.split("id", ":")[0]), spark.createDataFrame(TYPES, "type string, parent string"), rules)


@query(f"""WITH {PLACES_SQL}, af AS (SELECT 'supplier:' || s_suppkey AS type, 'nation:' || CASE WHEN s_suppkey % 5 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END AS parent FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 'segment:' || c_mktsegment, 'place' FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT type, parent FROM pl WHERE NOT starts_with(type, 'supplier:')),
j AS (SELECT coalesce(pl.type, af.type) AS symbol, CASE WHEN pl.type IS NULL THEN 'entity_added' WHEN af.type IS NULL THEN 'entity_removed' WHEN pl.parent IS DISTINCT FROM af.parent THEN 'entity_parent_changed' END AS change FROM pl FULL JOIN af ON pl.type = af.type)
SELECT symbol, change, CASE WHEN change = 'entity_added' THEN 'compatible' ELSE 'breaking' END AS classification FROM j WHERE change IS NOT NULL""")
def ontology_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release in which suppliers move or go, and segments of customers come."""
    before, k = _places(spark, sf_dir), F.col("s_suppkey")
    moved = table(spark, sf_dir, "supplier").where(k % 7 != 0).select(F.concat(F.lit("supplier:"), k).alias("type"), F.concat(F.lit("nation:"), F.when(k % 5 == 0, (F.col("s_nationkey") + 1) % 25).otherwise(F.col("s_nationkey"))).alias("parent"))
    new = table(spark, sf_dir, "customer").select(F.concat(F.lit("segment:"), "c_mktsegment").alias("type"), F.lit("place").alias("parent")).distinct()
    return graph.ontology_diff(before, before.where(~F.col("type").startswith("supplier:")).unionByName(moved).unionByName(new))


CANDIDATES = "ca AS (SELECT l.doc_id AS id, 'p' || (l.doc_id % 6) AS predicate, CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status, l.doc_id % 11 = 0 AS auto_approved, (l.doc_id % 100) / 100.0::DOUBLE AS confidence FROM labels l), rv AS (SELECT doc_id AS id FROM labels WHERE toxic = 1 AND quality = 1)"
PRECISION = """pr AS (SELECT predicate, count(CASE WHEN status = 'approved' AND rv.id IS NULL THEN 1 END) AS approved, count(CASE WHEN status = 'rejected' OR rv.id IS NOT NULL THEN 1 END) AS rejected FROM ca LEFT JOIN rv USING (id) WHERE NOT auto_approved GROUP BY predicate)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(i.alias("id"), F.concat(F.lit("p"), (i % 6).cast("string")).alias("predicate"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("status"), (i % 11 == 0).alias("auto_approved"), ((i % 100) / 100.0).alias("confidence"))


def _precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    assertions = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("source_candidate_id"), F.when(F.col("toxic") == 1, F.lit(1)).alias("revoked_at"))
    return graph.review_precision(_candidates(spark, sf_dir), assertions)


@query(f"WITH {CANDIDATES}, {PRECISION} SELECT predicate, approved, rejected, round(approved / (approved + rejected), 6) AS precision FROM pr")
def review_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _precision(spark, sf_dir).withColumn("precision", F.round("precision", 6))


@query(f"WITH {CANDIDATES}, {PRECISION} SELECT id FROM (SELECT id, predicate, confidence FROM ca WHERE id % 3 = 0) c JOIN pr USING (predicate) WHERE confidence >= 0.8 AND predicate IN ('p0', 'p3') AND approved + rejected >= 20 AND approved / (approved + rejected) >= 0.5")
def auto_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("p0", "low", "not_required"), ("p3", "low", "not_required"), ("p1", "high", "required")], "predicate string, risk string, review string")
    proposed = _candidates(spark, sf_dir).where("id % 3 = 0").withColumn("status", F.lit("proposed"))
    return graph.auto_approvable(proposed, rules, _precision(spark, sf_dir), least=0.5)


@query(f"WITH {CANDIDATES} SELECT id, review_risk, confidence, CAST(row_number() OVER (ORDER BY r, confidence DESC NULLS LAST, id) AS INT) AS position FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS review_risk, CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS r, CASE WHEN id % 13 = 0 THEN NULL ELSE confidence END AS confidence FROM ca) QUALIFY position <= 50")
def triage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.when(F.col("id") % 3 == 0, "low").when(F.col("id") % 3 == 1, "high").otherwise("medium")
    c = _candidates(spark, sf_dir).select("id", risk.alias("review_risk"), F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("confidence")).alias("confidence"), F.col("id").alias("created_at"))
    return graph.triage(c, 50).drop("created_at")


@query(f"WITH {SEEN}, ev AS (SELECT l_orderkey AS candidate_id, l_partkey % (SELECT count(*) FROM documents) AS unit_id FROM lineitem) SELECT o_orderkey AS candidate_id FROM orders WHERE o_orderkey NOT IN (SELECT candidate_id FROM ev WHERE unit_id NOT IN (SELECT unit_id FROM seen))")
def candidate_visibility_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    n = u.agg(F.count("*").alias("n"))
    evidence = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_orderkey").alias("candidate_id"), (F.col("l_partkey") % F.col("n")).alias("unit_id"))
    return fully_evidenced(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id")), "candidate_id", evidence, visible(u, CONTEXT))


@query("SELECT o_custkey AS object_id, o_orderkey AS revision_id, coalesce(o_orderdate >= max(o_orderdate) OVER (PARTITION BY o_custkey), true) AS is_latest FROM orders")
def is_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("modified_at"))
    return ingest.is_latest(r, "object_id").select("object_id", "revision_id", "is_latest")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderkey", "o_orderstatus")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE ts END DESC NULLS LAST, ts DESC, event_id DESC) = 1")
def keep_one_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("event_type") != "error", F.col("ts"))
    return ingest.keep_one(table(spark, sf_dir, "events"), "user_id", done.desc_nulls_last(), F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("""WITH p AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS v FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -1 - item_id, md5(text) FROM benchmark),
w AS (SELECT doc_id, md5(text) AS v FROM documents)
SELECT count(CASE WHEN w.doc_id IS NULL THEN 1 END) AS deleted, count(CASE WHEN w.doc_id IS NOT NULL AND (p.doc_id IS NULL OR p.v IS DISTINCT FROM w.v) THEN 1 END) AS changed, count(CASE WHEN w.doc_id IS NOT NULL THEN 1 END) AS total FROM p FULL JOIN w ON p.doc_id = w.doc_id""")
def lexical_rebuild_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("v"))
    gone = table(spark, sf_dir, "benchmark").select((F.lit(-1) - F.col("item_id")).alias("doc_id"), F.md5("text").alias("v"))
    return ingest.rebuild_diff(old.unionByName(gone), d.select("doc_id", F.md5("text").alias("v")), "doc_id", "v")


VECTORS = "un AS (SELECT doc_id AS unit_id, md5(text) AS text_hash FROM documents), ve AS (SELECT doc_id AS unit_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE md5(text) END AS vector_hash FROM documents WHERE doc_id % 3 <> 0)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("unit_id"), F.md5("text").alias("text_hash")), d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("unit_id"), F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.md5("text")).alias("vector_hash"))


@query(f"WITH {VECTORS} SELECT unit_id, text_hash FROM un LEFT JOIN ve USING (unit_id) WHERE vector_hash IS DISTINCT FROM text_hash")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.pending(*_vectors(spark, sf_dir))


@query(f"WITH {VECTORS} SELECT count(*) AS total, count(CASE WHEN vector_hash = text_hash THEN 1 END) AS done FROM un LEFT JOIN ve USING (unit_id)")
def embedding_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.progress(*_vectors(spark, sf_dir))


@query("""WITH seen AS (SELECT DISTINCT CAST(day(ts) AS INT) AS scan_id, user_id AS path FROM events WHERE day(ts) <> 12),
sc AS (SELECT CAST(i AS INT) AS scan_id, i % 6 <> 0 AS complete FROM range(1, 31) r(i)),
n AS (SELECT sc.scan_id, sum(CASE WHEN complete AND c > 0 THEN 1 ELSE 0 END) OVER (ORDER BY sc.scan_id) AS upto FROM sc LEFT JOIN (SELECT scan_id, count(*) AS c FROM seen GROUP BY scan_id) USING (scan_id)),
l AS (SELECT path, max(scan_id) AS scan_id FROM seen GROUP BY path)
SELECT path, CAST((SELECT max(upto) FROM n) - upto AS BIGINT) AS absences, (SELECT max(upto) FROM n) - upto >= 2 AS is_deleted FROM l JOIN n USING (scan_id)""")
def deletion_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").where(F.dayofmonth("ts") != 12).select(F.dayofmonth("ts").alias("scan_id"), F.col("user_id").alias("path")).distinct()
    scans = spark.range(1, 31).select(F.col("id").cast("int").alias("scan_id"), (F.col("id") % 6 != 0).alias("complete"))
    return ingest.deletion_grace(scans, seen)


@query("SELECT conv_id, count(*) AS n_messages, string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id")
def thread_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.thread_fold(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("""SELECT user_id, arg_max(props, (ts, event_id)) AS payload, arg_max(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END, (ts, event_id)) = 'delete' AS is_deleted,
count(DISTINCT (coalesce(props, ''), event_type = 'error')) AS n_versions FROM events GROUP BY user_id""")
def event_fold_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("operation", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))
    return ingest.folded_events(e, "user_id", "ts", "event_id", "props", "operation")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions with gaps of half an hour."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


STATUS = ("documents", "embeddings", "labels", "benchmark", "conversations", "pages", "orders")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in STATUS))
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in STATUS:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'doc_' || substr(sha256('quern' || chr(0) || doc_id), 1, 32) AS id, doc_id FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.functions.text import stable_id

    return table(spark, sf_dir, "documents").select(stable_id("doc", "quern", "doc_id").alias("id"), "doc_id")


@query("SELECT fingerprint, count(*) AS occurrence_count, arg_max(event_id, (ts, event_id)) AS payload FROM (SELECT *, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS fingerprint FROM events) GROUP BY fingerprint")
def discovery_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(graph.fingerprint("user_id", "event_type").alias("fingerprint"), F.col("ts").alias("seen_at"), F.col("event_id").alias("id"), F.col("event_id").alias("payload"))
    return graph.proposals(e)


@query("SELECT o_orderkey AS position, doc_id, lang FROM orders JOIN documents ON doc_id = o_custkey")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("doc_id"))
    return ingest.ordered_lookup(ids, table(spark, sf_dir, "documents"), "doc_id").select("position", "doc_id", "lang")
