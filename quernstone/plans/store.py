"""Queries of the content store, of reviews and the queue: objects are customers, their revisions orders, and units line items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import answer, content, evaluate, review
from quernstone.plans.registry import CONTEXT, UNITS, query, stored, table, units
from quernstone.sources import listing, snapshots
from quernstone.sources.sinks import shared_dir

STORE = """obj AS (SELECT o_custkey AS object_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS current_revision_id FROM orders GROUP BY o_custkey),
rev AS (SELECT o_orderkey AS revision_id, o_custkey AS object_id, md5(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders),
art AS (SELECT o_orderkey AS artifact_id, o_orderkey AS revision_id, o_orderpriority AS file_name FROM orders),
ext AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber % 2 AS extraction_id, l_orderkey AS artifact_id, l_linenumber % 2 = 1 AS active FROM lineitem),
un AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS unit_id, l_orderkey AS artifact_id, l_orderkey * 10 + l_linenumber % 2 AS extraction_id, l_partkey AS document_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS title, l_linestatus || ' ' || l_partkey AS body,
  CASE WHEN l_suppkey % 3 = 0 THEN ['lang:en'] ELSE ['tier:0', 'lang:fr'] END AS acl_scopes, 'n' || l_suppkey % 5 AS acl_snapshot_id FROM lineitem),
doc AS (SELECT p_partkey AS document_id, p_name AS title FROM part),
cur AS (SELECT un.*, file_name, rev.revision_id, rev.object_id, sha256 FROM un JOIN art USING (artifact_id) JOIN rev ON art.revision_id = rev.revision_id JOIN obj ON rev.object_id = obj.object_id AND rev.revision_id = current_revision_id WHERE un.extraction_id IN (SELECT extraction_id FROM ext WHERE active))"""


class Store:
    """The store's tables over the given ones."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        o, line, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
        self.objects = o.groupBy(F.col("o_custkey").alias("object_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current_revision_id"))
        self.revisions = o.select(F.col("o_orderkey").alias("revision_id"), F.col("o_custkey").alias("object_id"), F.md5(F.col("o_orderkey").cast("string")).alias("sha256"))
        self.artifacts = o.select(F.col("o_orderkey").alias("artifact_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderpriority").alias("file_name"))
        k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
        extraction = (k * 10 + n % 2).alias("extraction_id")
        self.extractions = line.select(extraction, k.alias("artifact_id"), (n % 2 == 1).alias("active")).distinct()
        scopes = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("lang:en"))).otherwise(F.array(F.lit("tier:0"), F.lit("lang:fr")))
        self.units = line.select(
            (k * 1000 + n * 100 + p % 100).alias("unit_id"), k.alias("artifact_id"), extraction, p.alias("document_id"), F.when(n % 3 != 0, F.col("l_returnflag")).alias("title"),
            F.concat_ws(" ", "l_linestatus", p.cast("string")).alias("body"), scopes.alias("acl_scopes"), F.concat(F.lit("n"), (F.col("l_suppkey") % 5).cast("string")).alias("acl_snapshot_id"),
        )
        self.documents = part.select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("title"))
        self.line = line

    def current(self) -> DataFrame:
        return content.current(self.units, self.extractions, self.artifacts, self.revisions, self.objects)


@query(f"WITH {STORE} SELECT unit_id, artifact_id, file_name, revision_id, object_id FROM cur")
def current_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).current().select("unit_id", "artifact_id", "file_name", "revision_id", "object_id")


@query(f"WITH {STORE} SELECT unit_id, cur.document_id, coalesce(cur.title, doc.title, '') AS title, body, sha256 AS source_hash FROM cur LEFT JOIN doc ON cur.document_id = doc.document_id")
def embeddable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return content.embeddable(s.current(), s.documents)


SPACES = [("s0", "first", 64, "active"), ("s1", "second", 64, "shadow"), ("s2", "third", 32, "shadow"), ("s3", "fourth", 64, "shadow")]
SPACES_SQL = "sp AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in SPACES) + ") AS t(space_id, name, dim, status))"
VECTORS_SQL = "ve AS (SELECT 's' || l_linenumber % 3 AS space_id, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS unit_id FROM lineitem)"


def _spaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPACES, "space_id string, name string, dim int, status string")


def _vectors(s: Store) -> DataFrame:
    return s.line.select(F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("space_id"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("unit_id"))


@query(f"WITH {STORE}, {SPACES_SQL}, {VECTORS_SQL} SELECT space_id, unit_id FROM ve WHERE space_id IN (SELECT space_id FROM sp WHERE status = 'active') AND unit_id IN (SELECT unit_id FROM cur)")
def eligible_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return content.eligible(_vectors(s), s.current(), _spaces(spark))


@query(f"WITH {STORE} SELECT artifact_id, file_name, revision_id, object_id, revision_id = current_revision_id AS is_current, b.document_id, doc.title FROM art JOIN rev USING (revision_id) JOIN obj USING (object_id) LEFT JOIN (SELECT o_orderkey AS artifact_id, o_custkey AS document_id FROM orders WHERE o_orderstatus <> 'P') b USING (artifact_id) LEFT JOIN doc ON doc.document_id = b.document_id")
def artifact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    bridge = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("document_id"))
    return content.artifact_view(s.artifacts, s.revisions, s.objects, bridge, s.documents)


@query(f"WITH {SPACES_SQL}, {VECTORS_SQL}, al AS (SELECT space_id FROM ve UNION ALL SELECT 's' || label % 3 FROM embeddings) SELECT space_id, status, count(al.space_id) AS vectors FROM sp LEFT JOIN al USING (space_id) GROUP BY space_id, status")
def vectors_by_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("space_id"))
    return content.vectors_by_space(_spaces(spark), [_vectors(Store(spark, sf_dir)), other])


@query(f"WITH {SPACES_SQL}, {VECTORS_SQL}, n AS (SELECT space_id, count(*) AS n FROM ve GROUP BY space_id), a AS (SELECT coalesce(bool_or(space_id = 's1' AND n >= 1000), false) AS ok FROM sp LEFT JOIN n USING (space_id)) SELECT space_id, CASE WHEN space_id = 's1' AND ok THEN 'active' WHEN ok AND status = 'active' THEN 'shadow' ELSE status END AS status FROM sp, a")
def space_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = content.vectors_by_space(_spaces(spark), [_vectors(Store(spark, sf_dir))])
    return content.activated(_spaces(spark), F.col("space_id") == "s1", counts, 1000)


@query("""WITH l AS (SELECT label, max(len(embedding)) AS dim FROM embeddings GROUP BY label), sp AS (SELECT 's' || label AS space_id, 'name ' || label AS name, CAST(dim AS INT) AS dim, CASE WHEN label % 4 = 0 THEN 'active' ELSE 'shadow' END AS status FROM l WHERE label % 3 <> 2),
i AS (SELECT 's' || label AS space_id, 'name ' || CASE WHEN label % 5 = 0 THEN label + 1 ELSE label END AS name, CAST(2 * dim AS INT) AS dim, 'shadow' AS status FROM l),
g AS (SELECT i.* FROM i LEFT JOIN sp ON sp.name = i.name WHERE sp.space_id IS NULL OR sp.space_id = i.space_id)
SELECT space_id, name, dim, status FROM sp WHERE space_id NOT IN (SELECT space_id FROM g) UNION ALL SELECT g.space_id, g.name, g.dim, CASE WHEN sp.status = 'active' THEN 'active' ELSE g.status END FROM g LEFT JOIN sp USING (space_id)""")
def space_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space for each label, saved again with twice the dimension, a fifth of them under the name of another."""
    k = F.col("label")
    labels = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("dim"))
    old = labels.where(k % 3 != 2).select(F.concat(F.lit("s"), k).alias("space_id"), F.concat(F.lit("name "), k).alias("name"), "dim", F.when(k % 4 == 0, "active").otherwise("shadow").alias("status"))
    new = labels.select(F.concat(F.lit("s"), k).alias("space_id"), F.concat(F.lit("name "), F.when(k % 5 == 0, k + 1).otherwise(k)).alias("name"), (2 * F.col("dim")).alias("dim"), F.lit("shadow").alias("status"))
    return content.saved_spaces(old, new)


@query("""WITH old AS (SELECT 's' || label % 3 AS space_id, vec_id AS unit_id, embedding[1] AS head FROM embeddings WHERE label % 2 = 0),
inc AS (SELECT 's' || label % 3 AS space_id, vec_id - vec_id % 2 AS unit_id, vec_id AS seq, embedding[2] AS head FROM embeddings WHERE label % 3 <> 2),
n AS (SELECT space_id, unit_id, arg_max(head, seq) AS head FROM inc GROUP BY space_id, unit_id)
SELECT space_id, unit_id, head FROM n UNION ALL SELECT space_id, unit_id, head FROM old WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.space_id = old.space_id AND n.unit_id = old.unit_id)""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("space_id", F.concat(F.lit("s"), (F.col("label") % 3).cast("string")))
    old = e.where("label % 2 = 0").select("space_id", F.col("vec_id").alias("unit_id"), F.col("embedding")[0].alias("head"), "embedding")
    new = e.select("space_id", (F.col("vec_id") - F.col("vec_id") % 2).alias("unit_id"), F.col("embedding")[1].alias("head"), "embedding", F.col("vec_id").alias("seq"))
    # the third space takes 32 dimensions, which these vectors don't have
    return content.upserted_vectors(old, new, _spaces(spark)).drop("embedding")


@query(f"WITH {STORE} SELECT unit_id, CASE WHEN o_custkey % 7 = 0 THEN ['tier:1'] ELSE acl_scopes END AS acl_scopes, CASE WHEN o_custkey % 7 = 0 THEN 'new' ELSE acl_snapshot_id END AS acl_snapshot_id FROM un JOIN orders ON artifact_id = o_orderkey")
def acl_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    changed = s.objects.where("object_id % 7 = 0").select("object_id", F.array(F.lit("tier:1")).alias("scopes"), F.lit("new").alias("snapshot_id"))
    return content.cascaded(s.units, s.artifacts, s.revisions, changed).select("unit_id", "acl_scopes", "acl_snapshot_id")


@query(f"WITH {STORE} SELECT artifact_id AS assertion_id, list(DISTINCT acl_snapshot_id ORDER BY acl_snapshot_id) AS snapshot_ids FROM un GROUP BY artifact_id")
def evidence_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = Store(spark, sf_dir).units
    return content.evidence_snapshots(u.select(F.col("artifact_id").alias("assertion_id"), "unit_id").distinct(), u)


PACKETS = "pk AS (SELECT event_id AS packet_id, user_id AS object_id, md5(CAST(user_id % 3 AS VARCHAR) || event_type) AS sha256, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n_units, ts AS seq FROM events), st AS (SELECT user_id AS object_id, md5(CAST(user_id % 3 AS VARCHAR) || 'view') AS sha FROM events WHERE user_id % 4 <> 0 GROUP BY user_id)"


@query(f"""WITH {PACKETS}, l AS (SELECT object_id, arg_max(packet_id, (seq, packet_id)) AS last FROM pk GROUP BY object_id),
o AS (SELECT packet_id, object_id, CASE WHEN packet_id <> last THEN 'superseded' WHEN n_units = 0 THEN 'tombstone' WHEN st.object_id IS NULL THEN 'inserted' WHEN sha256 = sha THEN 'unchanged' ELSE 'replaced' END AS outcome FROM pk JOIN l USING (object_id) LEFT JOIN st USING (object_id))
SELECT packet_id, object_id, outcome, outcome IN ('inserted', 'replaced', 'tombstone') AS is_current FROM o""")
def packet_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    p = e.select(F.col("event_id").alias("packet_id"), u.alias("object_id"), F.md5(F.concat((u % 3).cast("string"), "event_type")).alias("sha256"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("n_units"), F.col("ts").alias("seq"))
    known = e.where("user_id % 4 <> 0").select(u.alias("object_id")).distinct()
    revisions = known.select(F.col("object_id").alias("revision_id"), F.md5(F.concat((F.col("object_id") % 3).cast("string"), F.lit("view"))).alias("sha256"))
    return content.ingested(p, known.withColumn("current_revision_id", F.col("object_id")), revisions)


@query(f"""WITH {STORE}, ac AS (SELECT artifact_id, extraction_id AS a FROM ext WHERE active),
att AS (SELECT o_orderkey * 10 + 5 AS extraction_id, o_orderkey AS artifact_id, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey * 10 ELSE o_orderkey * 10 + 1 END AS expected, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS quality FROM orders)
SELECT extraction_id, artifact_id, CASE WHEN coalesce(quality, 0) < 0.7 THEN 'rejected' WHEN a IS DISTINCT FROM expected THEN 'conflict' ELSE 'activated' END AS outcome FROM att LEFT JOIN ac USING (artifact_id)""")
def reextraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    attempts = table(spark, sf_dir, "orders").select((k * 10 + 5).alias("extraction_id"), k.alias("artifact_id"), F.when(k % 6 == 0, k * 10).otherwise(k * 10 + 1).alias("expected_active_id"), F.when(k % 11 != 0, (k % 100) / 100.0).alias("quality"))
    return content.reextracted(attempts, Store(spark, sf_dir).extractions)


COUNTED = (("source_objects", "obj", "objects", "true"), ("revisions", "rev", "revisions", "true"), ("artifacts", "art", "artifacts", "true"), ("active_extractions", "ext", "extractions", "active"), ("content_units", "un", "units", "true"))


@query(f"WITH {STORE} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t} WHERE {w}" for n, t, _, w in COUNTED) + """ UNION ALL SELECT 'lexical_units', count(*) FROM cur UNION ALL SELECT 'assertion_candidates', count(*) FROM labels UNION ALL SELECT 'approved_assertions', count(*) FROM labels WHERE quality = 1
UNION ALL SELECT 'queued_jobs', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'failed_jobs', count(*) FROM events WHERE event_type = 'error'""")
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e, c = Store(spark, sf_dir), table(spark, sf_dir, "events"), table(spark, sf_dir, "labels")
    rows = {n: getattr(s, t).where(w) for n, _, t, w in COUNTED}
    rows |= {"lexical_units": s.current(), "assertion_candidates": c, "approved_assertions": c.where("quality = 1"), "queued_jobs": e.where("event_type = 'view'"), "failed_jobs": e.where("event_type = 'error'")}
    return content.counters(rows)


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN lang WHEN 2 THEN lang || chr(9) || source || chr(10) || 'x' WHEN 3 THEN '[image: ' || source || ']' ELSE '' END AS body FROM documents""")
def block_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    cell = lambda c: F.struct(c.alias("text"))
    cells = F.array(F.array(cell(F.col("lang")), cell(F.col("source"))), F.array(cell(F.lit("x"))))
    block = (
        F.when(i % 5 == 0, F.to_json(F.struct("text", F.struct(cells.alias("cells")).alias("table"))))
        .when(i % 5 == 1, F.to_json(F.struct(F.lit("").alias("text"), F.col("lang").alias("markdown"))))
        .when(i % 5 == 2, F.to_json(F.struct(F.struct(cells.alias("cells")).alias("table"))))
        .when(i % 5 == 3, F.to_json(F.struct(F.struct(F.col("source").alias("filename")).alias("imageData"))))
        .otherwise(F.lit("{}"))
    )
    return content.rendered(table(spark, sf_dir, "documents").select("doc_id", block.alias("block"))).select("doc_id", "body")


REVIEWS = f"""{UNITS}, cd AS (SELECT doc_id AS candidate_id, CASE WHEN doc_id % 9 = 0 THEN 'approved' ELSE 'proposed' END AS status, CASE WHEN doc_id % 8 = 0 THEN 'approves' ELSE 'mentions' END AS predicate, CASE WHEN doc_id % 7 = 0 THEN 'high' ELSE 'low' END AS review_risk, [doc_id + 1, doc_id + 2] AS contradicts FROM labels),
ce AS (SELECT doc_id AS candidate_id, doc_id AS unit_id FROM labels WHERE doc_id % 4 <> 0 UNION SELECT doc_id, doc_id + 5 FROM labels WHERE doc_id % 4 = 1),
de AS (SELECT doc_id AS candidate_id, 1 AS seq, CASE WHEN quality = 1 THEN 'approve' ELSE 'reject' END AS action, CASE WHEN doc_id % 5 = 0 THEN [doc_id + 3] WHEN doc_id % 3 = 0 THEN [doc_id + 1] ELSE [] END AS supersedes FROM labels),
ev AS (SELECT candidate_id, count(*) AS n, count(CASE WHEN u.unit_id IS NULL OR len(list_filter(acl_scopes, lambda s: NOT list_contains({list(CONTEXT)}, s))) > 0 THEN 1 END) AS hidden, list_sort(list_distinct(flatten(list(acl_scopes)))) AS scopes, list(DISTINCT 'm' || u.unit_id % 4 ORDER BY 'm' || u.unit_id % 4) AS snaps FROM ce LEFT JOIN u USING (unit_id) GROUP BY candidate_id),
oc AS (SELECT candidate_id, status, scopes, snaps, supersedes, CASE WHEN coalesce(hidden, 0) > 0 THEN 'not_found' WHEN status <> 'proposed' THEN 'conflict' WHEN action = 'approve' AND (review_risk = 'high' OR predicate = 'approves') AND coalesce(n, 0) = 0 THEN 'evidence_required' WHEN action = 'approve' AND len(list_filter(supersedes, lambda s: NOT list_contains(contradicts, s))) > 0 THEN 'not_contradicted' WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS outcome FROM cd JOIN de USING (candidate_id) LEFT JOIN ev USING (candidate_id))"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i, c = F.col("doc_id"), table(spark, sf_dir, "labels")
    candidates = c.select(i.alias("candidate_id"), F.when(i % 9 == 0, "approved").otherwise("proposed").alias("status"), F.when(i % 8 == 0, "approves").otherwise("mentions").alias("predicate"), F.when(i % 7 == 0, "high").otherwise("low").alias("review_risk"), F.array(i + 1, i + 2).alias("contradicts"))
    evidence = c.where("doc_id % 4 <> 0").select(i.alias("candidate_id"), i.alias("unit_id")).union(c.where("doc_id % 4 = 1").select(i, i + 5)).distinct()
    none = F.array().cast("array<bigint>")
    decisions = c.select(i.alias("candidate_id"), F.lit(1).alias("seq"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("action"), F.when(i % 5 == 0, F.array(i + 3)).when(i % 3 == 0, F.array(i + 1)).otherwise(none).alias("supersedes"))
    u = units(spark, sf_dir).withColumn("acl_snapshot_id", F.concat(F.lit("m"), (F.col("unit_id") % 4).cast("string")))
    return review.reviewed(candidates, evidence, u, decisions, CONTEXT), decisions


@query(f"WITH {REVIEWS} SELECT candidate_id, outcome, CASE WHEN outcome IN ('approved', 'rejected') THEN outcome ELSE status END AS status, CASE WHEN outcome = 'approved' THEN CASE WHEN len(coalesce(scopes, [])) > 0 THEN scopes ELSE {sorted(CONTEXT)} END END AS acl_scopes, CASE WHEN outcome = 'approved' THEN coalesce(snaps, []) END AS snapshot_ids FROM oc".replace("coalesce(scopes, [])", "coalesce(scopes, []::VARCHAR[])").replace("coalesce(snaps, [])", "coalesce(snaps, []::VARCHAR[])"))
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[0]


@query(f"""WITH {REVIEWS}, b AS (SELECT unnest(supersedes) AS assertion_id, candidate_id FROM oc WHERE outcome = 'approved'), by_ AS (SELECT assertion_id, min(candidate_id) AS superseded_by FROM b GROUP BY assertion_id)
SELECT doc_id AS assertion_id, CASE WHEN doc_id % 6 = 0 THEN 'revoked' WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN doc_id % 10 = 0 THEN 'revoked' ELSE 'active' END AS status, CASE WHEN doc_id % 6 <> 0 THEN superseded_by END AS superseded_by FROM documents LEFT JOIN by_ ON doc_id = assertion_id""")
def assertion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, decisions = _decided(spark, sf_dir)
    i, d = F.col("doc_id"), table(spark, sf_dir, "documents")
    assertions = d.select(i.alias("assertion_id"), F.when(i % 6 == 0, "revoked").otherwise("active").alias("status"))
    return review.assertion_states(assertions, outcomes, decisions.withColumn("seq", F.col("candidate_id")), d.where("doc_id % 10 = 0").select(i.alias("assertion_id")))


@query("""WITH ty AS (SELECT 'nation:' || n_nationkey AS type, CASE WHEN n_nationkey % 6 = 5 THEN 'region:none' ELSE 'region:' || n_regionkey END AS parent FROM nation UNION ALL SELECT 'region:' || r_regionkey, NULL FROM region),
pr AS (SELECT p_partkey AS k, 'p' || p_partkey AS predicate, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE ['nation:' || p_partkey % 30] END AS domain, ['region:' || p_partkey % 6] AS range, CASE WHEN p_partkey % 3 = 0 THEN 'p' || (p_partkey + 40) END AS inverse,
  p_partkey % 11 <> 0 AS given, CASE WHEN p_partkey % 13 = 0 THEN 'guess' ELSE 'semantic' END AS extraction, CASE WHEN p_partkey % 4 = 0 THEN 'required' WHEN p_partkey % 17 = 0 THEN 'never' ELSE 'conditional' END AS review, CASE WHEN p_partkey % 19 = 0 THEN 'huge' ELSE 'low' END AS risk FROM part)
SELECT type AS symbol, 'unknown parent' AS error FROM ty WHERE parent IS NOT NULL AND parent NOT IN (SELECT type FROM ty)
UNION ALL SELECT predicate, 'empty domain' FROM pr WHERE len(domain) = 0 UNION ALL SELECT predicate, 'unknown domain' FROM pr WHERE len(domain) > 0 AND domain[1] NOT IN (SELECT type FROM ty)
UNION ALL SELECT predicate, 'unknown range' FROM pr WHERE range[1] NOT IN (SELECT type FROM ty) UNION ALL SELECT predicate, 'inverse not given' FROM pr WHERE NOT given
UNION ALL SELECT predicate, 'unknown inverse' FROM pr WHERE inverse IS NOT NULL AND inverse NOT IN (SELECT predicate FROM pr)
UNION ALL SELECT predicate, 'invalid extraction' FROM pr WHERE extraction = 'guess' UNION ALL SELECT predicate, 'invalid review' FROM pr WHERE review = 'never' UNION ALL SELECT predicate, 'invalid risk' FROM pr WHERE risk = 'huge'
UNION ALL SELECT predicate, 'review not in the policy' FROM pr WHERE review = 'required' AND k % 8 <> 0 AND k % 23 <> 0 UNION ALL SELECT predicate, 'policy without review' FROM pr WHERE review <> 'required' AND k % 23 = 0""")
def ontology_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types are nations and regions, predicates are parts; some of each break the contract."""
    k, n = F.col("p_partkey"), F.col("n_nationkey")
    types = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), n).alias("type"), F.when(n % 6 == 5, "region:none").otherwise(F.concat(F.lit("region:"), "n_regionkey")).alias("parent"))
    types = types.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("type"), F.lit(None).cast("string").alias("parent")))
    predicates = table(spark, sf_dir, "part").select(
        k, F.concat(F.lit("p"), k).alias("predicate"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("nation:"), k % 30))).alias("domain"), F.array(F.concat(F.lit("region:"), k % 6)).alias("range"),
        F.when(k % 3 == 0, F.concat(F.lit("p"), k + 40)).alias("inverse"), (k % 11 != 0).alias("inverse_given"), F.when(k % 13 == 0, "guess").otherwise("semantic").alias("extraction"),
        F.when(k % 4 == 0, "required").when(k % 17 == 0, "never").otherwise("conditional").alias("review"), F.when(k % 19 == 0, "huge").otherwise("low").alias("risk"),
    )
    return review.contract_errors(types, predicates, predicates.where((k % 8 == 0) | (k % 23 == 0)).select("predicate"))


JOBS = "jb AS (SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'succeeded' END AS status, user_id % 3 AS priority, ts AS available_at, event_id % 7 AS attempts, 5 AS max_attempts FROM events)"
NOON = "2024-01-15 12:00:00"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(i.alias("job_id"), F.when(kind == "error", "running").when(kind == "view", "queued").otherwise("succeeded").alias("status"), (F.col("user_id") % 3).alias("priority"), F.col("ts").alias("available_at"), (i % 7).alias("attempts"), F.lit(5).alias("max_attempts"))


@query(f"WITH {JOBS} SELECT job_id, CAST(row_number() OVER (ORDER BY priority, job_id) AS INT) AS place FROM jb WHERE status = 'queued' AND available_at <= TIMESTAMP '{NOON}' QUALIFY place <= 25")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.claimed(_jobs(spark, sf_dir), F.lit(NOON).cast("timestamp_ntz"), 25)


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN attempts >= 5 THEN available_at ELSE TIMESTAMP '{NOON}' + to_seconds(CAST(least(300, pow(2, attempts)) AS INT)) END AS available_at FROM jb WHERE status = 'running'")
def job_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.failed(_jobs(spark, sf_dir), F.lit(NOON).cast("timestamp_ntz"))


@query("""WITH q AS (SELECT doc_id AS key, CASE doc_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, CAST(doc_id % 3 AS INT) AS attempts, 'old' AS payload FROM documents),
i AS (SELECT user_id AS key, arg_max(event_type, event_id) AS new FROM events GROUP BY user_id)
SELECT coalesce(q.key, i.key) AS key, CASE WHEN i.key IS NOT NULL AND (q.key IS NULL OR status IN ('succeeded', 'failed')) THEN 'queued' ELSE status END AS status, CASE WHEN i.key IS NOT NULL AND (q.key IS NULL OR status IN ('succeeded', 'failed')) THEN 0 ELSE attempts END AS attempts, CASE WHEN i.key IS NOT NULL THEN new ELSE payload END AS payload FROM q FULL JOIN i ON q.key = i.key""")
def job_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    states = F.when(i % 4 == 0, "queued").when(i % 4 == 1, "running").when(i % 4 == 2, "succeeded").otherwise("failed")
    jobs = table(spark, sf_dir, "documents").select(i.alias("key"), states.alias("status"), (i % 3).cast("int").alias("attempts"), F.lit("old").alias("payload"))
    incoming = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return review.enqueued(jobs, incoming, F.lit(NOON).cast("timestamp_ntz"))


@query("""WITH h AS (SELECT user_id AS query_id, bool_or(event_type = 'view') AS lex, bool_or(event_type = 'click') AS vec, bool_or(event_type = 'error' AND user_id % 2 = 0) AS d, bool_or(event_type = 'purchase') AS r FROM events GROUP BY user_id)
SELECT query_id, list_filter(['acl_prefilter', 'lexical', CASE WHEN vec OR d THEN 'vector' END, CASE WHEN lex AND vec THEN 'fusion' END, CASE WHEN r THEN 'rerank' END], lambda s: s IS NOT NULL) AS stages FROM h""")
def trace_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    channels = F.when(kind == "view", F.array(F.lit("lexical"))).when(kind == "click", F.array(F.lit("vector"))).otherwise(F.array().cast("array<string>"))
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), channels.alias("channels"), ((kind == "error") & (F.col("user_id") % 2 == 0)).alias("degraded"), (kind == "purchase").alias("reranked"))
    return review.stages(hits)


RESULTS = "rs AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'new' END AS variant, event_type AS category, CASE WHEN event_id % 10 = 3 THEN 'boom' END AS error, CASE WHEN event_id % 10 = 3 THEN 0.0::DOUBLE ELSE (user_id % 5) / 4.0::DOUBLE END AS recall, value AS latency_ms FROM events)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(F.when(i % 2 == 0, "base").otherwise("new").alias("variant"), F.col("event_type").alias("category"), F.when(i % 10 == 3, "boom").alias("error"), ((u % 5) / 4.0).alias("recall"), ((u % 5) / 4.0).alias("reciprocal_rank"), ((u % 5) / 4.0).alias("ndcg"), F.col("value").alias("latency_ms"))


@query(f"WITH {RESULTS} SELECT variant, category, count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(recall), 6) AS reciprocal_rank, round(avg(recall), 6) AS ndcg, count(error) AS failed, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, max(latency_ms) AS max FROM rs GROUP BY GROUPING SETS ((variant), (variant, category))")
def variant_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.variant_results(_results(spark, sf_dir))


@query(f"""WITH {RESULTS}, v AS (SELECT variant, avg(recall) AS recall, count(error) AS failed, quantile_cont(latency_ms, 0.95) AS p95 FROM rs GROUP BY variant), c AS (SELECT variant, category, avg(recall) AS recall FROM rs WHERE category IN ('view', 'click') GROUP BY ALL),
d AS (SELECT count(*) AS n, min(y.recall - x.recall) AS worst FROM c x JOIN c y USING (category) WHERE x.variant = 'base' AND y.variant = 'new'),
g AS (SELECT n.recall - b.recall >= 0 AS g1, d.n = 2 AS g2, d.n = 2 AND worst >= -0.01 AS g3, n.failed = 0 AS g4, n.p95 <= 2000 AS g6 FROM v b, v n, d WHERE b.variant = 'base' AND n.variant = 'new')
SELECT unnest(['fingerprints', 'overall_recall', 'category_coverage', 'category_regression', 'failed_cases', 'acl_leaks', 'latency_p95', 'required_metrics', 'promote']) AS gate, unnest([true, g1, g2, g3, g4, true, g6, false, false]) AS passed FROM g""")
def quality_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.variant_results(_results(spark, sf_dir))
    whole = r.where("category is null").select("variant", "recall", F.lit(0).alias("unauthorized"), "failed", F.col("p95").alias("p95_ms"), F.array(F.lit(1.0), F.lit(None).cast("double")).alias("metrics"), F.lit("f").alias("fingerprint"), F.lit("f").alias("expected_fingerprint"))
    return evaluate.recommendation(whole, r.where("category is not null").select("variant", "category", "recall"), "base", "new", ["view", "click"])


GATE = "one AS (SELECT count(*) AS cases, avg(quality) AS recall, avg(1 - toxic) AS mrr, count(CASE WHEN quality IS NULL THEN 1 END) AS failed, CAST(sum(toxic) AS BIGINT) AS unauthorized, 90.0 AS p95 FROM labels)"


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("cases"), F.avg("quality").alias("recall"), F.avg(1 - F.col("toxic")).alias("mrr"), F.count_if(F.col("quality").isNull()).alias("failed"), F.sum("toxic").alias("unauthorized"), F.lit(90.0).alias("p95_ms"))


@query(f"WITH {GATE}, g AS (SELECT cases >= 100 AS a, recall >= 1 AS b, mrr >= 1 AS c, failed = 0 AS d, unauthorized = 0 AS e, p95 <= 100 AS f FROM one) SELECT unnest(['cases', 'recall', 'mrr', 'failed', 'unauthorized', 'p95_ms', 'promote']) AS gate, unnest([a, b, c, d, e, f, a AND b AND c AND d AND e AND f]) AS passed FROM g")
def portable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.portable_gate(_one(spark, sf_dir))


@query(f"WITH {GATE}, g AS (SELECT recall >= 0.76 AS a, mrr >= 0.62 AS b, p95 <= 15000 AS c FROM one) SELECT unnest(['recall', 'mrr', 'p95_ms', 'promote']) AS gate, unnest([a, b, c, a AND b AND c]) AS passed FROM g")
def floor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.floor_gate(_one(spark, sf_dir))


@query("""WITH c AS (SELECT c_custkey AS case_id, [c_custkey % 50, c_custkey % 51] AS expected, CASE WHEN c_custkey % 3 <> 0 THEN '{"type":"rows","at":{"sheet":"' || c_mktsegment || '"}}' END AS loc, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 2 = 0 END AS latest, CASE WHEN c_custkey % 5 <> 0 THEN true END AS stale FROM customer),
h AS (SELECT o_custkey AS case_id, o_orderkey % 50 AS document_id, '{"type":"rows","at":{"row":' || o_orderkey || ',"sheet":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'HOUSEHOLD' END || '"},"n":1}' AS locator, o_orderstatus = 'F' AS is_latest, o_orderkey % 4 = 0 AS is_stale FROM orders),
r AS (SELECT case_id, bool_or(json_contains(locator::JSON, loc::JSON)) AS l, bool_or(is_latest = latest) AS n, bool_or(is_stale IS NOT DISTINCT FROM stale) AS s FROM h JOIN c USING (case_id) WHERE list_contains(expected, document_id) GROUP BY case_id)
SELECT case_id, CASE WHEN loc IS NOT NULL THEN coalesce(l, false) END AS locator_match, CASE WHEN latest IS NOT NULL THEN coalesce(n, false) END AS latest_match, CASE WHEN stale IS NOT NULL THEN coalesce(s, false) END AS stale_match FROM c LEFT JOIN r USING (case_id)""")
def evidence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    cases = table(spark, sf_dir, "customer").select(
        k.alias("case_id"), F.array(k % 50, k % 51).alias("expected"), F.when(k % 3 != 0, F.concat(F.lit('[{"type":"rows","at":{"sheet":"'), "c_mktsegment", F.lit('"}}]'))).alias("expected_locators"),
        F.when(k % 4 != 0, k % 2 == 0).alias("expected_latest"), F.when(k % 5 != 0, F.lit(True)).alias("expected_stale"),
    )
    locator = F.concat(F.lit('{"type":"rows","at":{"row":'), o.cast("string"), F.lit(',"sheet":"'), F.when(o % 2 == 0, "BUILDING").otherwise("HOUSEHOLD"), F.lit('"},"n":1}'))
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), (o % 50).alias("document_id"), locator.alias("locator"), (F.col("o_orderstatus") == "F").alias("is_latest"), (o % 4 == 0).alias("is_stale"))
    return evaluate.evidence_matches(cases, hits)


#: Questions and pieces of evidence by number, so that every gate of the cascade closes for some.
ASKED = ("계약 금액은 얼마", "변경계약의 승인 기준", "승인 절차", "AB-12 납품 일정 확인", "납품 일정의 담당자 이름", "설계 변경 승인")
BODIES = ("계약 금액은 300만원 납품 일정", "변경계약 승인 완료 기준 절차", "AB-12 납품 일정 담당자 이름", "설계 변경 승인 검토 중", "계약 금액 미정 승인 절차", "다른 이야기")


@query()
def answer_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of refusals over each customer's orders; tests hold it against a plain version."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    n = F.col("o_orderkey")
    hits = o.select(
        k.alias("query_id"), pick(ASKED, k).alias("query"), n.alias("unit_id"), F.lit("").alias("title"), pick(BODIES, n + k).alias("body"), F.when(n % 13 == 0, "xlsx_sheet").when(n % 11 == 0, "csv_rows").otherwise("text").alias("locator_type"),
        (n % 2 == 0).alias("partial"), (n % 3).alias("document_id"), (n % 17 == 0).alias("asserted"), (n % 19 == 0).alias("stale"),
    )
    return answer.adequacy(hits)


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200")
def order_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a hundred of all orders, the newest first, each page behind the cursor of the one before."""

    def make() -> listing.Listing:
        own = listing.Listing(spark, f"{shared_dir(spark)}/quernstone-listing-{uuid.uuid4().hex}", ("-o_orderdate", "o_orderkey"))
        listing.add(own, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), per_file=2000)
        return own

    own, after = stored(spark, sf_dir, "orders by date", make), None
    for _ in range(3):
        found, after = listing.page(own, 100, after)
    return found


@query("SELECT doc_id AS unit_id, upper(lang) AS lang, CASE WHEN doc_id % 7 = 0 THEN 'v2' ELSE 'v1' END AS extraction FROM documents UNION ALL SELECT vec_id, label::VARCHAR, 'vector' FROM embeddings WHERE label % 2 = 0")
def shadow_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units are extracted again and vectors of a new space come, both in the shadow; they become active together, and are read as of one version."""
    root = f"{shared_dir(spark)}/quernstone-snapshots-{uuid.uuid4().hex}"
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").alias("unit_id"), F.col("label").cast("string").alias("lang"), F.lit("vector").alias("extraction"))
    units_of = lambda kind: d.select(F.col("doc_id").alias("unit_id"), F.upper("lang").alias("lang"), kind.alias("extraction"))
    old = {"units": snapshots.shadow(spark, root, "units", units_of(F.lit("v1"))), "vectors": snapshots.shadow(spark, root, "vectors", vectors)}
    snapshots.activate(spark, root, {s: (None, n) for s, n in old.items()})
    new = {"units": units_of(F.when(F.col("doc_id") % 7 == 0, "v2").otherwise("v1")), "vectors": vectors.where("cast(lang as int) % 2 = 0")}
    snapshots.activate(spark, root, {s: (old[s], snapshots.shadow(spark, root, s, rows)) for s, rows in new.items()})
    both = snapshots.read(spark, root, ["units", "vectors"])
    return both["units"].unionByName(both["vectors"])
