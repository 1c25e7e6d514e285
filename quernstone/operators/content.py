"""The content store: what is current among objects, revisions, artifacts, extractions and units, and how it changes.

Tables: objects (object_id, current_revision_id, acl_scopes, acl_snapshot_id), revisions (revision_id, object_id, sha256), artifacts
(artifact_id, revision_id, file_name), extractions (extraction_id, artifact_id, active), units (unit_id, artifact_id, extraction_id,
document_id, title, body), documents (document_id, title), spaces (space_id, dim, status), vectors (space_id, unit_id, text_hash, embedding).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(units: DataFrame, extractions: DataFrame, artifacts: DataFrame, revisions: DataFrame, objects: DataFrame) -> DataFrame:
    """``units`` with file_name, revision_id, object_id and sha256: those of active extractions of objects' current revisions."""
    live = extractions.where("active").select("extraction_id")
    pointed = objects.select("object_id", F.col("current_revision_id").alias("revision_id"))
    files = artifacts.select("artifact_id", "revision_id", "file_name").join(revisions.select("revision_id", "object_id", "sha256"), "revision_id").join(pointed, ["object_id", "revision_id"])
    return units.join(live, "extraction_id", "left_semi").join(files, "artifact_id")


def in_workspace(rows: DataFrame, workspace: str) -> DataFrame:
    """Rows of one workspace; tables are partitioned by it, so that others aren't read."""
    return rows.where(F.col("workspace_id") == workspace)


def embeddable(current_units: DataFrame, documents: DataFrame) -> DataFrame:
    """unit_id, document_id, title, body, source_hash of units to embed: a unit without title has its document's."""
    named = documents.select("document_id", F.col("title").alias("_title"))
    return current_units.join(named, "document_id", "left").select("unit_id", "document_id", F.coalesce("title", "_title", F.lit("")).alias("title"), "body", F.col("sha256").alias("source_hash"))


def eligible(vectors: DataFrame, current_units: DataFrame, spaces: DataFrame) -> DataFrame:
    """Vectors of active spaces whose unit is current: both conditions as semi-joins, so that no vector comes twice."""
    active = spaces.where("status = 'active'").select("space_id")
    return vectors.join(active, "space_id", "left_semi").join(current_units.select("unit_id"), "unit_id", "left_semi")


def artifact_view(artifacts: DataFrame, revisions: DataFrame, objects: DataFrame, bridge: DataFrame, documents: DataFrame) -> DataFrame:
    """artifact_id, file_name, revision_id, object_id, is_current, document_id, title of each artifact."""
    pointed = objects.select("object_id", "current_revision_id")
    of = bridge.select("artifact_id", "document_id").join(documents.select("document_id", "title"), "document_id", "left")
    out = artifacts.join(revisions.select("revision_id", "object_id"), "revision_id").join(pointed, "object_id").join(of, "artifact_id", "left")
    return out.select("artifact_id", "file_name", "revision_id", "object_id", (F.col("revision_id") == F.col("current_revision_id")).alias("is_current"), "document_id", "title")


def vectors_by_space(spaces: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """space_id, status, vectors: counts over the vector tables of all dimensions; spaces without any count 0."""
    every = tables[0].select("space_id")
    for t in tables[1:]:
        every = every.unionByName(t.select("space_id"))
    n = every.groupBy("space_id").agg(F.count("*").alias("vectors"))
    return spaces.join(n, "space_id", "left").select("space_id", "status", F.coalesce("vectors", F.lit(0)).alias("vectors"))


def saved_spaces(spaces: DataFrame, incoming: DataFrame) -> DataFrame:
    """``spaces`` after saving ``incoming``: an active space stays active, and a name of another space is a conflict that isn't saved."""
    taken = spaces.select(F.col("name"), F.col("space_id").alias("_by"))
    good = incoming.join(taken, "name", "left").where(F.col("_by").isNull() | (F.col("_by") == F.col("space_id"))).drop("_by")
    old = spaces.select("space_id", F.col("status").alias("_was"))
    kept = spaces.join(good.select("space_id"), "space_id", "left_anti")
    new = good.join(old, "space_id", "left").withColumn("status", F.when(F.col("_was") == "active", "active").otherwise(F.col("status"))).drop("_was")
    return kept.unionByName(new.select(kept.columns))


def activated(spaces: DataFrame, wanted: Column, counts: DataFrame, total: int) -> DataFrame:
    """space_id, status once the space ``wanted`` (a condition) is activated: it must be complete, and is then the only active one."""
    j = spaces.join(counts.select("space_id", "vectors"), "space_id", "left").withColumn("_on", wanted & (F.coalesce("vectors", F.lit(0)) >= total))
    # one row
    any_on = j.agg(F.coalesce(F.bool_or("_on"), F.lit(False)).alias("_any"))
    status = F.when(F.col("_on"), "active").when(F.col("_any") & (F.col("status") == "active"), "shadow").otherwise(F.col("status"))
    return j.crossJoin(F.broadcast(any_on)).select("space_id", status.alias("status"))


def upserted_vectors(vectors: DataFrame, incoming: DataFrame, spaces: DataFrame) -> DataFrame:
    """``vectors`` with ``incoming`` (and seq) in their place: the last of each unit and space, if its dimension is the space's."""
    dims = spaces.select("space_id", "dim")
    good = incoming.join(dims, "space_id").where(F.size("embedding") == F.col("dim")).drop("dim")
    last = good.groupBy("space_id", "unit_id").agg(F.max_by(F.struct(*[c for c in vectors.columns if c not in ("space_id", "unit_id")]), "seq").alias("v")).select("space_id", "unit_id", "v.*")
    return vectors.join(last, ["space_id", "unit_id"], "left_anti").unionByName(last.select(vectors.columns))


def cascaded(units: DataFrame, artifacts: DataFrame, revisions: DataFrame, changed: DataFrame) -> DataFrame:
    """``units`` (acl_scopes, acl_snapshot_id) after the access of some objects has changed (object_id, scopes, snapshot_id)."""
    new = artifacts.select("artifact_id", "revision_id").join(revisions.select("revision_id", "object_id"), "revision_id").join(changed, "object_id").select("artifact_id", F.col("scopes").alias("_s"), F.col("snapshot_id").alias("_n"))
    out = units.join(new, "artifact_id", "left")
    return out.withColumns({"acl_scopes": F.coalesce("_s", "acl_scopes"), "acl_snapshot_id": F.coalesce("_n", "acl_snapshot_id")}).select(units.columns)


def evidence_snapshots(evidence: DataFrame, units: DataFrame) -> DataFrame:
    """assertion_id, snapshot_ids: the distinct snapshots of an assertion's evidence, in order."""
    return evidence.join(units.select("unit_id", "acl_snapshot_id"), "unit_id").groupBy("assertion_id").agg(F.array_sort(F.collect_set("acl_snapshot_id")).alias("snapshot_ids"))


def ingested(packets: DataFrame, objects: DataFrame, revisions: DataFrame) -> DataFrame:
    """packet_id, outcome, is_current of packets (packet_id, object_id, sha256, n_units, seq) against the store.

    The last packet of an object counts, earlier ones are superseded. It is unchanged if its content is the current revision's, a tombstone
    if it has no units, inserted for a new object, else replaced; all but unchanged ones become the current revision.
    """
    last = packets.groupBy("object_id").agg(F.max_by("packet_id", F.struct("seq", "packet_id")).alias("_last"))
    now = objects.join(revisions.select(F.col("revision_id").alias("current_revision_id"), F.col("sha256").alias("_sha")), "current_revision_id", "left").select("object_id", "_sha", F.lit(True).alias("_known"))
    j = packets.join(last, "object_id").join(now, "object_id", "left")
    outcome = (
        F.when(F.col("packet_id") != F.col("_last"), "superseded")
        .when(F.col("n_units") == 0, "tombstone")
        .when(F.col("_known").isNull(), "inserted")
        .when(F.col("sha256") == F.col("_sha"), "unchanged")
        .otherwise("replaced")
    )
    return j.select("packet_id", "object_id", outcome.alias("outcome")).withColumn("is_current", F.col("outcome").isin("inserted", "replaced", "tombstone"))


def reextracted(attempts: DataFrame, extractions: DataFrame, least: float = 0.7) -> DataFrame:
    """extraction_id, outcome of shadow extractions (extraction_id, artifact_id, expected_active_id, quality): rejected below ``least``, a
    conflict if the active one has changed since, else activated in its place."""
    active = extractions.where("active").select("artifact_id", F.col("extraction_id").alias("_active"))
    j = attempts.join(active, "artifact_id", "left")
    outcome = F.when(F.coalesce("quality", F.lit(0.0)) < least, "rejected").when(~F.col("_active").eqNullSafe(F.col("expected_active_id")), "conflict").otherwise("activated")
    return j.select("extraction_id", "artifact_id", outcome.alias("outcome"))


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: rows of each table, a count each."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def by_length(texts: DataFrame, text: str = "body", parts: int | None = None) -> DataFrame:
    """``texts`` in order of length within partitions, so that batches of a model hold texts of like length and pad little."""
    n = parts or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(n).sortWithinPartitions(F.length(text))


def rendered(blocks: DataFrame, block: str = "block") -> DataFrame:
    """``blocks`` with body: of a JSON block its text, markdown or content, else its table's or its own rows, tabs between cells, else its image's name."""
    cell = "struct<text:string>"
    b = F.from_json(block, f"text string, markdown string, content string, table struct<cells:array<array<{cell}>>>, rows array<array<{cell}>>, imageData struct<filename:string>")

    def lines(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c["text"], F.lit(""))), "\t")), "\n")

    x = F.col("_b")
    parts = [F.nullif(x[f], F.lit("")) for f in ("text", "markdown", "content")] + [F.nullif(lines(x["table"]["cells"]), F.lit("")), F.nullif(lines(x["rows"]), F.lit(""))]
    image = F.when(x["imageData"].isNotNull(), F.concat(F.lit("[image: "), F.coalesce(F.nullif(x["imageData"]["filename"], F.lit("")), F.lit("unnamed")), F.lit("]")))
    return blocks.withColumn("_b", b).withColumn("body", F.coalesce(*parts, image, F.lit(""))).drop("_b")
