"""Incremental ingest: a bronze stream of staged JSON rows drained by entity in dependency order, merged by natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip_json_nul
from ..operators.merge import dedupe
from ..operators.store import Merge, Store
from ..sources import bundles

STAGED = "seq long, repo_id long, entity_type string, payload string"
#: Parents before children.
ENTITIES = {
    "contributor": (["login"], "login string, email string"),
    "issue": (["repo_id", "number"], "number long, title string, state string"),
    "issue_event": (["repo_id", "number", "event_id"], "number long, event_id long, action string"),
}
#: Staged records of nested pull requests.
BUNDLES = "pull_request_bundle"
PARENTS = {"issue_event": ("issue", ["repo_id", "number"])}


def staged_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(STAGED).option("maxFilesPerTrigger", files).json(path)


def _read_payloads(batch: DataFrame, entity: str) -> DataFrame:
    """The staged rows of one entity with their columns, and whether all keys are there."""
    keys, schema = ENTITIES[entity]
    rows = batch.filter(F.col("entity_type") == entity).withColumn("r", F.from_json(strip_json_nul(F.col("payload")), schema, {"mode": "PERMISSIVE"}))
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col("repo_id" if k == "repo_id" else f"r.{k}").isNotNull()
    return rows.withColumn("ok", ok)


def parse(batch: DataFrame, entity: str) -> DataFrame:
    """Rows of one entity; those without a readable key are left to ``quarantine``."""
    rows = _read_payloads(batch, entity).filter("ok")
    return rows.select("seq", *(["repo_id"] if "repo_id" in ENTITIES[entity][0] else []), "r.*")


def quarantine(batch: DataFrame) -> DataFrame:
    """Staged rows of unknown entities, with unreadable payloads, or without a key."""
    out = batch.filter(F.col("entity_type").isNull() | ~F.col("entity_type").isin(*ENTITIES, BUNDLES))
    broken = F.from_json("payload", "struct<repository: map<string, string>>")["repository"].isNull()
    out = out.unionByName(batch.filter((F.col("entity_type") == BUNDLES) & (broken | F.col("repo_id").isNull())))
    for entity in ENTITIES:
        out = out.unionByName(_read_payloads(batch, entity).filter("not ok").select(*batch.columns))
    return out


def merge_batch(root: str, writer: str = "drain"):
    """foreachBatch function: merge each entity's newest rows and the children of nested bundles, all in one commit.

    Children without a parent, in the store or in the batch, are skipped. What is written follows the batch: only the
    touched buckets of each table. A batch that the store already holds for the writer is not merged again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, root)
        if store.applied(writer, batch_id):
            return
        batch = batch.persist()
        nested = bundles.fan_out(batch.filter(F.col("entity_type") == BUNDLES)).persist()
        try:
            quarantine(batch).write.mode("overwrite").json(f"{root}/quarantine/{batch_id:012d}")
            seen = {r.entity_type for r in batch.select("entity_type").distinct().collect()}
            found: list[Merge] = bundles.changes(nested) if BUNDLES in seen else []
            for entity, (keys, _) in ENTITIES.items():
                new = dedupe(parse(batch, entity), keys, [F.desc("seq")]).drop("seq")
                if entity in PARENTS:
                    parent, on = PARENTS[entity]
                    known = parse(batch, parent).select(*on)
                    if any(r.name == parent for r in store.manifest()):
                        known = known.unionByName(store.table(parent).select(*on))
                    new = new.join(known.distinct(), on, "left_semi")
                found.append(Merge(entity, new, keys, by=keys[0]))
            store.commit(found, writer, batch_id)
        finally:
            nested.unpersist()
            batch.unpersist()

    return run


def drain(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Process all that is staged, batch by batch. The checkpoint names the writer: a new one replays everything."""
    stream.writeStream.foreachBatch(merge_batch(root, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table(spark: SparkSession, root: str, entity: str) -> DataFrame:
    return Store(spark, root).table(entity)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Native extension: tumbling counts by action with a watermark; works on streams and tables."""
    ts = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return ts.groupBy(F.window("at", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "action", "n")
