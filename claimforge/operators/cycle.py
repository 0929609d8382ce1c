"""The full cycle: fifteen jobs threaded through versioned tables, each reading what the one before committed.

A step writes the tables it changes to new folders and then, as its commit, the manifest of the next version: a table
name, its folder and the step. Readers see a version whole or not at all; a step that fails leaves the version before,
and its leftovers are in no manifest. Steps marked isolated report their error and the cycle goes on; others end it.
Claims that change status are recorded with the step in ``transitions``, whose folders add up over the versions.

Every job is a function of the tables and reads one snapshot; keys are aggregated before they meet, so a key of any
share is summed in many tasks first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimforge.operators import governance as G

Tables = dict[str, DataFrame]
MANIFEST = "version int, step string, name string, folder string, error string"


@dataclass
class Job:
    name: str
    run: Callable[[Tables], Tables]
    isolated: bool = False


class Store:
    """Versions of a set of tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")

    def commit(self, version: int, step: str, folders: dict[str, list[str]], error: str | None = None) -> None:
        rows = [(version, step, n, f, error) for n, fs in folders.items() for f in fs]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def put(self, df: DataFrame, name: str) -> str:
        folder = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def folders(self, version: int) -> dict[str, list[str]]:
        """A manifest has a row or a few a table, and one version's rows are read: bounded by tables and steps."""
        out: dict[str, list[str]] = {}
        for r in self.manifest().filter(F.col("version") == version).collect():
            out.setdefault(r.name, []).append(r.folder)
        return out

    def last(self) -> int:
        return self.manifest().agg(F.max("version")).first()[0]

    def read(self, version: int) -> Tables:
        return {n: self.spark.read.parquet(*fs) for n, fs in self.folders(version).items()}


def start(spark: SparkSession, root: str, tables: Tables) -> Store:
    store = Store(spark, root)
    store.commit(0, "start", {n: [store.put(df, n)] for n, df in tables.items()})
    return store


def run_cycle(store: Store, jobs: list[Job]) -> DataFrame:
    """Runs the jobs in order and returns the manifest. ``transitions`` is kept by the cycle itself."""
    version = store.last()
    for job in jobs:
        folders = store.folders(version)
        tables = store.read(version)
        try:
            changed = job.run(tables)
            new = {n: [store.put(df, n)] for n, df in changed.items()}
            if "claims" in changed:
                now = store.spark.read.parquet(*new["claims"]).select("id", F.col("status").alias("to_status"))
                was = tables["claims"].select("id", F.col("status").alias("from_status"))
                moved = was.join(now, "id").filter("from_status <> to_status").select(F.lit(job.name).alias("step"), "id", "from_status", "to_status")
                new["transitions"] = [*folders.get("transitions", []), store.put(moved, "transitions")]
        except Exception as failure:  # the version before stands
            if not job.isolated:
                raise
            version += 1
            store.commit(version, job.name, folders, f"{type(failure).__name__}: {failure}"[:300])
            continue
        version += 1
        store.commit(version, job.name, folders | new)
    return store.manifest()


KEY = ["subject", "predicate", "scope"]
VALUE_STEP = {"o": 0.05, "p": -0.2}
COMPACT_DAYS, MOST_SELECTED, MAX_DRIFT, RULE_LEAST = 730, 200, 0, 3


def changed(claims: DataFrame, news: DataFrame) -> DataFrame:
    """Claims with the columns of ``news`` (id and any of status, confidence, updated_at, ...) where it has a row and a value."""
    cols = [c for c in news.columns if c != "id"]
    x = claims.alias("c").join(news.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in cols]), F.col("c.id") == F.col("_id"), "left")
    return x.select(*[F.coalesce(f"_{c}", f"c.{c}").alias(c) if c in cols else F.col(f"c.{c}") for c in claims.columns])


def jobs(now: Column) -> list[Job]:
    """The jobs in their order."""

    def policy(t: Tables) -> Tables:
        due = G.revalidation_due(t["claims"], now)
        return {"selected": due.orderBy(F.desc("priority"), "id").limit(MOST_SELECTED)}

    def extract(t: Tables) -> Tables:
        return {"claims": t["claims"].withColumn("value", F.coalesce("value", F.lower(F.trim("object_value"))))}

    def dedupe(t: Tables) -> Tables:
        key = [*KEY, "value"]
        held = t["claims"].groupBy(*key).agg(F.min(F.when(F.col("status") == "candidate", F.col("id"))).alias("first"), F.max((F.col("status") == "confirmed").cast("int")).alias("firm"))
        again = t["claims"].filter("status = 'candidate'").join(held, key).filter("firm = 1 OR first < id")
        return {"claims": changed(t["claims"], again.select("id", F.lit("archived").alias("status"), now.alias("updated_at")))}

    def deterministic(t: Tables) -> Tables:
        step = F.when(F.col("status") == "candidate", G.choose("value", VALUE_STEP, 0.0)).otherwise(0.0)
        return {"claims": t["claims"].withColumn("confidence", F.when(step != 0, G.clamp(F.col("confidence") + step)).otherwise(F.col("confidence")))}

    def validate(t: Tables) -> Tables:
        verdicts = G.promotion_ladder(t["claims"], t["citations"])
        status = F.when(F.col("verdict").isin("confirmed", "supersedes"), "confirmed").when(F.col("verdict") == "duplicate", "archived").when(F.col("verdict") == "conflicted", "conflicted")
        own = verdicts.filter("verdict <> 'pending'").select("id", status.alias("status"), F.when(status == "confirmed", F.col("score")).alias("confidence"), now.alias("updated_at"))
        lost = verdicts.filter("verdict = 'supersedes'").select(F.col("rival_id").alias("id")).distinct().select("id", F.lit("superseded").alias("status"), F.lit(None).cast("double").alias("confidence"), now.alias("updated_at"))
        return {"claims": changed(t["claims"], own.unionByName(lost))}

    def decay(t: Tables) -> Tables:
        x = G.decay(t["claims"], now)
        return {"claims": changed(t["claims"], x.select("id", F.col("new_status").alias("status"), F.col("new_confidence").alias("confidence")))}

    def edge_decay(t: Tables) -> Tables:
        return {"edges": t["edges"].withColumn("weight", G.edge_decay(F.col("weight"), F.col("days")))}

    def compact(t: Tables) -> Tables:
        old = t["claims"].filter(F.col("status").isin("stale", "superseded", "conflicted") & ~F.col("pinned") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(COMPACT_DAYS))))
        summary = old.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        return {"claims": changed(t["claims"], old.select("id", F.lit("archived").alias("status"))), "summaries": summary}

    def mine_rules(t: Tables) -> Tables:
        n = t["transitions"].join(t["claims"].select("id", "predicate"), "id").groupBy("predicate", "to_status").agg(F.count(F.lit(1)).alias("n"))
        confidence = F.when(F.col("n") >= 3, 0.7).when(F.col("n") == 2, 0.6).otherwise(0.5)
        return {"rules": n.withColumn("confidence", confidence).withColumn("state", F.lit("candidate"))}

    def review_skills(t: Tables) -> Tables:
        return {"rules": t["rules"].withColumn("state", F.when(F.col("n") >= RULE_LEAST, "active").otherwise("expired"))}

    def integrity(t: Tables) -> Tables:
        lost = t["citations"].join(t["claims"].select(F.col("id").alias("claim_id")), "claim_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
        return {"integrity": lost.select(F.lit("orphan_citations").alias("name"), "n")}

    def reconcile(t: Tables) -> Tables:
        ids = t["claims"].filter("status <> 'archived'").select("id")
        drift = ids.exceptAll(t["index"]).count() + t["index"].exceptAll(ids).count()
        return {"index": ids} if drift > MAX_DRIFT else {}

    def drain(t: Tables) -> Tables:
        seen = t["spool"].groupBy(F.col("claim_id").alias("id")).agg(F.count(F.lit(1)).alias("more"))
        x = t["claims"].join(seen, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("more", F.lit(0)))
        return {"claims": x.select(*t["claims"].columns), "spool": t["spool"].limit(0)}

    def retier(t: Tables) -> Tables:
        return {"claims": G.tiers(t["claims"].drop("tier"), now).select(*t["claims"].columns)}

    def metrics(t: Tables) -> Tables:
        return {"metrics": t["claims"].groupBy("status", "tier").agg(F.count(F.lit(1)).alias("n"))}

    order = [policy, extract, dedupe, deterministic, validate, decay, edge_decay, compact, mine_rules, review_skills, integrity, reconcile, drain, retier, metrics]
    isolated = {"edge_decay", "mine_rules", "integrity", "reconcile", "drain", "retier", "metrics"}
    return [Job(f.__name__, f, f.__name__ in isolated) for f in order]
