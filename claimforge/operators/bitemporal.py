"""Bitemporal upsert: versions of an identity on one time line without overlaps, the version recorded last winning.

A new version closes, shortens or splits what it covers. The time line of an identity is the set of its elementary
stretches (between neighbouring bounds), each with the newest version over it, neighbours of one version merged. Newest
covers are found without comparing stretches with versions: a version's run of stretches is cut into dyadic blocks, two a
level at most; blocks keep their newest version by an aggregate, and a stretch looks its ancestors up. So an identity with
n versions costs n log n rows, spread by block. Ranks and merges are running sums in two levels, for the same reason.

Nulls in an identity's columns are values of their own; a row without an end is open; rows of no length are recorded but
hold no time; of rows with one (key, id) the first recorded stays, ties of one batch by their bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from claimforge.operators.cycle import Store, start
from claimforge.streaming.streams import stored

END = "9999-12-31 00:00:00"
BLOCK_BITS = 12
VERSION = ["key", "id", "seq", "valid_from", "valid_until"]


def identity(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def instant(value: Column) -> Column:
    """An ISO-8601 text as a UTC timestamp without zone; texts without an offset are UTC; null where malformed."""
    text = F.trim(value)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    zoned = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    micros = F.unix_micros(F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    return F.when(shaped, F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1000000).cast("decimal(18,6)")))


def guarded(rows: DataFrame, now: Column) -> DataFrame:
    """Rows with text bounds -> bounds as timestamps and ``fault``: 'malformed', 'inverted' or null. A missing start is now,
    or the end where that lies in the past, so that no admitted row is inverted."""
    since, until = instant(F.col("valid_from")), instant(F.col("valid_until"))
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    bad = (given("valid_from") & since.isNull()) | (given("valid_until") & until.isNull())
    x = rows.withColumn("fault", F.when(bad, "malformed").when(until < since, "inverted"))
    return x.withColumns({"valid_from": F.coalesce(since, F.when(until <= now, until), now), "valid_until": until})


def running(rows: DataFrame, block: str, order: str, add: str) -> DataFrame:
    """``running`` and ``total`` of a column by key in an order: sums inside blocks, then over the blocks before."""
    inside = W.partitionBy("key", block).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = rows.groupBy("key", block).agg(F.sum(add).alias("_s"))
    earlier = W.partitionBy("key").orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("key", block, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"), F.sum("_s").over(W.partitionBy("key")).alias("total"))
    x = rows.withColumn("_in", F.sum(add).over(inside)).join(sums, ["key", block])
    return x.withColumn("running", F.col("_in") + F.col("_before")).drop("_in", "_before")


def dyadic(lo: str, hi: str) -> Column:
    """The blocks (level, node) that make up [lo, hi); node n of level l is [n 2^l, (n + 1) 2^l)."""
    start_ = F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))

    def step(acc: Column, level: Column) -> Column:
        odd = lambda c: ((acc.lo < acc.hi) & (c.bitwiseAND(F.lit(1)) == 1)).cast("bigint")
        left, right = odd(acc.lo), odd(acc.hi)
        node = lambda is_in, at: F.when(is_in == 1, F.array(F.struct(level.alias("level"), at.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
        return F.struct(F.shiftright(acc.lo + left, 1).alias("lo"), F.shiftright(acc.hi - right, 1).alias("hi"), F.concat(acc.nodes, node(left, acc.lo), node(right, acc.hi - 1)).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(hi))), start_, step, lambda acc: acc.nodes)


def timeline(versions: DataFrame) -> DataFrame:
    """versions(key, id, seq, valid_from, valid_until) -> the same columns, disjoint by key: at each time the version of the
    greatest (seq, id) that holds it."""
    v = versions.select("key", "id", "seq", "valid_from", F.coalesce("valid_until", F.lit(END).cast("timestamp_ntz")).alias("valid_until")).filter("valid_from < valid_until")
    bounds = v.select("key", F.col("valid_from").alias("t")).union(v.select("key", F.col("valid_until").alias("t"))).distinct()
    r = stored(running(bounds.withColumns({"day": F.to_date("t"), "one": F.lit(1).cast("bigint")}), "day", "t", "one").select("key", "t", F.col("running").alias("r"), "total"), "bounds")
    spans = v.join(r.select("key", F.col("t").alias("valid_from"), F.col("r").alias("lo")), ["key", "valid_from"]).join(r.select("key", F.col("t").alias("valid_until"), F.col("r").alias("hi")), ["key", "valid_until"])
    blocks = spans.select("key", "id", "seq", F.explode(dyadic("lo", "hi")).alias("b")).groupBy("key", "b.level", "b.node").agg(F.max(F.struct("seq", "id")).alias("w"))
    stretch = r.join(r.select("key", (F.col("r") - 1).alias("r"), F.col("t").alias("until")), ["key", "r"])
    look = stretch.withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin("total"))))).withColumn("node", F.expr("shiftright(r, level)"))
    won = stored(look.join(blocks, ["key", "level", "node"]).groupBy("key", "r", "t", "until").agg(F.max("w").alias("w")), "winners")
    before = won.select("key", (F.col("r") + 1).alias("r"), F.col("w").alias("was"))
    x = won.join(before, ["key", "r"], "left").withColumns({"begins": F.when(F.col("was") == F.col("w"), 0).otherwise(1).cast("bigint"), "block": F.shiftright("r", BLOCK_BITS)})
    x = running(x, "block", "r", "begins").groupBy("key", "running").agg(F.first("w").alias("w"), F.min("t").alias("valid_from"), F.max("until").alias("until"))
    return x.select("key", F.col("w.id").alias("id"), F.col("w.seq").alias("seq"), "valid_from", F.when(F.col("until") < F.lit(END).cast("timestamp_ntz"), F.col("until")).alias("valid_until"))


def open_store(spark: SparkSession, root: str, empty: DataFrame) -> Store:
    """A store of ``versions`` (all that was recorded) and ``timeline``, from a frame of VERSION's columns without rows."""
    return start(spark, root, {"versions": empty.select(*VERSION), "timeline": empty.select(*VERSION)})


def upsert(store: Store, batch: DataFrame, name: str) -> None:
    """Records a batch and lays it over the time line in one commit; a batch of a name already committed changes nothing.

    Only identities of the batch are laid out anew, from their present stretches and the batch's rows: what is hidden
    already stays so. A failure before the commit leaves the version before.
    """
    if not store.manifest().filter(F.col("step") == name).isEmpty():
        return
    version = store.last()
    folders, tables = store.folders(version), store.read(version)
    rows = batch.groupBy("key", "id").agg(F.min(F.struct("seq", "valid_from", "valid_until")).alias("x")).select("key", "id", "x.*")
    added = store.put(rows.join(tables["versions"], ["key", "id"], "left_anti").select(*VERSION), "versions")
    fresh = store.spark.read.schema(tables["versions"].schema).parquet(added)
    touched = fresh.select("key").distinct()
    laid = timeline(tables["timeline"].join(touched, "key", "left_semi").unionByName(fresh))
    kept = tables["timeline"].join(touched, "key", "left_anti")
    store.commit(version + 1, name, folders | {"versions": [*folders["versions"], added], "timeline": [store.put(kept.unionByName(laid), "timeline")]})
