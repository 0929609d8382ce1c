"""Inbox tail and turn processing: growing line files as a stream by byte offset, and turns into evidence and claims.

The source keeps, for every file of the inbox, the byte behind its last complete line and a mark: a digest of the bytes
before it. A file that still holds the marked bytes there goes on from that byte; one that is shorter or holds others was
truncated or replaced, and is read from its start. A last line without its end waits for the next batch. Ranges are cut
at line starts, so a batch of any size is many tasks; the planner reads a file's ends only. A planned batch that is run
again reads the same bytes, and fails loudly where the file no longer has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from claimforge.functions import text as T
from claimforge.operators.governance import validation_score

MARK, BLOCK, RANGE = 256, 1 << 16, 16 << 20
LINES = "file string, at long, line string"


class Range(InputPartition):
    def __init__(self, file: str, low: int, high: int, end: int, mark: str):
        super().__init__(0)
        self.file, self.low, self.high, self.end, self.mark = file, low, high, end, mark


class InboxReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def sizes(self) -> dict[str, int]:
        store, root = self.store()
        top = store.get_file_info(root)
        found = store.get_file_info(fs.FileSelector(root)) if top.type == fs.FileType.Directory else [top]
        return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, files = self.store()[0], {}
        for name, size in sorted(self.sizes().items()):
            with store.open_input_file(name) as f:
                at = line_end(f, size)
                if at:
                    files[name] = [at, mark(f, at)]
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        store, out = self.store()[0], []
        for name, (high, last) in sorted(end["files"].items()):
            before, told = start["files"].get(name, [0, ""])
            if [before, told] == [high, last]:  # nothing new; a restart asks this of its last offset
                continue
            with store.open_input_file(name) as f:
                low = before if before <= high and before <= f.size() and mark(f, before) == told else 0
                while low < high:
                    cut = next_line(f, min(low + self.range_bytes, high), high)
                    out.append(Range(name, low, cut, high, last))
                    low = cut
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with self.store()[0].open_input_file(part.file) as f:
            if f.size() < part.end or mark(f, part.end) != part.mark:
                raise RuntimeError(f"{part.file} no longer holds the bytes of a planned batch")
            f.seek(part.low)
            data = f.read(part.high - part.low)
        lines, ats, at = [], [], part.low
        for raw in data.split(b"\n")[:-1]:
            line = raw.removesuffix(b"\r")
            if line.strip():
                lines.append(line.decode("utf-8", "replace"))
                ats.append(at)
            at += len(raw) + 1
        for i in range(0, len(lines), 1000):
            some = lines[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(some)), pa.array(ats[i : i + 1000], pa.int64()), pa.array(some)], ["file", "at", "line"])

    def commit(self, end: dict) -> None:
        """Nothing to keep: the offsets hold all."""


def mark(f: pa.NativeFile, at: int) -> str:
    low = max(0, at - MARK)
    f.seek(low)
    return hashlib.sha256(f.read(at - low)).hexdigest()[:24] if at else ""


def line_end(f: pa.NativeFile, size: int) -> int:
    """The byte behind the last line end, 0 without any."""
    high = size
    while high > 0:
        low = max(0, high - BLOCK)
        f.seek(low)
        found = f.read(high - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        high = low
    return 0


def next_line(f: pa.NativeFile, at: int, high: int) -> int:
    """The first line start at or behind ``at``, not beyond ``high``."""
    f.seek(at - 1)
    while at - 1 < high:
        block = f.read(min(BLOCK, high - at + 1))
        if not block:
            raise RuntimeError("the file no longer holds the bytes of a planned batch")
        found = block.find(b"\n")
        if found >= 0:
            return at + found
        at += len(block)
    return high


class Inbox(DataSource):
    """``spark.readStream.format("inbox").option("path", file or folder)``"""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> InboxReader:  # noqa: ANN001
        return InboxReader(self.options["path"], int(self.options.get("rangebytes", RANGE)))


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, at, line) of an inbox file, or of every file of an inbox folder."""
    spark.dataSource.register(Inbox)
    return spark.readStream.format("inbox").option("path", path).option("rangeBytes", str(range_bytes)).load()


def drain(lines: DataFrame, out: str, state: str) -> None:
    """Appends what the inbox has now to ``out``; a batch that is run again replaces its own rows."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    lines.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


TURN = "session_id string, thread_id string, turn_id string, user_text string, assistant_text string, observations array<string>"
TIER1, TIER2, EXCERPT = 4, 8, 500
MIN_CITATIONS, MIN_SCORE = 1, 0.58


def public(text):  # noqa: ANN001, ANN201
    """Text without private blocks."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<private>.*?</private>", " "))


def turns(lines: DataFrame) -> DataFrame:
    """Parsed turns with their evidence in order; lines that don't parse or have no session are ``bad``."""
    x = lines.withColumn("j", F.from_json("line", TURN)).select("file", "at", "line", "j.*").withColumn("bad", F.col("session_id").isNull() | F.col("turn_id").isNull())
    kinds = F.array(F.struct(F.lit("user").alias("kind"), public(F.col("user_text")).alias("text")), F.struct(F.lit("assistant").alias("kind"), public(F.col("assistant_text")).alias("text")))
    noted = F.transform(F.coalesce("observations", F.array().cast("array<string>")), lambda o: F.struct(F.lit("observation").alias("kind"), public(o).alias("text")))
    return x.withColumn("evidence", F.filter(F.concat(kinds, noted), lambda e: e.text != ""))


def retrieve(asked: DataFrame, knowledge: DataFrame, tier1: int = TIER1, tier2: int = TIER2) -> DataFrame:
    """(turn_key, tier, ids): the best rows by shared words among confirmed ones; where none is found, among stale and
    conflicted ones too. knowledge(id, status, text, visible)."""
    words = asked.select("turn_key", F.explode(T.rank_tokens(F.col("user_text"))).alias("term"))
    have = knowledge.filter(F.col("visible") & F.col("status").isin("confirmed", "stale", "conflicted")).select("id", (F.col("status") == "confirmed").alias("firm"), F.explode(T.rank_tokens(F.col("text"))).alias("term"))
    hits = words.join(have, "term").groupBy("turn_key", "id", "firm").agg(F.count(F.lit(1)).alias("shared"))
    best = lambda rows, n: F.transform(F.slice(F.sort_array(rows), 1, n), lambda r: r.id)
    row = F.struct((-F.col("shared")).alias("shared"), "id")
    x = hits.groupBy("turn_key").agg(F.collect_list(F.when(F.col("firm"), row)).alias("firm"), F.collect_list(row).alias("every"))
    return x.select("turn_key", F.when(F.size("firm") > 0, "tier1").otherwise("tier2").alias("tier"), F.when(F.size("firm") > 0, best(F.col("firm"), tier1)).otherwise(best(F.col("every"), tier2)).alias("ids"))


def extracted(parsed: DataFrame) -> DataFrame:
    """Structured statements of the turns as candidates (first turn of a key) with the turn's evidence as citations."""
    whole = F.array_join(F.transform("evidence", lambda e: e.text), "\n")
    x = parsed.withColumn("text", whole).withColumn("s", T.structure(F.col("text"))).filter(F.col("s.predicate").isNotNull())
    base = F.concat(F.lit("session="), F.col("session_id"), F.lit(";thread="), F.coalesce("thread_id", F.lit("")), F.lit(";turn="), F.col("turn_id"))
    cited = F.transform("evidence", lambda e, i: F.struct(F.concat(F.lit("session://"), e.kind).alias("source"), F.concat(base, F.lit(";evidence="), i.cast("string")).alias("locator"), F.substring(e.text, 1, EXCERPT).alias("excerpt")))
    claim = x.select(F.sha2(F.concat_ws("|", "s.subject", "s.predicate", "s.value").cast("binary"), 256).alias("key"), "turn_key", "s.claim_type", "s.subject", "s.predicate", "s.value", F.length("text").alias("n_chars"), cited.alias("citations"))
    return claim.groupBy("key").agg(F.min_by(F.struct(*[c for c in claim.columns if c != "key"]), "turn_key").alias("c")).select("key", "c.*")


def judged(claims: DataFrame) -> DataFrame:
    """The cycle's verdict on new candidates: confirmed with enough citations and score."""
    n = F.size("citations")
    score = F.round(validation_score(n, F.col("n_chars"), F.lit(True), F.lit(0.5)), 6)
    return claims.withColumn("score", score).withColumn("status", F.when((n >= MIN_CITATIONS) & (score >= MIN_SCORE), "confirmed").otherwise("candidate"))


def process(lines: DataFrame, knowledge: DataFrame, root: str, state: str) -> None:
    """Per batch: parse, retrieve by tiers, extract, ingest what no earlier batch has, judge. Folders below ``root``: turns,
    claims, quarantine. A batch that is run again replaces its own rows, and sees those of earlier batches only."""
    spark = lines.sparkSession
    schema = "key string, turn_key string, claim_type string, subject string, predicate string, value string, n_chars int, citations array<struct<source:string,locator:string,excerpt:string>>, score double, status string"
    if not spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims")):
        spark.createDataFrame([], f"{schema}, batch int").write.partitionBy("batch").mode("append").parquet(f"{root}/claims")

    def put(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        parsed = turns(batch).withColumn("turn_key", F.concat_ws("/", "session_id", "thread_id", "turn_id"))
        parsed.filter("bad").select("file", "at", "line").write.mode("overwrite").parquet(f"{root}/quarantine/batch={n}")
        good = parsed.filter(~F.col("bad"))
        found = retrieve(good, knowledge)
        good.join(found, "turn_key", "left").select("turn_key", F.size("evidence").alias("n_evidence"), F.coalesce("tier", F.lit("tier2")).alias("tier"), F.coalesce("ids", F.array().cast(f"array<{knowledge.schema['id'].dataType.simpleString()}>")).alias("retrieved")).write.mode("overwrite").parquet(f"{root}/turns/batch={n}")
        have = session.read.schema(f"{schema}, batch int").parquet(f"{root}/claims").filter(F.col("batch") < n).select("key")
        judged(extracted(good)).join(have, "key", "left_anti").write.mode("overwrite").parquet(f"{root}/claims/batch={n}")

    lines.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
