"""Semi-structured sources: transcripts, turn rows, exports, articles, files and federated graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_BLOCK = "array<struct<type:string,text:string>>"


def transcript(lines: DataFrame, column: str = "line", least: int = 20) -> DataFrame:
    """JSON lines with a nested message or top-level role and content; list contents keep their text blocks only."""
    nested = F.from_json(column, f"message struct<role:string,content:{_BLOCK}>")
    plain = F.from_json(column, "message struct<role:string,content:string>, role string, content string")
    x = lines.withColumn("_n", nested).withColumn("_p", plain)
    blocks = F.array_join(F.transform(F.filter("_n.message.content", lambda b: b.type == "text"), lambda b: b.text), "\n")
    x = x.withColumn("role", F.coalesce("_n.message.role", "_p.message.role", "_p.role")).withColumn("content", F.coalesce(F.when(F.size("_n.message.content") > 0, blocks), "_p.message.content", "_p.content"))
    return x.drop("_n", "_p").filter(F.col("role").isin("user", "assistant") & (F.length("content") >= least))


def normalised_turns(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows of three shapes (events[], messages[], flat) as user_text, assistant_text and observations."""
    schema = "user_text string, assistant_text string, observations array<string>, events array<struct<role:string,text:string>>, messages array<struct<role:string,content:string>>"
    x = lines.withColumn("_j", F.from_json(column, schema))

    def joined(role: str) -> Column:
        events = F.array_join(F.transform(F.filter("_j.events", lambda e: e.role == role), lambda e: e.text), "\n")
        messages = F.array_join(F.transform(F.filter("_j.messages", lambda e: e.role == role), lambda e: e.content), "\n")
        return F.coalesce(F.col(f"_j.{role}_text"), F.when(F.exists("_j.events", lambda e: e.role == role), events), F.when(F.exists("_j.messages", lambda e: e.role == role), messages))

    return x.withColumns({"user_text": joined("user"), "assistant_text": joined("assistant"), "observations": F.col("_j.observations")}).drop("_j")


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chat messages as evidence items, one for each (chat, id)."""
    schema = "id string, chat_id string, chat_name string, sender_id string, sender_name string, timestamp string, type string, text string"
    x = spark.read.schema(schema).json(path, multiLine=True).filter("type = 'text' OR type IS NULL")
    return x.select("chat_id", "id", "sender_id", F.try_to_timestamp("timestamp").alias("occurred_at"), "text").dropDuplicates(["chat_id", "id"])


def claim_lines(spark: SparkSession, path: str) -> DataFrame:
    """Claims from JSON lines; lines that don't parse are kept apart in _corrupt_record."""
    return spark.read.schema("id string, text string, scope string, confidence double, _corrupt_record string").json(path, mode="PERMISSIVE")


def markdown_articles(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with front matter: slug, title, date, claim ids and body."""
    x = spark.read.text(path, wholetext=True).withColumn("slug", F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1))
    front = F.regexp_extract("value", r"^---\n([\s\S]*?)\n---", 1)
    ids = F.transform(F.regexp_extract_all(F.regexp_extract(front, r"claims:\s*\[([^\]]*)\]", 1), F.lit(r"\d+"), F.lit(0)), lambda v: v.cast("long"))
    return x.select("slug", F.regexp_extract(front, r"title:\s*(.+)", 1).alias("title"), F.regexp_extract(front, r"date:\s*(\S+)", 1).alias("date"), ids.alias("claim_ids"), F.regexp_replace("value", r"^---\n[\s\S]*?\n---\n?", "").alias("body"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Any files as (path, length, content); text and HTML become visible text."""
    x = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return x.select("path", "length", F.when(F.lower("path").rlike(r"\.html?$"), visible_text(text)).when(F.lower("path").rlike(r"\.(txt|md)$"), text).alias("text"))


def federated_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of graph files, tagged with the file they come from."""
    x = spark.read.schema("nodes array<struct<id:string,label:string>>").json(path, multiLine=True)
    return x.select(F.input_file_name().alias("repo"), F.explode("nodes").alias("n")).select("repo", "n.id", "n.label")


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, basic character references decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))
