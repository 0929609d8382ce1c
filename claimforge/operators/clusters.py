"""Compact summaries: order-dependent first-fit clusters with running means, split, and summarised with injected text.

A vector joins the first cluster, in order of founding, whose centroid is similar enough; the centroid is then the mean of
its members so far. A row without a vector joins the first cluster that holds its subject, or founds one. The job runs
over ``RUN`` ids of a scope at a time, as repeated runs of a bounded batch do, so a scope of any size is many groups of
bounded size, and no order is needed beyond a group's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD, LEAST, MOST, RUN, TEXT_CHARS = 0.65, 3, 20, 500, 300


def fit_first(vectors: list, subjects: list, threshold: float) -> list[int]:
    """The cluster number of each row, in the rows' order."""
    dim = next((len(v) for v in vectors if v is not None), 0)
    centroids, norms, sizes, held, out = np.zeros((len(vectors), dim)), np.zeros(len(vectors)), [], [], [-1] * len(vectors)
    for i, v in enumerate(vectors):
        if v is None:
            continue
        v = np.asarray(v, dtype=float)
        n = len(sizes)
        scale = norms[:n] * np.sqrt(v @ v)
        cos = np.divide(centroids[:n] @ v, scale, out=np.zeros(n), where=scale > 0)
        fits = np.flatnonzero(cos >= threshold)
        at = int(fits[0]) if len(fits) else n
        if at == n:
            sizes.append(0)
            held.append(set())
        sizes[at] += 1
        centroids[at] = (centroids[at] * (sizes[at] - 1) + v) / sizes[at]
        norms[at] = np.sqrt(centroids[at] @ centroids[at])
        held[at].add(subjects[i])
        out[i] = at
    for i, v in enumerate(vectors):
        if v is not None:
            continue
        at = next((c for c, s in enumerate(held) if subjects[i] and subjects[i] in s), len(held))
        if at == len(held):
            held.append(set())
        held[at].add(subjects[i])
        out[i] = at
    return out


def first_fit(rows: DataFrame, threshold: float = THRESHOLD, run: int = RUN) -> DataFrame:
    """rows(id, scope, subject, v) -> (scope, run, id, cluster, place): cluster is its founder's id, place counts from 0."""

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        subjects = [s.strip().lower() if isinstance(s, str) else None for s in pdf["subject"]]
        number = pd.Series(fit_first(list(pdf["v"]), subjects, threshold), dtype=int)
        embedded = pdf["v"].map(lambda v: v is not None)
        order = np.lexsort((pdf["id"].to_numpy(), ~embedded.to_numpy(), number.to_numpy()))  # members as they came: vectors first
        x = pd.DataFrame({"id": pdf["id"].to_numpy()[order], "number": number.to_numpy()[order]})
        x["place"] = x.groupby("number").cumcount()
        x["cluster"] = x.groupby("number")["id"].transform("first")
        return x.assign(scope=key[0], run=key[1])[["scope", "run", "id", "cluster", "place"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    x = rows.select("id", "scope", F.col("subject").cast("string").alias("subject"), "v", F.floor(F.col("id") / run).alias("run"))
    return x.groupBy("scope", "run").applyInPandas(group, f"scope {kinds['scope']}, run long, id {kinds['id']}, cluster {kinds['id']}, place long")


def claim_line(i: Column, m: Column) -> Column:
    part = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name), value))
    return F.concat_ws(" | ", F.concat(F.lit("["), i.cast("string"), F.lit("]")), part("Subject: ", m.subject), part("Predicate: ", m.predicate), part("Value: ", m.value), part("Text: ", F.substring(m.text, 1, TEXT_CHARS)))


def summaries(claims: DataFrame, clusters: DataFrame, citations: DataFrame, summarise: Callable[[Column], Column], redact: Callable[[Column], Column], least: int = LEAST, most: int = MOST) -> DataFrame:
    """A summary for every part of at most ``most`` members of a cluster with ``least`` members or more: source ids, subject
    hint, redacted prompt block, injected summary text, and the members' citations, each once.

    claims(id, subject, predicate, value, text); citations(claim_id, source, locator). A group is one part: bounded.
    """
    parts = clusters.withColumn("part", F.floor(F.col("place") / most)).select("scope", "cluster", "part", "place", "id")
    x = parts.join(claims.select("id", "subject", "predicate", "value", "text"), "id")
    member = F.struct("place", "id", "subject", "predicate", "value", "text")
    g = x.groupBy("scope", "cluster", "part").agg(F.sort_array(F.collect_list(member)).alias("m")).filter(F.size("m") >= least)
    block = redact(F.array_join(F.transform("m", lambda m, i: claim_line(i + 1, m)), "\n"))
    g = g.select("scope", "cluster", "part", F.transform("m", lambda m: m.id).alias("source_ids"), F.coalesce(F.element_at("m", 1).subject, F.lit("unknown")).alias("subject_hint"), block.alias("block"))
    cited = g.select("cluster", "part", "scope", F.explode("source_ids").alias("claim_id")).join(citations, "claim_id").select("scope", "cluster", "part", "source", "locator").distinct()
    n = cited.groupBy("scope", "cluster", "part").agg(F.count(F.lit(1)).alias("citations"))
    return g.join(n, ["scope", "cluster", "part"], "left").withColumn("citations", F.coalesce("citations", F.lit(0))).withColumn("summary", summarise(F.col("block")))
