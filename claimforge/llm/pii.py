"""Personal data: exact patterns, and the words that disclose what they found, by information content. DataFrame functions only.

Base: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping for each
kind, with positions in code points. Patterns are written without backtracking over a run (possessive, and tried at a
run's first character only), so that one very long token costs no more than its length.

Method: every base value is a protected entity e. Words within ``CONTEXT`` characters of it co-occur with it; over all
documents, n(e, t) documents hold e with t beside it, df(e) hold e and df(t) hold the word anywhere. The word's disclosure
is its pointwise mutual information with e as a share of all there is to know about e:

    PMI(e; t) / IC(e) = ln(n(e, t) N / (df(e) df(t))) / ln(N / df(e)),      1: whoever reads t knows e.

Beside an occurrence of e, words at or above ``REMOVE`` are removed and those at or above ``GENERALISE`` are generalised to
their kind. A pair counts from ``SUPPORT`` documents on; fewer say nothing about a corpus. Documents without base values
are left as they are. A word is a token of two or more letters between white space, punctuation at its edges aside, so
that it never overlaps a base span.

Scale: one scan finds spans and keeps, for documents that have some, the characters beside them; one scan counts the
documents of every word, summed in each task before a shuffle; texts are never shuffled. Pairs of e and t are counted
before they meet, and occurrences join the few disclosing pairs over ``SALTS`` parts of a pair, so that an entity of a
third of all rows is many tasks. Only one document's own spans are gathered in one row.

Nulls, ties and repeats: a null text is empty. Rows that repeat a doc_id, or have none, are documents of their own.
Copies count as documents. A word beside two entities takes the stronger action, once. An empty table gives an empty
result; texts of any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from claimforge.llm.io import materialise

# The kinds in their order, and what they match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ADDED = ("generalise", "remove")
WORD = r"(?<=[\x20\x09-\x0D][\"'(\[]{0,2})\p{L}{2,}+(?=[.,;:!?)\]\"']{0,3}[\x20\x09-\x0D])"
CONTEXT, SUPPORT, GENERALISE, REMOVE, SALTS = 64, 3, 0.7, 0.85, 16
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(xs: Column) -> Column:
    """Sums of an array's elements up to each one: within blocks, and over the blocks before."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def over(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1)
        sums = F.transform(blocks, lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        before = lambda t: F.transform(blocks, lambda b: total(F.slice(t, F.lit(1), b)))
        place = lambda o: F.transform(v, lambda x, i: F.element_at(o, (i / BLOCK).cast("int") + 1) + total(F.slice(v, i - i % BLOCK + 1, i % BLOCK + 1)))
        return let(sums, lambda t: let(before(t), place))

    return let(xs, over)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches; the text between them gives their places."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def placed(b: Column) -> Column:
        step = F.zip_with(b.g, F.concat(F.array(F.lit("")), b.m), lambda g, m: F.length(g) + F.length(m))
        starts = F.slice(running(step), F.lit(1), F.size(b.m))
        return F.zip_with(b.m, starts, lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))

    return let(both, placed)


def luhn(digits: Column) -> Column:
    """The checksum of 13 to 19 digits: from the right, every second one doubled."""
    back = F.reverse(digits)

    def part(i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda s, x: s + x) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


# What a text must hold before a kind is looked for, and what a match must fulfil.
HINT = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": lambda t: t.rlike(r"\+[0-9]")}
VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda v: let(digits_of(v), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)),
    "phone": lambda v: F.length(digits_of(v)).between(9, 15),
}
KEY = {"email": F.lower, "ip": lambda v: v, "card": digits_of, "phone": digits_of}
SPAN = "struct<kind:int,start:int,end:int,value:string,left:string,right:string>"


def spans_of(text: Column, k: int) -> Column:
    kind = KINDS[k]

    def span(s: Column) -> Column:
        left = F.when(s.start <= CONTEXT, F.concat(F.lit(" "), F.substring(text, F.lit(1), s.start))).otherwise(F.substring(text, s.start - CONTEXT + 1, F.lit(CONTEXT)))
        right = F.substring(text, s.end + 1, F.lit(CONTEXT))
        right = F.when(F.length(right) < CONTEXT, F.concat(right, F.lit(" "))).otherwise(right)
        return F.struct(F.lit(k).alias("kind"), s.start.alias("start"), s.end.alias("end"), KEY[kind](s.value).alias("value"), left.alias("left"), right.alias("right"))

    found = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda s: VALID[kind](s.value)), span)
    return F.when(HINT[kind](text), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of all kinds in their order, each with its value's normal form and the characters beside it; a space stands
    for either end of the text."""
    return F.concat(*[spans_of(text, k) for k in range(len(KINDS))])


def occurrences(found: DataFrame) -> DataFrame:
    """(row, kind, value, term, start, end): words beside base spans."""
    x = found.select("row", F.explode("base").alias("s")).select("row", "s.*")
    at_left = F.when(F.col("start") <= CONTEXT, -1).otherwise(F.col("start") - CONTEXT)
    shifted = lambda words, by: F.transform(words, lambda w: F.struct(F.lower(w.value).alias("term"), (w.start + by).alias("start"), (w.end + by).alias("end")))
    words = F.concat(shifted(matches(F.col("left"), WORD), at_left), shifted(matches(F.col("right"), WORD), F.col("end")))
    return x.select("row", "kind", "value", F.explode(words).alias("w")).select("row", "kind", "value", "w.*")


def disclosures(found: DataFrame, beside: DataFrame, docs: DataFrame, support: int, generalise: float) -> DataFrame:
    """(kind, value, term, share): words whose disclosure of an entity reaches ``generalise``."""
    entities = found.select("row", F.explode("base").alias("s")).select("row", "s.kind", "s.value").distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("df_e"))
    pairs = beside.select("row", "kind", "value", "term").distinct().groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    text = F.lower(F.concat(F.lit(" "), F.col("text"), F.lit(" ")))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    total = found.agg(F.count(F.lit(1)).alias("n_docs"))
    x = pairs.join(entities, ["kind", "value"]).join(words, "term").crossJoin(F.broadcast(total))  # one row
    known = F.log(F.col("n_docs") / F.col("df_e"))
    share = F.log(F.col("n") * F.col("n_docs") / (F.col("df_e").cast("double") * F.col("df_t"))) / known
    return x.filter(F.col("df_e") < F.col("n_docs")).select("kind", "value", "term", share.alias("share")).filter(F.col("share") >= generalise)


def personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, base array<struct<kind, start, end, ...>>, added array<struct<kind, start, end, share>>, and the text if asked for."""
    text = F.coalesce("text", F.lit(""))
    kept = ["text"] if keep_text else []
    found = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).select("row", "doc_id", base_spans(F.col("text")).alias("base"), *kept), "personal-data")
    beside = occurrences(found)
    pairs = materialise(disclosures(found, beside, docs, support, generalise), "disclosures")
    spread = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = beside.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["kind", "value", "term", "salt"])
    best = hit.groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    action = F.when(F.col("share") >= remove, len(KINDS) + 1).otherwise(len(KINDS))
    added = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(action.alias("kind"), "start", "end", "share"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,share:double>>")
    return found.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"), *kept)


def named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string")))


def digests(found: DataFrame) -> DataFrame:
    of_kind = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base = F.array_join(named(F.col("base")), ",")
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(named(F.col("base")), named(F.col("added"))), ",").alias("spans"))


def sanitised(found: DataFrame) -> DataFrame:
    """(doc_id, text): base spans as [EMAIL] and so on, generalised words as [WORD], removed words without a trace. Of spans
    that overlap, the one that starts first (then the longer) stands for all that it touches. Needs ``keep_text``."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[WORD]"), F.lit(""))
    bare = lambda xs: F.transform(xs, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("end"), s.kind.alias("kind")))
    every = F.sort_array(F.concat(bare(F.col("base")), bare(F.col("added"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s.start - acc["at"])
        new = F.struct((-s.end).alias("at"), F.concat(acc.parts, F.array(gap, F.element_at(kinds, s.kind + 1))).alias("parts"))
        longer = F.struct(F.greatest(acc["at"], -s.end).alias("at"), acc.parts.alias("parts"))
        return F.when(s.start >= acc["at"], new).otherwise(longer)

    done = lambda acc: F.concat(F.array_join(acc.parts, ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate(every, start, step, done).alias("text"))
