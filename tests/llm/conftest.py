import random

import pytest

EXTRA = ("score", "hits", "items", "n_words", "key", "doc", "n", "span", "predicted", "held_out", "_spans", "component_id", "taken", "size", "tokens")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(EXTRA))


def words(rng, n, lang="en"):
    parts = {"en": ["the", "ing", "tion", "er", "an", "wh"], "de": ["ung", "keit", "sch", "ein", "ß", "ü"]}[lang]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".", ","]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, toxic words, blanks, ties and repeated rows."""
    rng = random.Random(5)
    rows, k = [], 0
    passage = words(rng, 70)
    for i in range(90):
        lang = "de" if i % 4 == 0 else "en"
        w = words(rng, rng.choice([3, 20, 60, 200, 400]), lang)
        if i % 9 == 0:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        if i % 7 == 0:
            for _ in range(max(2, len(w) // 12)):
                w.insert(rng.randrange(len(w)), "vile")
        text = " ".join(w)
        rows.append(row(k, text, lang, f"s{i % 5}"))
        k += 1
        if i % 10 == 3:
            for _ in range(4):
                rows.append(row(k, text, lang, f"s{i % 5}"))
                k += 1
        if i % 10 == 5:
            near = list(w)
            near[len(near) // 2] = "changed"
            rows.append(row(k, " ".join(near), lang, None))
            k += 1
    rows += [row(k, None), row(k + 1, ""), row(k + 2, " \t\n"), row(k + 3, "one"), row(k + 4, "one"), row(k + 5, "12 34 !!"), row(k + 6, "A" * 5000), row(k + 7, "a b c d e " * 4000)]
    rows.append(rows[0])  # a repeated row
    rows.append(row(None, rows[1][1]))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = {r[0]: (r[0], int(len(r[1] or "") % 5 != 0), int("vile" in (r[1] or ""))) for r in corpus if r[0] is not None}
    return spark.createDataFrame([*rows.values(), (10**9, 1, 1), (10**9 + 1, None, None)], "doc_id long, quality int, toxic int")
