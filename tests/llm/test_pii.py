"""Personal data against plain Python: base spans by re, disclosures by counting."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from claimforge.llm import pii as P

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TOKEN = re.compile(r"(?<=[\x20\x09-\x0D])([\"'(\[]{0,2})([^\W\d_]{2,})(?=[.,;:!?)\]\"']{0,3}[\x20\x09-\x0D])")


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return True


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k in PLAIN for m in PLAIN[k].finditer(text or "") if good(k, m.group())]


def words(text):
    return [(m.group(2).lower(), m.start(2) - 1, m.end(2) - 1) for m in TOKEN.finditer(f" {text} ")]


def key(kind, v):
    return v.lower() if kind == "email" else v if kind == "ip" else re.sub("[^0-9]", "", v)


def brute(texts, support=P.SUPPORT):
    texts = [t or "" for t in texts]
    found = [base(t) for t in texts]
    df_t, df_e, n = Counter(), Counter(), Counter()
    near = []
    for t, spans in zip(texts, found):
        df_t.update({w for w, _, _ in words(t)})
        df_e.update({(k, key(k, v)) for k, _, _, v in spans})
        mine = [((k, key(k, v)), w, a, b) for k, s, e, v in spans for w, a, b in words(t) if (a - 1 >= s - P.CONTEXT and b < s + 1 and not (a == 0 and s > P.CONTEXT)) or (a >= e and b < e + P.CONTEXT)]
        near.append(mine)
        n.update({(e, w) for e, w, _, _ in mine})
    out = []
    for spans, mine in zip(found, near):
        share = defaultdict(float)
        for e, w, a, b in mine:
            if n[e, w] >= support and df_e[e] < len(texts):
                share[a, b] = max(share[a, b], math.log(n[e, w] * len(texts) / (df_e[e] * df_t[w])) / math.log(len(texts) / df_e[e]))
        names = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
        more = [f"{kind}:{a}:{b}" for kind, ok in (("generalise", lambda x: P.GENERALISE <= x < P.REMOVE), ("remove", lambda x: x >= P.REMOVE)) for (a, b), x in sorted(share.items()) if ok(x)]
        out.append((*[sum(k == kind for k, *_ in spans) for kind in PLAIN], hashlib.sha256(",".join(names).encode()).hexdigest(), ",".join(names + more)))
    return out


def got(spark, texts, parts=3):
    rows = [(i, t, "a", "b", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, spans string, row int").repartition(parts)
    return [tuple(r[1:]) for r in sorted(P.digests(P.personal_data(df)).collect())]


EDGE = [
    None, "", " ", "a@b.c", "x a@b.c_x@d.e-f.gg@h.i", "a@b@c.d", "a@b", "@b.c", "a.b@c..d", "é a@é.c ü@b.cc", "\U0001f600 me@x.yz \U0001f600 1.2.3.4",
    "1.2.3.4.5.6.7.8", "01.002.0003.255", "256.1.1.1 1.256.1.1", "1.2.3", "v1.2.3.4x", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111", "0000000000000", "4111  1111 1111 1111",
    "1 4111 1111 1111 1111", "+1 (988) 555-2485", "++4912345678901 +1 2", "+1 555", "+49 (0)30-123456.78 ", "+1234567890123456", "+123456789 +1", "+1+12345678901", "tel +1 (988) 555-2485, (mail me@x.yz)",
]


def test_edges_equal_plain_python(spark):
    assert got(spark, EDGE) == brute(EDGE)


def test_generated_texts_equal_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1.2@+- (5)é\n9") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    assert got(spark, texts) == brute(texts)


def corpus(rng):
    common = ["the", "office", "of", "and", "report", "to", "with", "letter", "Straße", "was"]
    texts = []
    for i in range(300):
        w = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        if i % 25 == 0:
            w[len(w) // 2 : len(w) // 2] = ["Professor", "Quillfeather,", "qf@uni.example.org", "(astronomer)", "+1 (988) 555-2485"]
        if i % 3 == 0:
            w += ["write", "to", "help@hot.example", "office"]
        if i % 31 == 0:
            w += ["solo", f"u{i}@x.org"]
        if i == 7:
            w += ["astronomer", "alone"]
        texts.append(" ".join(w))
    return [*texts, texts[0], None, ""]


def test_words_that_disclose_equal_plain_python(spark):
    texts = corpus(random.Random(4))
    mine = got(spark, texts)
    assert mine == brute(texts)
    assert "remove:" in mine[0][-1] and all(":" not in m[-1] for m, t in zip(mine, texts) if not base(t))
    assert got(spark, texts, 7) == mine


def test_sanitised_text(spark):
    texts = corpus(random.Random(4))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = dict(P.sanitised(P.personal_data(df, keep_text=True)).collect())
    assert "qf@uni" not in out[0] and "Quillfeather" not in out[0] and "[EMAIL]" in out[0] and "[PHONE]" in out[0]
    assert out[7] == texts[7] and out[len(texts) - 2] == ""
    overlap = spark.createDataFrame([(1, "x 4111 1111 1111 1111 y +4111111111111111 z")], "doc_id long, text string")
    assert P.sanitised(P.personal_data(overlap, keep_text=True)).first().text == "x [CARD] y +[CARD] z"


LONG = {
    "a" * 400_000 + " a@b.c": (1, 0, 0, 0), "1" * 400_000: (0, 0, 0, 0), "1 " * 150_000: (0, 0, 0, 0), "a.b@" + "c." * 100_000 + "d": (1, 0, 0, 0), "a@b" + ".c@" * 50_000: (1, 0, 0, 0),
    "+1" + "(" * 300_000: (0, 0, 0, 0), "1." * 40_000: (0, 10_000, 0, 0), "a@b.c " * 2_000: (2_000, 0, 0, 0),
}


def test_very_long_tokens_take_their_length(spark):
    assert [r[:4] for r in got(spark, list(LONG))] == list(LONG.values())


def test_empty_table(spark):
    assert P.digests(P.personal_data(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
