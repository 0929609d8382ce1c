import collections
import hashlib
import re

import numpy as np
import pyarrow as pa

from claimforge.llm import chat, fm_index, jaccard_join, language, mixing, passages, quality, tokens, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingle_set(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


def test_jaccard_join(docs, corpus):
    got = collections.Counter(tuple(r) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == components(corpus)
    assert sum(c for (d, n, k), c in got.items() if d != k) >= 10


def test_jaccard_join_of_one_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if j not in {i % 120, (i * 7) % 120} or i % 3 else f"x{i}" for j, w in enumerate(base))) for i in range(300)]
    got = collections.Counter(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components(rows)


def test_boundary_enumerates_only_where_cheaper():
    assert jaccard_join.boundary({}) == 3
    assert jaccard_join.boundary({4: 1000}) >= 4
    assert 3 <= jaccard_join.boundary({9: 1000, 12: 1000}) <= 9


def test_small_sets_are_joined_by_subsets(spark):
    rows = [(i, " ".join(f"a{j + i % 3}" for j in range(8 + i % 4))) for i in range(24)]
    got = collections.Counter(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components(rows)


def test_exact_passages_are_found_once_and_cut(docs, corpus):
    found = passages.repeated_passages(docs)
    rows = found.collect()
    assert rows and all(r.doc_id > r.keeper_doc_id and r.end_word - r.start_word >= 50 for r in rows)
    before, after = collections.defaultdict(set), collections.defaultdict(set)
    for r in corpus:
        w = split(r[1])
        for i in range(len(w) - 49):
            if r[0] is not None:
                before[tuple(w[i : i + 50])].add(r[0])
    kept = passages.cut(docs, found).collect()
    for r in kept:
        w = split(r.text)
        for i in range(len(w) - 49):
            if r.doc_id is not None:
                after[tuple(w[i : i + 50])].add(r.doc_id)
    assert any(len(v) > 1 for v in before.values())
    assert not [v for v in after.values() if len(v) > 1]
    flagged = {r.doc_id for r in rows}
    clean = {r[0]: r[1] for r in corpus if r[0] not in flagged}
    assert all(r.text == clean[r.doc_id] for r in kept if r.doc_id in clean and r.doc_id is not None)


def test_compact_windows_match_their_definition():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    doc = np.repeat([0, 1], [180, 120])
    c, left, right = passages.compact_windows(value, doc, 0, 20)
    h = passages.mix(value ^ passages.mix(np.array([77], dtype=np.uint64))[0]) >> np.uint64(26)
    for lo, hi in ((0, 180), (180, 300)):
        for s in range(lo, hi - 19):
            m = s + int(np.argmin(h[s : s + 20]))
            k = list(c).index(m)
            assert left[k] <= s and s + 19 <= right[k]
    for a, b, m in zip(left, right, c):
        assert h[a : b + 1].min() == h[m] and b - a + 1 >= 20


def brute_hits(text, items):
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = re.findall(rx, (text or "").translate(LOW)), set(), []
    for k, t in items:
        p = re.findall(rx, (t or "").translate(LOW))
        n = min(10, len(p))
        ok = False
        for i in range(len(p) - n + 1) if p else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[i : i + n]:
                    hit |= set(range(j, j + n))
                    ok = True
        if ok:
            found.append(str(k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_fm_index_finds_every_window(spark, docs, corpus):
    long = max((r[1] for r in corpus if r[1] and r[1].count(" ") > 100 and r[1].count(" ") < 1000), key=len)
    w = long.split()
    items = [(1, " ".join(w[5:30])), (2, " ".join(w[40:44])), (3, None), (4, "!!"), (5, " ".join(w[5:30])), (10, "a b c d e a b c d e a b"), (6, "nowhere to be seen at all in any of the texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expect = collections.Counter((r[0], *brute_hits(r[1], items)) for r in corpus)
    for size in (fm_index.BLOCK_BYTES, 60):
        found = fm_index.digests(fm_index.decontaminate(docs.select("doc_id", "text"), bench, size))
        assert collections.Counter(tuple(r) for r in found.collect()) == expect


def test_fm_index_locates_in_periodic_text():
    text = np.array([0] + [2, 3] * 40 + [1] + [2] * 30)
    index = fm_index.FMIndex(text)
    lo, hi = index.search(np.array([[-1, 2, 3], [2, 2, 2], [-1, 3, 3]]))
    spots = [sorted(index.locate(np.arange(a, b)).tolist()) for a, b in zip(lo, hi)]
    t = text.tolist()
    assert spots == [[i for i in range(len(t) - 1) if t[i : i + 2] == [2, 3]], [i for i in range(len(t) - 2) if t[i : i + 3] == [2, 2, 2]], []]


def test_quality_counts(docs, corpus, labels):
    got = {(r.doc_id): r for r in quality.judge(docs, quality.fit_quality(docs, labels)).collect()}
    for r in corpus:
        if r[0] is None:
            continue
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
        assert g.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (g.base_failed and g.kept)


def test_trees_obey_their_constraints():
    from claimforge.llm import gbt

    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (600, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(0, 1, 600) < 0.1)).astype(float)
    f = gbt.fit(x, y, np.array([-1, 0, 1]))
    grid = np.full((50, 3), 0.4)
    for j, sign in ((0, -1), (2, 1)):
        g = grid.copy()
        g[:, j] = np.linspace(0, 1, 50)
        assert (sign * np.diff(f.margin(g)) >= -1e-12).all()
    assert ((f.probability(x) >= 0.5) == (x[:, 0] < 0.5)).mean() > 0.9


def test_block_max_search_equals_brute_force_on_texts(corpus):
    from claimforge.llm.kernel import NON_ALNUM, Words

    texts = sorted({r[1] for r in corpus if r[1]})
    hashes, counts = [], []
    for _, _, raw, at in toxicity.chunks(pa.array(texts)):
        h, c, bounds = toxicity.word_counts(Words(raw, at, NON_ALNUM))
        hashes += [h[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        counts += [c[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
    labels = [int("vile" in t) for t in texts]
    index = toxicity.build(list(range(len(texts))), labels, hashes, counts)
    # every example with a word of the index is in it, of both labels
    df = collections.Counter(x for h in hashes for x in h.tolist())
    full = [i for i, h in enumerate(hashes) if any(df[x] >= toxicity.MIN_DF for x in h.tolist())]
    assert index.ids.tolist() == full and set(index.labels) == {0.0, 1.0}
    word_list = {k: i for i, k in enumerate(index.vocabulary.tolist())}
    assert set(word_list) == {x for x, n in df.items() if n >= toxicity.MIN_DF}

    def unit(h, c):
        v = np.zeros(len(word_list))
        for x, n in zip(h.tolist(), c.tolist()):
            if x in word_list:
                v[word_list[x]] = (1 + np.log(n)) * index.idf[word_list[x]]
        return v / (np.sqrt((v * v).sum()) or 1)

    every = np.stack([unit(hashes[i], counts[i]) for i in full])
    for limit in (toxicity.FULL, 3):
        before, toxicity.FULL = toxicity.FULL, limit
        for i in range(0, len(texts), 3):
            n, cos = index.nearest(*index.vector(hashes[i], counts[i]))
            want = every @ unit(hashes[i], counts[i])
            best = sorted((j for j in range(len(want)) if want[j] > 0), key=lambda j: (-round(want[j], 9), full[j]))[: toxicity.NEIGHBOURS]
            assert np.allclose(cos, want[best], atol=1e-9) and len(n) == len(best)
            assert sorted(round(want[j], 8) for j in n) == sorted(round(want[j], 8) for j in best)
        toxicity.FULL = before


def test_clashing_labels_and_texts_of_an_id_are_settled(spark):
    docs = spark.createDataFrame([(i, t) for i in range(1, 60) for t in (["vile word here"] if i % 2 else ["kind word here", "a kind word"])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i in range(1, 60) for t in ([0, 1] if i % 2 else [0])], "doc_id long, toxic int")
    one, two = (toxicity.fit_toxicity(docs.repartition(k), labels.repartition(k)) for k in (1, 5))
    assert one.ids.tolist() == two.ids.tolist() and one.labels.tolist() == two.labels.tolist() and set(one.labels) == {0.0, 1.0}


def test_toxicity_of_held_out_documents(docs, labels, corpus):
    index = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score(docs, index).collect()
    truth = {r[0]: int("vile" in (r[1] or "")) for r in corpus}
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id is not None]
    assert sum(right) / len(right) > 0.9
    assert all(truth[e] in (0, 1) for r in rows for e in r.evidence)


def test_language_of_held_out_documents(docs, corpus):
    rows = language.identify(docs, language.fit_language(docs)).collect()
    truth = {r[0]: (r[2], r[1]) for r in corpus}
    right = [r.lang_pred == truth[r.doc_id][0] for r in rows if r.held_out and r.doc_id is not None and len(truth[r.doc_id][1] or "") > 100 and "A" * 50 not in truth[r.doc_id][1]]
    assert sum(right) / len(right) > 0.9
    for r in rows:
        t = corpus[0][1] if r.doc_id is None else truth[r.doc_id][1]
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))


def test_formatting_round_trip(spark):
    awkward = ["", "\\", "\\\\", "### x", "</turn>\n", "a\\### Assistant: </turn> ok", "ü\n#", None, "\\n", "#\\", "\\#", "<\\\\#\\n"]
    rows = [(c, t, r, awkward[(c + t) % len(awkward)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "as#s\\\n"])]
    x = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in x.collect():
        assert chat.parse_turn(bytes(r.formatted)) == (r.role.encode(), (awkward[(r.conv_id + r.turn) % len(awkward)] or "").encode())
        body = bytes(r.formatted)[len(chat.HEAD) : -len(chat.TAIL)]
        assert b"###" not in body and b"</turn>" not in body
    d = {r.conv_id: r for r in chat.digests(x).collect()}
    for c in range(12):
        own = [(r, t or "") for k, _, r, t in rows if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert d[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (d[c].n_turns, d[c].loss_chars, d[c].loss_sha256) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_a_long_conversation_is_streamed(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(100)] + [(2, 0, "user", "x")]
    d = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert d[1].n_turns == 100 and d[2].n_turns == 1
    assert d[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()


def test_token_counts_whatever_the_blocks(spark, docs, corpus, tmp_path):
    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        enc = tokens.encoder(f.read())
    expect = collections.Counter((r[0], len(enc.encode_ordinary(r[1])) if r[1] else 0) for r in corpus)
    for block in (tokens.BLOCK, 64):
        blocks, order = tokens.write_tokens(docs, block=block)
        got = tokens.scan(blocks).join(order, ["stream", "ordinal"])
        assert blocks.columns == ["stream", "block", "data"]
        assert collections.Counter((r.doc_id, r.n_tokens) for r in got.collect()) == expect
    flat = np.array([5, 6, tokens.EOD, tokens.EOD, 7, tokens.EOD, 9], dtype="<u2")
    flat.tofile(tmp_path / "a.bin")
    got = tokens.scan(tokens.blocks_of_files(spark, str(tmp_path / "*.bin"), block=2)).orderBy("ordinal").collect()
    assert [r.n_tokens for r in got] == [2, 0, 1]


def test_mixing_matches_a_plain_calculation(docs, corpus):
    rows = mixing.mix_sources(docs, carry=("source",)).collect()
    assert len(rows) == len(corpus)
    sizes = collections.Counter()
    for r in corpus:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if 3 * sizes[s] < level * weight[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}
    took = collections.Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        took[r.source] += r.taken
    assert all(abs(took[s] - target[s]) <= 40 for s in names)
    again = mixing.mix_sources(docs.repartition(5), carry=("source",)).collect()
    assert collections.Counter(rows) == collections.Counter(again)


def test_sainte_lague_equals_seat_by_seat(spark):
    votes = [(i, v) for i, v in enumerate([53, 24, 23, 0, 7, 7, 1])]
    for seats in (1, 7, 40, 115):
        df = spark.createDataFrame([(0, i, v, seats) for i, v in votes], "g int, k int, v long, seats long")
        got = {r.k: r.quota for r in mixing.sainte_lague(df, "v", "seats", ["g"], ["k"]).collect()}
        want = dict.fromkeys(got, 0)
        for _ in range(seats):
            best = max((v for v in votes if v[1]), key=lambda p: (p[1] / (2 * want[p[0]] + 1), -p[0]))
            want[best[0]] += 1
        assert got == want


def test_pa_is_used_for_whole_batches():
    n, hits, items = fm_index.search_chunk(np.zeros(0, np.uint8), np.array([0]), fm_index.phrases([], pa.array([], pa.large_string())))
    assert len(n) == 0 and not hits and not items


def shared_windows(rows):
    """Windows of 50 words by the documents that hold them, for windows of two documents or more."""
    held = collections.defaultdict(set)
    for k, t in rows:
        w = split(t)
        for i in range(len(w) - 49):
            held[tuple(w[i : i + 50])].add(k)
    return [(w, v) for w, v in held.items() if len(v) > 1]


def passages_left(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return shared_windows([tuple(r) for r in passages.cut(docs, passages.repeated_passages(docs)).collect()])


def fresh(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 60, n)]


def test_passages_behind_decoys_of_a_common_line_are_found(spark):
    rng, rows = np.random.default_rng(3), []
    for _ in range(12):
        line = fresh(rng, 48)
        passage = [*fresh(rng, 2), *line, *fresh(rng, 2)]
        for middle in (line, line, line, passage, passage, passage):
            rows.append((len(rows), " ".join([*fresh(rng, 60), *middle, *fresh(rng, 60)])))
    assert shared_windows(rows)
    assert not passages_left(spark, rows)


def test_every_window_of_a_row_counts(spark):
    rng, rows = np.random.default_rng(4), []
    for _ in range(6):
        line = fresh(rng, 44)
        one, two = ([*fresh(rng, 4), *line, *fresh(rng, 4)] for _ in range(2))
        for middle in (one, two, [*one, *fresh(rng, 80), *two]):
            rows.append((len(rows), " ".join([*fresh(rng, 60), *middle, *fresh(rng, 60)])))
    assert not passages_left(spark, rows)


def test_a_row_of_many_windows_is_done_only_if_one_match_holds_all(spark):
    at = [(7, 2, (100 << 32) | (45 << 16) | 300, tail, 1, 0) for tail in (0, 200)]
    lists = spark.createDataFrame(at, "key long, doc long, span long, tail int, pivot long, pivot_span long")
    match = spark.createDataFrame([(2, 50, 160, 1, 0, 1.0)], passages.MATCH)
    assert {r.tail: r.need for r in passages.undone(lists, match).collect()} == {0: False, 200: True}
    x = np.arange(400, dtype=np.uint64)
    x[250] = x[100]
    start, need = passages.stretches(x, np.array([(100 << 32) | (45 << 16) | 300]), np.array([200]), np.array([True]))
    assert set(range(55, 101)) | set(range(205, 251)) == set(start.tolist()) and need.all()


def test_similar_parts_of_a_stretch_are_found():
    rng = np.random.default_rng(6)

    def hashes(w):
        return np.array([hash(tuple(w[i : i + 5])) & (2**63 - 1) for i in range(len(w) - 4)], dtype=np.uint64)

    def everywhere(x):
        return np.array([((len(x) // 2) << 32) | (len(x) << 16) | len(x)])

    for changes in ([33, 66, *range(107, 150, 8)], [*range(7, 50, 8), 83, 116], [25, 50, 75, *range(100, 140, 7), 190]):
        p = fresh(rng, 230)
        w = list(p)
        for i in changes:
            w[i] = fresh(rng, 1)[0]
        x, y = hashes(w), hashes(p)
        need = np.zeros(len(x), dtype=bool)
        for s in range(len(x)):
            for e in range(s + 46, len(x) + 1):
                a, b = set(x[s:e].tolist()), set(y[s:e].tolist())
                if x[s] == y[s] and x[e - 1] == y[e - 1] and len(a & b) >= 0.8 * len(a | b):
                    need[s:e] = True
        got = np.zeros(len(x), dtype=bool)
        for s, e, _, similarity in passages.shared_passages(x, y, everywhere(x), everywhere(y)):
            assert similarity >= 0.8
            got[s : e - 4] = True
        assert need.any() and not (need & ~got).any()


def test_lists_in_blocks_and_hot_keys_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    licence, rows = [f"l{i}" for i in range(40)], []
    for i in range(150):
        extra = [f"x{v}" for v in rng.integers(0, 12, rng.integers(0, 9))]
        rows.append((i, " ".join([*licence[: rng.integers(28, 41)], *extra])))
    expect = components([(r[0], r[1]) for r in rows])
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert len(jaccard_join.common_shingles(docs)[1]) > 5
    assert collections.Counter(tuple(r) for r in jaccard_join.near_duplicates(docs).collect()) == expect


def test_parity_maps_bound_the_overlap():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 62, n)).astype(np.uint64) for n in (1, 200, 300, 1100, 5000)]
    sets += [np.unique(np.concatenate([s[len(s) // 9 :], rng.integers(0, 1 << 62, 9).astype(np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    maps = jaccard_join.parity_maps(np.concatenate(sets), n)
    width = jaccard_join.widths(maps)
    for i in range(len(sets)):
        for j in range(len(sets)):
            to = min(width[i], width[j])
            x, y = (jaccard_join.rows_of(maps, np.array([k]), width[k], to) for k in (i, j))
            differ = int(np.bitwise_count(x ^ y).sum())
            assert differ <= len(np.setxor1d(sets[i], sets[j])) and (differ == 0 or i != j)


def test_rows_that_repeat_an_id_with_another_text_are_their_own(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(10)
    p, u = " ".join(fresh(rng, 100)), " ".join(fresh(rng, 300))
    rows = [(1, p), (2, p + " tail"), (2, u)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in P.near_copies(spark, docs, str(tmp_path)).collect()) == [(1, p), (2, u)]
    cut = [(1, p), (2, "aa " + p + " tail"), (2, u)]
    docs = spark.createDataFrame(cut, "doc_id long, text string")
    assert sorted(tuple(r) for r in passages.cut(docs, passages.repeated_passages(docs)).collect()) == sorted([(1, p), (2, "aa\ntail"), (2, u)])
