"""What a part of the input holds too little of to send on still counts in the whole."""

import numpy as np

from claimforge.llm import html, passages


def test_template_blocks_rare_in_one_part_of_the_pages(spark):
    """A notice on 49 of 60 pages of a host, 9 of them among the 20 that one task counts, is fixed text; one on 47 isn't."""
    rows = []
    for i in range(60):
        notes = ["<p>Read our terms of use.</p>"] * (i < 49) + ["<p>Now with pictures.</p>"] * (i < 47)
        rows.append((i, "http://t.example/", f"<body><div class='x'><p>Story number {i} is told.</p>{''.join(notes)}</div></body>"))
    pages = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert text == {i: f"Story number {i} is told." + "\nNow with pictures." * (i < 47) for i in range(60)}
    (t,) = html.templates(pages).collect()
    blocks = [x for c in t.template.classes for x in c.tokens if x[0] != "<"]
    assert [x.rpartition(">")[2] for x in blocks] == ["Read our terms of use."] and t.template.pages == 60
    whole = html.templates(pages.coalesce(1)).collect()
    assert whole[0].template.slot == t.template.slot and sorted(map(str, whole[0].template.classes)) == sorted(map(str, t.template.classes))


def test_near_passages_behind_decoys_of_all_their_runs_are_found(spark):
    """Near passages without 50 equal words, each run of which three earlier documents hold alone, are found as without those."""
    rng = np.random.default_rng(8)

    def fresh(n):
        return ["w" + str(x) for x in rng.integers(0, 1 << 40, n)]

    alone, behind, pairs = [], [], []
    for g in range(12):
        runs = [fresh(35), fresh(48), fresh(35)]
        for run in runs * 3:
            behind.append((100 * g + len(behind) % 100, " ".join([*fresh(60), *run, *fresh(60)])))
        both = [(100000 + 10 * g + k, " ".join([*fresh(60), *runs[0], *fresh(1), *runs[1], *fresh(1), *runs[2], *fresh(60)])) for k in (0, 1)]
        alone, behind = alone + both, behind + both
        pairs.append((both[1][0], both[0][0]))

    def found(rows):
        out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r.similarity >= 0.8 for r in out)
        return {(r.doc_id, r.keeper_doc_id) for r in out if r.end_word - r.start_word >= 100}

    whole = found(alone)
    assert whole <= set(pairs) and len(whole) >= 8
    assert found(behind) == whole


def test_stretch_kinds_and_uncovered_match_their_definitions():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 60, 300).astype(np.uint64)
    assert passages.stretch_kinds(x).tolist() == [len(set(x[i : i + passages.LEAST].tolist())) for i in range(300 - passages.LEAST + 1)]
    free = passages.uncovered(30, [{"start_word": 3, "end_word": 12}, {"start_word": 20, "end_word": 40}])
    assert free.tolist() == [not (3 <= i <= 7 or 20 <= i) for i in range(30)]
    a, b = [np.arange(5, dtype=np.uint32), np.array([9], np.uint32)], [np.array([3, 3, 4, 8], np.uint32)]
    shared, fresh = passages.common_kinds(a, b, [np.array([1, 1, 1, 1, 0], bool), np.array([1], bool)])
    assert shared.tolist() == [[2], [0]] and fresh.tolist() == [[1], [0]]


def test_may_hold_loses_no_similar_part():
    rng = np.random.default_rng(11)
    for n in (60, 200):
        for _ in range(60):
            x = rng.integers(0, rng.choice([70, 1 << 30]), n).astype(np.uint32)
            others = [np.where(rng.random(n) < r, rng.integers(0, 1 << 30, n), x).astype(np.uint32)[rng.integers(0, 9) :] for r in (0.05, 0.15, 0.3)]
            hit = passages.may_hold(x, others)
            for h, p in zip(hit, others, strict=True):
                for s, e, _, _ in passages.shared_passages(x, p, passages._everywhere(x), passages._everywhere(p)):
                    inside = np.isin(x, p) & (np.arange(n) >= s) & (np.arange(n) <= e - passages.WIDTH)
                    assert (h[inside]).all()


def test_lists_of_near_copies_compare_few_pairs_and_find_what_loops_find(monkeypatch):
    """In two lists at once, one of many near copies: the pairs of a plain loop over all rows, with few comparisons of texts."""
    rng = np.random.default_rng(5)
    base, rows = rng.integers(0, 1 << 32, 160, dtype=np.uint32), []
    for doc in range(120):  # own shingles in eight places each; a few share a second passage
        x = base.copy()
        x[rng.choice(160, 8, replace=False)] = rng.integers(0, 1 << 32, 8, dtype=np.uint32)
        rows.append((1, doc, x))
    second = rng.integers(0, 1 << 32, 70, dtype=np.uint32)
    for doc in range(40):
        own = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
        rows.append((2, doc, np.concatenate([own, second if doc % 9 == 3 else second[:20], own[:5]])))
    group, doc = (np.array([r[k] for r in rows]) for k in (0, 1))
    kinds = [r[2] for r in rows]
    free = [rng.random(len(k)) < 0.9 for k in kinds]
    seeks, span = rng.random(len(rows)) < 0.8, np.arange(len(rows))
    least = np.array([passages.stretch_kinds(k).min() for k in kinds], dtype=np.int64)
    plain, whole, calls = [], passages.shared_passages, []
    for i in np.flatnonzero(seeks).tolist():
        still = free[i].copy()
        for j in np.flatnonzero((group == group[i]) & (doc < doc[i])).tolist():
            found = whole(kinds[i], kinds[j], None, None)
            held = np.isin(kinds[i], kinds[j]) & still
            if any(held[s : e - passages.WIDTH + 1].any() for s, e, _, _ in found):
                plain.append((int(doc[i]), i, int(doc[j]), j))
                for s, e, _, _ in found:
                    still[s : e - passages.WIDTH + 1] = False
    monkeypatch.setattr(passages, "shared_passages", lambda *a: calls.append(1) or whole(*a))
    found = passages.similar_in(group, seeks, np.ones(len(rows), bool), doc, span, least, kinds, [f if s else None for f, s in zip(free, seeks, strict=True)])
    assert plain and sorted(found) == sorted(plain)
    assert len(calls) <= 3 * int(seeks.sum())
