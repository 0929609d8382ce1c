"""Nulls, empty tables, clashing columns and html cases; each operator gives its documented result."""

from claimforge.llm import chat, fm_index, html, jaccard_join, language, mixing, passages, quality, tokens, toxicity


def test_empty_tables(spark, empty, labels):
    none = labels.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.score(empty, toxicity.fit_toxicity(empty, none)).count() == 0
    assert tokens.token_counts(empty).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert passages.repeated_passages(empty).count() == 0
    assert passages.cut(empty, passages.repeated_passages(empty)).count() == 0
    assert language.identify(empty, language.fit_language(empty)).count() == 0
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert fm_index.digests(fm_index.decontaminate(empty, bench)).count() == 0
    assert quality.judge(empty, quality.fit_quality(empty, none)).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_without_labels_or_items(spark, docs, labels, corpus):
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0}
    rows = quality.judge(docs, quality.fit_quality(docs, none)).collect()
    assert all(r.kept != r.base_failed for r in rows)
    bench = spark.createDataFrame([], "item_id long, text string")
    found = fm_index.digests(fm_index.decontaminate(docs, bench))
    assert found.filter("contaminated").count() == 0 and found.count() == len(corpus)


def page(spark, *rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, token string, template string")


def test_furniture_is_left_out(spark):
    body = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use</div><div id="main-content"><h1>Head &amp; tail</h1><p>One   <b>two</b><br>three<p>Four<script>x="</p>"</script>
    <form>Name</form><div class="ad-slot">Buy</div><ul><li>a<li>b</ul></div><section id="comments"><p>Me too</p></section><aside>Rel</aside><footer>F</footer></body></html>"""
    rows = html.main_text(page(spark, ("http://a.example/x", body), ("http://a.example/y", None), (None, ""), ("http://b.example/", "plain &lt;b&gt;"))).orderBy("page_id").collect()
    assert [r.text for r in rows] == ["Head & tail\nOne two three\nFour\na\nb", "", "", "plain <b>"]
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows]


def test_comments_and_teasers_in_article_elements():
    body = """<main><article><h1>T</h1><p>Body</p><div class="commentlist"><article class="comment"><p>me</p></article></div></article>
    <article class="related teaser"><p>More</p></article><div class="commentary"><p>Note</p></div></main>"""
    assert html.extract(body, frozenset(), None) == "T\nBody\nNote"
    assert html.extract("<article hidden><p>x</p></article><article><p>y</p></article>", frozenset(), None) == "y"


def test_fixed_blocks_of_a_host_are_template(spark):
    pages = [(f"https://h.example/{i}", f"<body><div><p>Read on our app</p><p>Story number {i} has words</p><p>And more of {i * i} here</p></div></body>") for i in range(6)]
    t = html.templates(page(spark, *pages)).collect()
    assert len(t) == 1 and t[0].template.pages == 6
    rows = html.main_text(page(spark, *pages)).collect()
    assert all("app" not in r.text and "Story" in r.text and "And more" in r.text for r in rows)


def test_pipeline_keeps_columns_and_clean_documents(spark, docs, labels, corpus, tmp_path):
    import corpus_pipeline as P

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clean = [r for r in corpus if r[1] and "vile" not in r[1] and r[1].count(" ") > 150]
    item = " ".join(clean[0][1].split()[20:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    x = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        y = stage(spark, x, str(tmp_path))
        assert y.columns == x.columns, name
        y.write.parquet(str(tmp_path / f"{name}.parquet"))
        x = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
    last = x.collect()
    assert not any("vile" in (r.text or "") for r in last if (r.text or "").count("vile") > 3)
    assert not any(item in (r.text or "") for r in last)
    assert all(r.n_chars == len(r.text) for r in last if r.text is not None)
    out = P.run(spark, str(tmp_path))
    assert {"doc_id", "size", "taken", "target"} <= set(out.columns) and out.count() == len(last)


def test_copies_are_one_page_and_long_notices_are_fixed(spark):
    article, notice = "One sentence of a story. " * 20, "All rights of this notice are kept. " * 20
    copies = [(f"https://c.example/{i}", f"<body><article><p>{article}</p><p>Short line</p></article></body>") for i in range(6)]
    unlike = [(f"https://n.example/{i}", f"<body><article><p>Story {i} {article}</p><p>{notice}</p></article></body>") for i in range(6)]
    text = {r.url: r.text for r in html.main_text(page(spark, *copies, *unlike)).collect()}
    assert all(text[u] == article.strip() + "\nShort line" for u, _ in copies)
    assert all(text[u] == f"Story {i} {article}".strip() for i, (u, _) in enumerate(unlike))


def test_names_of_classes_decide_only_while_text_is_left():
    for name in ("notice", "discussion", "entry side-story", "content"):
        assert html.extract(f'<body><nav>Menu</nav><div class="{name}"><h1>T</h1><p>The story is told here.</p></div></body>', frozenset(), None) == "T\nThe story is told here."
    body = '<article><p>One</p><div class="share-price"><p>Up two points</p></div><div class="share-buttons">Tweet</div><div class="ad-slot">Buy</div></article>'
    assert html.extract(body, frozenset(), None) == "One\nUp two points"


def test_templates_over_generated_hosts_with_odd_pages(spark):
    """Each host has an own layout, fixed lines, a story of its own on every page, and some pages of no layout."""
    rows, expect = [], {}
    for h in range(5):
        outer = ("div", "section", "article")[h % 3]
        for i in range(10):
            url = f"https://g{h}.example/{i}"
            story = [f"Story {h} {i} part {k} with words of its own number {i * 31 + k}" for k in range(3 + i % 3)]
            if i == 7:
                rows.append((url, f"<body><p>Moved to page {h}</p></body>"))
                expect[url] = f"Moved to page {h}"
                continue
            paragraphs = "".join(f"<p>{s}</p>" for s in story)
            rows.append((url, f'<body><header>Site {h}</header><div id="wrap{h}"><{outer} class="c{h}"><p>Read more on our app {h}</p>{paragraphs}<p>All rights kept {h}</p></{outer}></div><footer>F</footer></body>'))
            expect[url] = "\n".join(story)
    rows += rows[:3]  # repeated rows of a page
    pages = spark.createDataFrame([(i % 50, u, x) for i, (u, x) in enumerate(rows)], "page_id long, url string, html string")
    t = {r.host: r.template for r in html.templates(pages).collect()}
    assert len(t) == 5 and all(x.pages == 10 for x in t.values())
    for x in t.values():
        fixed = {tok for c in x.classes for tok in c.tokens if tok[0] != "<"}
        assert any("Read more" in f for f in fixed) and any("All rights" in f for f in fixed) and not any("Story" in f for f in fixed)
        regions = [c.region.count("/") for c in x.classes]
        assert regions == sorted(regions)
    assert {r.url: r.text for r in html.main_text(pages).collect()} == expect


def test_texts_of_unknown_words_are_not_toxic(spark, docs, labels):
    """Nothing is known of them, so the base rate decides, and the pipeline's stage keeps them."""
    import corpus_pipeline

    index = toxicity.fit_toxicity(docs, labels)
    planted = [(1, None), (2, ""), (3, "!!! ???"), (4, "Это обычное предложение"), (5, "\u3053\u308c\u306f\u666e\u901a\u306e\u6587"), (6, "hello unheard of")]
    rows = spark.createDataFrame(planted, "doc_id long, text string")
    got = toxicity.score(rows, index).collect()
    assert len(got) == 6 and all(r.predicted == 0 and 0 < r.score < 0.5 for r in got)
    assert corpus_pipeline.plain(lambda s, d, _: toxicity.score(d, index, keep=("text",)).filter("predicted = 0").select("doc_id", "text"))(spark, rows, "").count() == 6
