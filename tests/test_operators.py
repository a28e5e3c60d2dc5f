import pytest
from pyspark.sql import functions as F

from inkmill.operators import assemble, chunks, clean, glossary, mask, qa, segment, units
from inkmill.plans import pipeline
from inkmill.sources import html, ingest


def one(spark, sql, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(F.expr(sql)).first()[0]


def test_dehyphenate(spark):
    assert one(spark, clean.dehyphenate("t"), t="a-\nb-\nc  \né-\nè") == "ab-\nc\néè"


def test_headers(spark):
    docs = spark.createDataFrame([(1, "H\nfoo.\nH\nbar.\nbar.\nbar.\nH "), (2, "# H\n# H\n# H"), (3, None)], "doc_id int, md string")
    got = {r.doc_id: r.md for r in clean.strip_repeating_headers(docs).collect()}
    assert got == {1: "foo.\nbar.\nbar.\nbar.", 2: "# H\n# H\n# H", 3: None}


def test_typography(spark):
    text = "使用A,效果好.\n```\n好,好\n```\n| 好,好 |\n中文,好! x\n\n\n\ne"
    assert one(spark, clean.full_width_punctuation("t"), t=text) == "使用A,效果好。\n```\n好,好\n```\n| 好,好 |\n中文，好！ x\n\n\n\ne"
    assert one(spark, clean.space_cjk_alnum("t"), t=text).startswith("使用 A,效果好.\n")
    assert one(spark, clean.compact_blank_lines("t"), t="a\n\n\n\nb") == "a\n\nb"


@pytest.mark.parametrize("lengths, packed", [([5990, 9990], [15982]), ([9999, 1], [9999, 1]), ([10000, 5], [10000, 5]), ([5997, 4001], [10000]), ([5998, 4001], [5998, 4001]), ([], [])])
def test_pack(spark, lengths, packed):
    row = spark.createDataFrame([(["x" * n for n in lengths],)], "p array<string>")
    assert row.select(F.expr(f"transform({segment.pack('p')}, x -> length(x))")).first()[0] == packed


def test_mask_and_restore():
    md = "```py\n$x$\n```\n\n$$a$$ $b$\n\n| a |\n|---|\n| 1 |\n\nnext ![$c$](i.png)"
    masked, blocks = mask.mask_text(md)
    assert masked == "⟦CODE_0001⟧\n\n⟦FORMULA_0001⟧ ⟦INLINE_FORMULA_0001⟧\n\n⟦TABLE_0001⟧next ⟦IMAGE_0001⟧"
    raws = {b["placeholder"]: b["raw"] for b in blocks}
    assert "⟦INLINE_FORMULA_0002⟧" in mask.restore_text(masked, raws)  # what a restored block holds isn't restored
    assert mask.restore_text("⟦CODE_00001⟧", raws) == "⟦CODE_00001⟧"
    assert mask.mask_text("```c++\nx\n```")[0] == "```c++\nx\n```"
    assert mask.count_text("$$x$$")[3] == 2
    assert mask.count_text("[1], [2, 3] (Smith et al., 2023)")[4] == 3


def test_segments_cutoff(spark):
    md = "pre\n# A\n\nx\n\ny\n### deep\n## B\nz\n### References\n[1]\n\n[2]\n## C\nq"
    docs = spark.createDataFrame([(1, md), (2, "## 6 References\nr"), (3, "")], "doc_id int, md string")
    rows = segment.segments(docs, "md").select("doc_id", F.explode_outer("segments").alias("g")).filter("g is not null").select("doc_id", "g.*").collect()
    got = [(r.doc_id, r.id, r.section_heading, r.is_reference, r.char_len) for r in rows]
    assert got == [(1, "seg_0001", "", False, 3), (1, "seg_0002", "A", False, 18), (1, "seg_0003", "B", False, 6), (1, "seg_0004", "References", True, 21), (1, "seg_0005", "C", True, 6), (2, "seg_0001", "6 References", False, 17)]


def test_units_and_waves(spark):
    md = "# A\n\nx\n\n# B\n\ny\n\n# A\n\nz\n\n# References\n\nr"
    docs = units.assign_waves(units.build_units(segment.segments(spark.createDataFrame([(1, md)], "doc_id int, md string"), "md"), "hybrid"))
    rows = units.explode_units(docs).orderBy("unit_idx").collect()
    assert [(r.id, r.wave) for r in rows] == [("sec_0001", 0), ("sec_0002", 0), ("sec_0003", 1), ("sec_0004", -1)]
    plan = units.wave_plan(docs).first()
    assert (plan.total_units, plan.num_waves, plan.max_parallel) == (3, 2, 2)
    assert all(r.previous_id is None for r in units.windows(docs).collect())  # same headings aren't neighbours


def test_collect_and_audit(spark):
    md = "# A\n\nText [1].\n\n![f](assets/f.png)\n\n# References\n\nr"
    prepared = pipeline.prepare(spark.createDataFrame([(1, md)], "doc_id long, md string"))
    zh = units.explode_units(prepared).selectExpr("doc_id", "id as unit_id", "replace(text, 'Text', '正文') as zh")
    final, report = pipeline.finalize(prepared, zh)
    assert final.first().final == "# A\n\n正文 [1].\n\n![f](assets/f.png)\n"
    assert report.first().passed
    refs_only = pipeline.prepare(spark.createDataFrame([(7, "# References\n\nr")], "doc_id long, md string"))
    final, report = pipeline.finalize(refs_only, zh)
    assert [(r.doc_id, r.final) for r in final.collect()] == [(7, "\n")] and report.first().excluded_segments == 1
    final, report = pipeline.finalize(prepared, zh.limit(0))
    assert final.first().final.startswith("[!MISSING TRANSLATION: sec_0001]")


def audited(spark, md, change, **options):
    prepared = pipeline.prepare(spark.createDataFrame([(1, md, "p")], "doc_id long, md string, stem string"))
    rows = [(r.doc_id, r.id, change(r.text)) for r in units.explode_units(prepared).filter("not is_reference").collect()]
    return pipeline.finalize(prepared, spark.createDataFrame(rows, "doc_id long, unit_id string, zh string"), **options)[1].first()


@pytest.mark.parametrize("check, md, change", [
    ("B1", "a\n\nb\n\nc", lambda t: "a b c d e"),
    ("B2", "x ![f](assets/f.png)", lambda t: t.replace("⟦IMAGE_0001⟧", "")),
    ("B4", "text $x$ more", lambda t: t.replace("⟦INLINE_FORMULA_0001⟧", "")),
    ("B5", "text\n\n```\ncode\n```", lambda t: t.replace("⟦CODE_0001⟧", "code")),
    ("B3", "text\n\n| a |\n|---|\n| 1 |\n", lambda t: t.replace("⟦TABLE_0001⟧", "tab")),
    ("B6", "see [1], then [2] and [3]", lambda t: t.replace("[2]", "二").replace("[3]", "三")),
    ("B7", "a" * 100, lambda t: "短"),
    ("B8", "plain text of some length", lambda t: t + " 综上所述"),
    ("B9", "x $y$ z", lambda t: t.replace("⟦INLINE_FORMULA_0001⟧", "⟦INLINE_FORMULA_0009⟧")),
    ("B10", "body text here\n\n# References\n\nDoe 2020", lambda t: t + "\n\n# References\n\nDoe 2020"),
])
def test_each_check_fires(spark, check, md, change):
    report = audited(spark, md, change)
    assert check in [b.id for b in report.blockers] and not report.passed
    kept = audited(spark, md, lambda t: t)
    assert kept.passed and check not in [b.id for b in kept.blockers]
    assert check not in [b.id for b in audited(spark, md, change, config=pipeline.PipelineConfig(skip_checks=(check,))).blockers]


def test_missing_images_and_stems(spark):
    have = spark.createDataFrame([(1, "assets/f.png")], "doc_id long, path string")
    md = "x ![f](p.assets/f.png) ![g](assets/g.png)"
    report = audited(spark, md, lambda t: t, assets=have)
    assert [(b.id, b.evidence) for b in report.blockers] == [("B11", ["assets/g.png"])]  # the mirrored image is the same one
    assert pipeline.gate(spark.createDataFrame([(1, False)], "doc_id long, passed boolean"), pipeline.PipelineConfig(force=True)).first().released


def test_report_and_fix_tasks(spark):
    prepared = pipeline.prepare(spark.createDataFrame([(1, "# A\n\n" + "word " * 60 + "\n\n# B\n\nplain english words here")], "doc_id long, md string"))
    zh = spark.createDataFrame([(1, "sec_0001", "短"), (1, "sec_0002", "plain english words here # B")], "doc_id long, unit_id string, zh string")
    _, report = pipeline.finalize(prepared, zh)
    tasks = {(r.blocker, r.target): r.prompt for r in qa.fix_prompts(report).collect()}
    assert ("B7", "sec_0001") in tasks and "zh_per_segment/sec_0001.zh.md" in tasks["B7", "sec_0001"] and "| B7 |" in tasks["INDEX", ""]
    text = qa.render_report(report).first().report
    assert "| citation | 0 | 0 |" in text and "### W4" in text and "| sec_0001 | 305 | 1 | 0.0 | BAD |" in text and "**阻断**" in text


def test_paged_source(spark):
    pages = spark.createDataFrame([(d, n, f"page {n} of {d}") for d, m in ((1, 3), (2, 10)) for n in range(1, m + 1)] + [(2, 11, "References")], "doc_id long, page_no int, text string")

    def convert(row):
        if row["start_page"] == 5:
            raise RuntimeError("broken")
        return "\n\n".join(row["texts"])

    config = pipeline.PipelineConfig(pdf_chunk_pages=4)
    md, states = pipeline.paged_source(pages, convert, lambda row: "light", config)
    got = {r.doc_id: r.md for r in md.collect()}
    assert got[1].startswith("<!-- PDF_CHUNK chunk_001_p001-p003 pages=1-3 -->\n\npage 1 of 1") and "light" in got[2] and "page 10 of 2" in got[2] and "References" not in got[2]
    assert sorted((r.doc_id, r.chunk_id, r.engine) for r in states.collect())[2] == (2, "chunk_002_p005-p008", "pymupdf")
    status = spark.createDataFrame([(2, "chunk_001_p001-p004", "marker", 9), (2, "chunk_002_p005-p008", "pymupdf", 9)], "doc_id long, chunk_id string, engine string, source_md_size long")
    done = spark.createDataFrame([(2, "chunk_001_p001-p004", "kept"), (2, "chunk_002_p005-p008", "old")], "doc_id long, chunk_id string, md string")
    for again, want in ((False, "old"), (True, "light")):
        md, states = pipeline.paged_source(pages, convert, lambda row: "light", pipeline.PipelineConfig(retry_fallback=again), status, done)
        text = next(r.md for r in md.collect() if r.doc_id == 2)
        assert "kept" in text and want in text and states.filter("doc_id = 2").count() == 1 + again


def test_ratio_bounds(spark):
    unit_rows = spark.createDataFrame([(1, 0, "a", 10, False), (1, 1, "b", 10, False), (1, 2, "c", 10, False)], "doc_id int, unit_idx int, id string, char_len int, is_reference boolean")
    zh = spark.createDataFrame([(1, "a", "x" * 3), (1, "b", "x" * 25), (1, "c", "x" * 26)], "doc_id int, unit_id string, zh string")
    assert {r.id: r.status for r in qa.unit_ratios(unit_rows, zh).collect()} == {"a": "OK", "b": "OK", "c": "BAD"}


def test_translate_waves(spark, tmp_path):
    prepared = pipeline.prepare(spark.createDataFrame([(1, "# A\n\nx\n\n# B\n\ny\n\n# A\n\nz")], "doc_id long, md string"))
    terms = spark.createDataFrame([("x", "叉", 0)], "term string, translation string, pos int")
    done = pipeline.translate(prepared, terms, lambda prompt: "译" + str(len(prompt) > 0), str(tmp_path / "zh"))
    assert done.count() == 3
    assert pipeline.translate(prepared, terms, lambda prompt: 1 / 0, str(tmp_path / "zh")).count() == 3  # nothing is left to do


def test_glossary(spark, tmp_path):
    rows = spark.createDataFrame([("An Attention-based étoken 使用attention机制", ), (None,)], "text string")
    terms = spark.createDataFrame([("attention", "注意力", 0), ("token", "词元", 1)], "term string, translation string, pos int")
    assert [r.glossary for r in glossary.matches(rows, terms, "text").collect()] == [["attention -> 注意力"], []]
    own = spark.createDataFrame([("token", "标记", 0), ("Attention", "关注", 1), ("_note", "x", 2)], "term string, translation string, pos int")
    both = glossary.merge(glossary.builtin(spark), own).orderBy("pos").collect()
    assert len(both) == len(glossary.BUILTIN) + 1 and both[-1].term == "Attention" and {r.term: r.translation for r in both}["token"] == "标记"
    path = tmp_path / "terms.json"
    path.write_text('{"_meta": "m", "a b": "甲", "c": "丙"}')
    assert [(r.term, r.translation) for r in glossary.read_json(spark, str(path)).orderBy("pos").collect()] == [("a b", "甲"), ("c", "丙")]


def test_glossary_against_patterns():
    import random
    import re

    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("ab-c µ_.") for _ in range(rng.randint(1, 5))).strip() for _ in range(60)} - {""})
    find = glossary.TermFinder([(t, t) for t in terms])
    for _ in range(500):
        text = "".join(rng.choice("ab-c µ_.中") for _ in range(40))
        assert find(text) == [t for t in terms if re.search(rf"\b{re.escape(t)}\b", text)]


def test_images(spark):
    def normal(md, stem="x"):
        return one(spark, assemble.normalize_images("t", "s"), t=md, s=stem)

    assert normal('![a](./x.assets/i.png "t") ![b](http://h/i.png)') == '![a](assets/i.png "t") ![b](http://h/i.png)'
    assert normal("![a]( <././a b.png> t ) z") == "![a](<a b.png> t) z"
    assert normal("![](x.assets) ![](x.assetsy/i) ![](a\\b.png) ![](/abs/./i) ![](#f)") == "![](assets) ![](x.assetsy/i) ![](a/b.png) ![](/abs/./i) ![](#f)"
    assert normal("![a](y.assets/i.png)") == "![a](y.assets/i.png)" and normal("![a](x.assets/i.png)", None) == "![a](x.assets/i.png)"
    assert normal("no image") == "no image" and normal(None) is None
    docs = spark.createDataFrame([(1, "![](./assets/a%20b.png) ![](x.assets/c+d.png) ![](https://h/e.png)", "x"), (2, None, None)], "doc_id int, final string, stem string")
    have = spark.createDataFrame([(1, "assets/a b.png")], "doc_id int, path string")
    assert [(r.doc_id, r.path, r.n) for r in assemble.missing_images(docs, have, stem="stem").collect()] == [(1, "assets/c+d.png", 1)]


def test_line_ends_and_words(spark):
    """Only a line feed ends a line; word characters are Python's."""
    md = "# A\nx\u2028# B\ny\r# C\u0085## D\nfoo\u2028### References\nz"
    docs = spark.createDataFrame([(1, md)], "doc_id int, md string")
    rows = segment.segments(docs, "md").select(F.explode("segments").alias("g")).select("g.*").collect()
    assert [(r.section_heading, r.text, r.is_reference) for r in rows] == [("A", md, False)]
    assert one(spark, clean.dehyphenate("t"), t="x²-\ny é-\nà _-\n_ ½-\na \u0301-\nb") == "x²y éà __ ½a \u0301-\nb"
    for tail in ("\r", "\u2028", "\u0085", ""):
        text = f"好,{tail}\n好.{tail}"
        want = "好，\n好。" if not tail else f"好,{tail}\n好。{tail}"
        assert one(spark, clean.full_width_punctuation("t"), t=text) == want
    pages = spark.createDataFrame([(1, n, f"x\u2028references\u2028y" if n == 2 else "x\nReferences \ny" if n == 3 else "z") for n in range(1, 5)], "doc_id int, page_no int, text string")
    assert chunks.body_end(pages).first().body_end == 2


def brute_windows(rows):
    out = []
    for i, u in enumerate(rows):
        same = lambda v: v["h"] == u["h"] and not v["ref"]
        pieces, used = [], 0
        for v in rows[i + 1 :]:
            if not same(v) or used >= 3200:
                break
            pieces.append(v["t"][: 3200 - used])
            used += len(pieces[-1])
        before = rows[i - 1] if i and same(rows[i - 1]) else None
        out.append((before["id"] if before else None, before["t"][-3200:] if before else "", "" if u["ref"] else "\n\n".join(pieces).strip(), -1 if u["ref"] else sum(same(v) for v in rows[:i])))
    return out


def test_windows_and_waves_against_brute_force(spark):
    import random

    rng = random.Random(4)
    docs = []
    for d in range(12):
        n = rng.choice([0, 1, 3, 40])
        from_ref = rng.randrange(n + 5)
        docs.append((d, [{"id": f"u{k}", "h": rng.choice("AAB"), "ref": k >= from_ref, "t": rng.choice(["x", "yz " * 100, "word " * 700, " s " * 50, "q" * 3200])} for k in range(n)]))
    table = spark.createDataFrame([(d, [(u["id"], u["h"], 1, u["t"], u["ref"], len(u["t"])) for u in us]) for d, us in docs], "doc_id int, segments array<struct<id:string,section_heading:string,section_level:int,text:string,is_reference:boolean,char_len:int>>")
    rows = units.windows(units.assign_waves(units.build_units(table))).orderBy("doc_id", "unit_idx").collect()
    want = [x for _, us in docs for x in brute_windows(us)]
    assert [(r.previous_id, r.previous_source, r.next_source, r.wave) for r in rows] == want


def test_hybrid_units_against_brute_force(spark):
    import random

    rng = random.Random(6)
    segs = [("ABC"[k // 9 % 3], 1 + k // 15 % 2, "x" * rng.choice([1, 3000, 5998, 11998, 13000])) for k in range(40)]
    table = spark.createDataFrame([(1, [(f"s{k}", h, lv, t, False, len(t)) for k, (h, lv, t) in enumerate(segs)])], "doc_id int, segments array<struct<id:string,section_heading:string,section_level:int,text:string,is_reference:boolean,char_len:int>>")
    want, section, last = [], 0, None
    for k, (h, lv, t) in enumerate(segs):
        if (h, lv) != last:
            section, part, used, last = section + 1, 1, 0, (h, lv)
            want.append((f"sec_{section:04d}", []))
        elif used + len(t) + 2 > 12000:
            part, used = part + 1, 0
            want.append((f"sec_{section:04d}_part_{part:03d}", []))
        want[-1][1].append(f"s{k}")
        used += len(t) + 2
    got = units.explode_units(units.assign_waves(units.build_units(table, "hybrid"))).orderBy("unit_idx").collect()
    assert [(r.id, r.segment_ids) for r in got] == want


def test_chunks(spark):
    docs = spark.createDataFrame([(1, 9)], "doc_id long, total_pages int")
    plan = chunks.plan(docs, 4)
    assert [r.chunk_id for r in plan.orderBy("start_page").collect()] == ["chunk_001_p001-p004", "chunk_002_p005-p008", "chunk_003_p009-p009"]
    assert chunks.valid_plans(plan, docs).first().valid and not chunks.valid_plans(plan.filter("start_page > 1"), docs).first().valid

    def convert(row):
        if row["start_page"] == 5:
            raise RuntimeError("broken")
        return "md"

    got = chunks.execute(plan, convert, lambda row: "light").orderBy("chunk_id").collect()
    assert [r.engine for r in got] == ["marker", "pymupdf", "marker"]


def test_html_and_urls(spark):
    page = "<body><nav>n</nav><article><h1>T</h1><p>a <b>b</b><br>c<ul><li>x<li>y</ul><script>s</script></article>after</body>"
    assert html.to_markdown(page).startswith("# T\n\na **b**\nc")
    assert "after" not in html.to_markdown(page) and "- y" in html.to_markdown(page)
    urls = spark.createDataFrame([("https://arxiv.org/abs/2401.12345v2",), ("http://h/a.PDF",), ("nothing",), (None,)], "url string")
    assert [r.kind for r in ingest.classify_urls(urls).collect()][:3] == ["arxiv", "pdf", None]
    assert one(spark, ingest.url_stem("t"), t="https://a.b/c/d.tar.gz?x") == "d.tar"


@pytest.mark.parametrize("page, md", [
    ("<pre><code>def f():\n    return 1\n\n\n\tx</code></pre>", "```\ndef f():\n    return 1\n\n\n\tx\n```\n"),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "- a\n\n  - b\n\n- c\n"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b\n"),
    ("<table><tr><th>h</th><th>i</th></tr><tr><td><p>x</p>y</td><td>2</td></tr></table>", "| h | i |\n| --- | --- |\n| x y | 2 |\n"),
    ("<blockquote><p>q</p><p>r</p></blockquote>z", "> q\n>\n> r\n\nz\n"),
    ("<p>a * b_c <code>d_e</code></p>", "a \\\\* b\\\\_c `d_e`\n"),
    ("<main><h2>T</h2>m</main><article>a</article>", "a\n"),
    ("<header>n</header><p>x<noscript>y</noscript> z</p>", "x z\n"),
    ("", "\n"), (None, None),
])
def test_html(page, md):
    got = html.to_markdown(page)
    assert got == (md.replace("\\\\", "\\") if md else md)


def test_inbox(spark, tmp_path):
    from inkmill.streaming import inbox

    def send(name, rows):
        spark.createDataFrame(rows, "doc_id long, unit_id string, zh string, at string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        inbox.follow(inbox.read_inbox(spark, f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/{name}").awaitTermination()
        return {(r.doc_id, r.unit_id): r.zh for r in inbox.current(spark, f"{tmp_path}/store").collect()}

    assert send("one", [(1, "a", "旧", "2024-01-01T00:00:00"), (1, "a", "新", "2024-01-02T00:00:00"), (1, "b", "乙", "2024-01-01T00:00:00")]) == {(1, "a"): "新", (1, "b"): "乙"}
    assert send("one", [(1, "b", "丙", "2024-01-03T00:00:00")]) == {(1, "a"): "新", (1, "b"): "丙"}
    assert send("two", [(2, "a", "丁", "2024-01-01T00:00:00")]) == {(1, "a"): "新", (1, "b"): "丙", (2, "a"): "丁"}  # a new checkpoint loses nothing


def test_sources_and_artifacts(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# A\r\n\r\nx\ry".encode())
    got = ingest.read_markdown(spark, str(tmp_path / "a.md")).selectExpr("1L as doc_id", "md")
    assert got.first().md == "# A\n\nx\ny"
    assert ingest.read_binary(spark, str(tmp_path / "a.md")).first().kind == "markdown"
    prepared = pipeline.prepare(got)
    zh = units.explode_units(prepared).selectExpr("doc_id", "id as unit_id", "text as zh").limit(0)
    folder = str(tmp_path / "out")
    pipeline.write_artifacts(prepared, pipeline.make_prompts(prepared, None, zh), units.index_rows(units.explode_units(prepared), zh), folder)
    assert spark.read.json(f"{folder}/units").first().id == "sec_0001" and spark.read.json(f"{folder}/index").first().status == "pending"
    assert "⟦CODE_0001⟧" in spark.read.parquet(f"{folder}/prompts").first().prompt
    only_segments = pipeline.prepare(got).drop("units")  # segments serve as units where there are none
    assert [r.id for r in units.explode_units(assemble.units_of(only_segments)).collect()] == ["seg_0001"]


def test_progress_lines_and_boxes(spark):
    planned = chunks.plan(spark.createDataFrame([(1, 28)], "doc_id long, total_pages int"), 4)
    status = planned.selectExpr("doc_id", "chunk_id", "'running' as state", "cast(null as string) as engine", "cast(null as string) as error", "0L as source_md_size")
    rows, totals = chunks.progress(planned, status)
    line = chunks.summarize(totals, rows).first().summary
    assert line.startswith("total=7 completed=0 running=7 pending=0 failed=0 active=chunk_001_p001-p004:-") and line.endswith("active_more=2")
    boxes = spark.createDataFrame([(1, 2, 1, [0.0, 0.0, 29.0, 50.0]), (1, 2, 2, [0.0, 0.0, 30.0, 15.0]), (1, 2, 3, [0.0, 0.0, 90.0, 14.0])], "doc_id long, page int, k int, bbox array<double>")
    assert [(r.page, r.idx, r.rel_path) for r in chunks.table_boxes(boxes, 3).collect()] == [(5, 1, "assets/tables/table_p005_01.png")]
    assert chunks.pages_with_text(spark.createDataFrame([("x",), (" \n",)], "text string")).count() == 1
