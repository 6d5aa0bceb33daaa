"""Operators on pages, language identification and the pipeline."""

import importlib

from pyspark.sql import functions as F

from codecat.llm import html_extract, language_id, url_filter


def test_urls_and_rules(sp):
    pages = sp.createDataFrame([
        (1, "http://A.Example.ORG/es/x?y", None), (2, "https://sub.example.org/en/123", ""), (3, "http://example.org", "<p>x"), (4, None, None),
        (5, "no scheme", "x"), (6, "http://a.com/fr/", "x"), (7, "x://b.com/de/1#f", "x"), (8, "http://myorg/", "x"), (8, "http://myorg/", "x")],
        "page_id long, url string, html string").withColumn("trust", F.lit("clash"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect() if r["page_id"] != 8)
    assert got == [(1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "sub.example.org", "/en/123", "example.org/en/1", "block"),
                   (3, "example.org", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
                   (6, "a.com", "/fr/", "com/fr/", "allow"), (7, "b.com", "/de/1", "com/de/", "block")]
    assert url_filter.judge(pages.where("false")).count() == 0


def test_trust_and_distrust_walk(sp):
    link = lambda h: f'<a class=x href="http://{h}/p">l</a>'
    pages = sp.createDataFrame([
        (1, "http://good.org/", link("near.net")), (2, "http://near.net/", link("far.net")), (3, "http://far.net/", ""),
        (4, "http://shady.net/", link("bad.com")), (5, "http://bad.com/de/", ""), (6, "http://alone.net/", link("alone.net"))],
        "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    d = url_filter.DAMPING
    assert abs(got[2]["trust"] - d) < 1e-9 and abs(got[3]["trust"] - d * d) < 1e-9 and abs(got[4]["distrust"] - d) < 1e-9
    assert [got[i]["verdict"] for i in range(1, 7)] == ["allow", "allow", "allow", "block", "block", "allow"]


def test_html(sp):
    page = ('<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar"><nav><a href=/>menu</a></nav>'
            '<!-- <p>no --><div class="ad-box"><p>buy</p></div><article><h1>Head &amp; tail</h1><p><b>one  two<br>three<p>four\n five</p></article>'
            '<div id="comments"><p>me too, a long comment that goes on and on</div><footer>f</footer></body></html>')
    want = "Head & tail\n\none two three\n\nfour five"
    rows = [(1, "http://h.net/1", page), (1, "http://h.net/1", page), (2, None, page), (3, "http://h.net/2", None), (4, "http://h.net/3", ""),
            (5, "http://i.net/", "plain &lt; text"), (6, "http://h.net/4", "<div class=x><p>other page</p></div>"), (None, "x", "<p>" * 3000 + "deep")]
    df = sp.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r["id"], r["text"]) for r in html_extract.main_text(df).collect()), key=str)
    assert got == sorted([(1, want), (1, want), (2, want), (3, ""), (4, ""), (5, "plain < text"), (6, "other page"), (None, "deep")], key=str)
    assert html_extract.main_text(df.where("false")).count() == 0


def test_consensus_overrules_a_page(sp):
    usual = '<div class="post-{0}"><p>a text of some length, that wins {0}</p></div><div class="other"><p>short</p></div>'
    odd = '<div class="post-9"><p>brief</p></div><div class="other"><p>a far longer passage in the wrong place, which wins on its own page</p></div>'
    df = sp.createDataFrame([(i, "http://h.net/", usual.format(i)) for i in range(5)] + [(9, "http://h.net/", odd), (10, "http://z.net/", odd)],
                            "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in html_extract.main_text(df).collect()}
    assert got[9] == "brief" and got[10].startswith("a far longer")


def test_language_id_held_out(sp):
    sf = "/root/testdata/sf0.001"
    docs = sp.read.parquet(f"{sf}/documents.parquet")
    odd = sp.createDataFrame([(-1, None), (-2, ""), (-3, "123 !?"), (-4, "the and of the tion"), (None, "de la que")], "doc_id long, text string")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.fit(docs, fold != 2)
    out = language_id.predict(docs.select("doc_id", "lang", "text").unionByName(odd, allowMissingColumns=True), model)
    rows = out.withColumn("held", fold == 2).collect()
    held = [r for r in rows if r["held"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (-1, -2, -3)) and by[-4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.fit(docs.where("false"), fold != 2) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}


def test_pipeline_stages(sp, tmp_path):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = sp.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(sp, docs, sf), "test")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.run(sp, sf)
    assert out.select("doc_id").distinct().count() <= before and set(columns) < set(out.columns)
    assert not out.where(F.col("text").rlike("@mail[0-9]")).count()
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
