from pyspark.sql import functions as F

from revtrace.functions import keys, text
from revtrace.operators import documents as docs
from revtrace.sources import scans

UNITS = [("p", "published", 0, "abstract", "Abstract", "We saw 88 travellers in the first wave."),
         ("p", "published", 1, "section", "Methods", "The incubation days<sup>13</sup> were fitted. It ends with these words"),
         ("p", "published", 2, "section", "Results", "and goes on with those. Mean 6.4 days."), ("p", "published", 3, "table", "T1", "a | 6.4")]


def units(spark):
    return spark.createDataFrame(UNITS, "paper_id string, doc_id string, unit_no int, kind string, title string, text string")


def test_quotes(spark):
    rows = [("published", "we saw 88 TRAVELLERS in the first"), ("published", "The incubation days13 were"), ("published", "an invented sentence of no paper"),
            ("published", "too short"), ("preprint_v1", "we saw 88 travellers in the first"), ("published", "these words Results and goes on")]
    q = spark.createDataFrame([("p", d, s) for d, s in rows], "paper_id string, doc_id string, quote string")
    u = units(spark).withColumn("text", text.plain(F.col("text")))
    got = {r.quote: (r.verified, r.section, r.offset) for r in docs.verify_quotes(q, u).filter("doc_id = 'published'").collect()}
    assert got["we saw 88 TRAVELLERS in the first"] == (True, "Abstract", 0)
    assert got["The incubation days13 were"] == (True, None, None)  # only without spaces: verified, no place
    assert got["these words Results and goes on"] == (True, None, None)  # over a heading
    assert got["an invented sentence of no paper"][0] is False and got["too short"][0] is False
    assert docs.verify_quotes(q, u).filter("doc_id = 'preprint_v1'").first().verified is False


def test_provenance_and_summary(spark):
    ev = F.array(F.struct(F.lit("published").alias("doc_id"), F.lit("X").alias("section"), F.lit("We saw 88 travellers in the").alias("quote")),
                 F.struct(F.lit("published").alias("doc_id"), F.lit("X").alias("section"), F.lit("a quote that was made up").alias("quote")))
    d = spark.createDataFrame([("e", "p", 0, "10.1101/a", "10.1/b")], "event_id string, paper_id string, claim_diff_idx int, preprint_doi string, published_doi string").withColumn("evidence", ev)
    p = docs.build_provenance(d, units(spark))
    assert [(r.verified, r.section, r.doi, r.version) for r in p.orderBy("evidence_idx").collect()] == [(True, "Abstract", "10.1/b", "published"), (False, "X", "10.1/b", "published")]
    e = spark.createDataFrame([("e",), ("none",)], "event_id string")
    assert {r.event_id: r.status for r in docs.verification_summary(e, p).collect()} == {"e": "partial", "none": "unsupported"}


def test_contains_pairs_equals_full_comparison(spark):
    import random
    rnd = random.Random(3)
    hays = ["".join(rnd.choice("abcy01") for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    needles = {h[i:i + n] for h in hays for i, n in ((5, 20), (0, 9), (3, 4), (2, 1), (7, 40)) if h[i:i + n]} | {"zzzzzzzzzzzzzzzzzz", "y"}
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    t = spark.createDataFrame(list(enumerate(hays)), "text_id int, hay string")
    for chars in (0, 1 << 20):  # by grams, by an automaton
        got = {(r.needle, r.text_id) for r in docs.contains_pairs(n, t, chars).collect()}
        assert got == {(x, i) for x in needles for i, h in enumerate(hays) if x in h}
    assert docs.contains_pairs(n.limit(0), t).count() == 0


def test_chunks_of_a_long_document(spark):
    """Linear in the units: 60,000 of them in one document, packed as a plain loop packs them."""
    sizes = [(i * 37) % 90 for i in range(60_000)]
    u = spark.createDataFrame([("p", "d", i, "section", "T", "x" * n) for i, n in enumerate(sizes)], "paper_id string, doc_id string, unit_no int, kind string, title string, text string")
    want, filled, n = [0], 0, 0
    for s in sizes:
        s += len("## T\n")
        if n and filled + s > 500:
            want.append(0)
            filled, n = 0, 0
        filled, n = filled + s, n + 1
        want[-1] += 1
    assert [r.n_units for r in docs.chunk_units(u, 500).orderBy("chunk").collect()] == want


def test_search_and_sections(spark):
    asks = spark.createDataFrame([("q1", "p", "published", "6.4 mean"), ("q2", "p", "published", "absent")], "query_id string, paper_id string, doc_id string, query string")
    got = {r.query_id: r for r in docs.search_text(units(spark), asks).collect()}
    assert got["q1"].total_hits == 3 and [s.section for s in got["q1"].snippets] == ["Results", "Results", "Table: T1"] and got["q2"].total_hits == 0
    req = spark.createDataFrame([("a", "p", "published", "results"), ("b", "p", "published", "method"), ("c", "p", "published", "zz")], "request_id string, paper_id string, doc_id string, title string")
    r = {x.request_id: x for x in docs.read_section(units(spark), req).collect()}
    assert (r["a"].section, r["b"].section, r["c"].section, r["c"].available) == ("Results", "Methods", None, ["Methods", "Results"])


def test_articles(spark, tmp_path):
    xml = ("<article xmlns='x'><front><article-title>A <i>b</i></article-title><abstract><title>Background</title><p>Since 2019.</p></abstract></front><body><p>Loose.</p>"
           "<sec><title>M</title><p>own</p><sec><title>S</title><p>deep</p></sec><table-wrap><label>Table 1</label><caption>Cap</caption><table><tr><td>a</td><td>1</td></tr></table></table-wrap></sec></body></article>")
    d = tmp_path / "paper1"
    d.mkdir()
    (d / "preprint_v1.xml").write_text(xml)
    (d / "published_PMC1.xml").write_text("<broken")
    dd, u, errors = scans.read_jats(spark, str(d / "*.xml"))
    assert [(r.kind, r.title, r.text) for r in u.orderBy("unit_no").collect()] == [
        ("abstract", "Abstract", "Background Since 2019."), ("section", "Body", "Loose."), ("section", "M", "own"), ("section", "M > S", "deep"), ("table", "Table 1", "Cap\na | 1")]
    assert [(r.paper_id, r.doc_id, r.title) for r in dd.collect()] == [("paper1", "preprint_v1", "A b")]
    assert [(r.paper_id, r.doc_id, bool(r.error)) for r in errors.collect()] == [("paper1", "published", True)]


def test_markup(spark):
    d = spark.createDataFrame([("R<sub>0</sub> &lt; 5 &#945;&nbsp;x ",), (None,), ("<p> </p>",)], "t string")
    r = d.select(text.clean_text(F.col("t")).alias("c"), text.plain(F.col("t")).alias("p")).collect()
    assert r[0].c == "R0 < 5 α x" and r[0].p == "R 0 < 5 α x " and r[1].c is None and r[2].c is None


def test_keys(spark):
    d = spark.createDataFrame([("  HTTPS://doi.org/10.1/AB ", "2", "2020-1-5"), ("doi:10.1/x", "v3", "2020-01-05T01:00"), (" ", "published", "May 2020")], "d string, v string, t string")
    r = d.select(keys.normalize_doi(F.col("d")), keys.normalize_version(F.col("v")), keys.parse_date(F.col("t"))).collect()
    assert [tuple(x) for x in r] == [("10.1/ab", "v2", "2020-01-05T00:00:00Z"), ("10.1/x", "v3", "2020-01-05T01:00"), (None, "published", "May 2020")]
    import uuid
    got = d.limit(1).select(keys.event_id(F.lit("10.1/A"), F.lit("10.2/B"), "p:")).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "p:10.1/a:10.2/b"))


def test_copy_keeps_other_rows_of_the_target(spark, tmp_path):
    from revtrace.sources import tables
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "old"), (9, "stays")], "k int, v string").write.parquet(dst + "/t")
    spark.createDataFrame([(1, "new"), (2, "two")], "k int, v string").write.parquet(src + "/t")
    for _ in range(2):
        r = tables.copy_tables(spark, src, dst, ["t"], {"t": ["k"]}).first()
        assert (r.source_rows, r.target_rows) == (2, 3)
    assert sorted(tuple(x) for x in spark.read.parquet(dst + "/t").collect()) == [(1, "new"), (2, "two"), (9, "stays")]
