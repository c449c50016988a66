from pyspark.sql import functions as F

from revtrace.functions import quantity as q


def arr(values):
    return F.lit(None).cast("array<string>") if values is None else F.array(*[F.lit(v) for v in values]).cast("array<string>")


def kept(spark, sentences, terms, prop, unit, proposed=None, contexts=None):
    rows = [(i, s, contexts[i] if contexts else None) for i, s in enumerate(sentences)]
    d = spark.createDataFrame(rows, "i int, s string, c string").withColumn("terms", arr(terms)).withColumn("pr", arr(proposed))
    d = d.withColumn("rules", q.match_rules(F.col("terms"), F.lit(unit).cast("string"), F.col("pr"))).withColumn(
        "w", q.old_quantities(F.col("terms"), F.col("pr"))).withColumn("p", q.property_pattern(arr(prop)))
    return sorted(r.i for r in d.filter(q.holds_quantity(F.col("s"), F.col("c"), F.col("rules"), F.col("w"), F.col("p"))).collect())


def test_term_patterns(spark):
    hit = {"4.2 days": ["lasted 4.2 days", "4·2 days", "4.20 days (x)", "a 4.2-day stay", "4.2 d", "4.2days"],
           "31.5%": ["(31.5 %) had", "31·5%", "31.50 per cent"], "0 to 9": ["0-9", "0–9 days", "between 0 and 9", "0 to 9.0", "0- to 9-day"],
           "12,400": ["about 12,400 cases"]}
    miss = {"4.2 days": ["14.2 days", "4.25 days", "4.2 weeks", "44.2 days"], "31.5%": ["131.5%"], "0 to 9": ["10-9 days", "0 to 95", "0 to 9.5 days", "9 days"]}
    rows = [(t, s, True) for t in hit for s in hit[t]] + [(t, s, False) for t in miss for s in miss[t]]
    d = spark.createDataFrame(rows, "t string, s string, want boolean").withColumn("got", F.regexp_like("s", q.term_pattern(F.col("t"))))
    assert d.filter("got <> want").collect() == []


def test_every_spelling_is_matched(spark):
    d = spark.createDataFrame([(t,) for t in ("4.2 days", "31.5%", "5.47", "0 to 9", "0 to 9.0 days", "12,400", "3.30 to 5.47")], "t string")
    s = d.select(F.explode(q.term_spellings(F.col("t"))).alias("s"), q.term_pattern(F.col("t")).alias("p"))
    assert s.count() > 60 and s.filter(~F.regexp_like("s", F.col("p"))).count() == 0


def test_posting_key_finds_what_the_pattern_finds(spark):
    texts = ["4.20 and 7", "x 0–9 y", "5,8 was", "1.2.3", "24.0", "a5", "5.", "5.47 to 6", "12·50", "3∙8", "no"]
    terms = ["4.2", "7", "0 to 9", "5", "24", "5.47", "12.5", "8", "3.8", "1.2"]
    d = spark.createDataFrame([(s, t) for s in texts for t in terms], "s string, t string")
    r = d.select("s", "t", F.regexp_like("s", q.value_pattern(F.col("t"))).alias("hit"),
                 F.array_contains(q.posting_numbers(F.col("s")), q.join_number(F.col("t"))).alias("key")).collect()
    assert [x for x in r if x.hit and not x.key] == [] and any(x.hit for x in r)


def test_old_value_terms(spark):
    rows = [("mean R ranges from 3.30 (95%CI: 2.73-3.96) to 5.47 (95%CI: 4.16-7.10)", "from 2.24 to 3.58", ["3.30 to 5.47"]),
            ("between 1.6–2.9 until January 2020", "from 2.35 to 1.05", ["1.6 to 2.9"]),
            ("median 3.0 days (range, 0 to 24.0 days).", "median 4 days (range, 2 to 7).", ["0 to 24.0 days", "3.0 days"]),
            ("mean 5.8 (4.6 - 7.9, 95% CI) days", "6.4 days (95% CrI 5.6-7.7)", ["5.8 days"]), ("2019-nCoV (OR 3.1717, 95% CI 1.3-7.7)", "", ["3.1717"]),
            ("75 patients (50.7%)", "55 patients (37.2%)", ["50.7%"]), ("value 2.5", "value 2.5 again", []), (None, "x", [])]
    d = spark.createDataFrame(rows, "a string, b string, want array<string>")
    assert [(r.got, r.want) for r in d.select(q.old_value_terms(F.col("a"), F.col("b")).alias("got"), "want").collect() if r.got != r.want] == []


def test_claim_values(spark):
    rows = [("50.7% of 148 patients; R of 5.47 (SARS-CoV-2, 2020)", ["148 patients", "5.47", "50.7%"]),
            ("2 to 14 days, p<0.001, Table 2, IL-6 and CD4 counts", ["14 days", "2 days"]), ("Figure 3 [7] in 2021", []), ("29,500 in all, 5·80 kg", ["29500", "5.8 kg"])]
    d = spark.createDataFrame(rows, "t string, want array<string>")
    assert [r for r in d.select(q.claim_values(F.col("t")).alias("got"), "want").collect() if r.got != r.want] == []


def test_verdicts(spark):
    a, b = "mean 5.8 days (4.6-7.9)", "mean 6.4 days (5.6-7.7)"
    rows = [("assumed 5.8 days [12]", a, b, "uses_old_value"), ("at 6.4 days", a, b, "uses_current_value"), ("5.8 days, later 6.4 days", a, b, "mentions_both"),
            ("about a week", a, b, "cannot_tell"), ("5·80 (95% CI 4.6-7.9)", a, b, "uses_old_value"), ("5.8% of them", a, b, "cannot_tell"),
            ("88 of them", "5.8 days; 88", "6.4 days; 88", "unchanged_value"), ("9 to 14 days", "for 9 days", "for 14 days", "mentions_both")]
    d = spark.createDataFrame(rows, "s string, a string, b string, want string")
    v = q.old_or_new(q.claim_values(F.col("s")), q.claim_values(F.col("a")), q.claim_values(F.col("b")))
    assert [r for r in d.select(v["verdict"].alias("got"), "want", "s").collect() if r.got != r.want] == []


def test_quantity_decisions(spark):
    s = ["median incubation period of 3.0 days (range, 0–24.0), short.", "CT scores (range, 0–24) were summed.", "measured over a 0–24 h period.",
         "The incubation period ranged widely.", "It spanned 0 to 24 days.", "Ages 0–24 years."]
    assert kept(spark, s, ["0 to 24"], ["incubation period"], "days") == [0, 4]
    assert kept(spark, s, ["0 to 24"], None, None) == [0, 1, 2, 4, 5]
    s = ["Incubation was 5.8 (x).", "The R was 5.8.", "a 5.8-day incubation", "5.8 h later", "incubation 5.1 days (95% CI 4.5-5.8)", "incubation 5.8–7.0 days"]
    assert kept(spark, s, ["5.8 days"], ["incubation"], "days") == [0, 2]
    assert kept(spark, s, ["5.8 days"], None, None) == [2]


def test_proposed_spellings_need_the_old_quantity(spark):
    new, old = ["24 days", "75 out of 148", "3.3"], ["0 to 24.0 days", "50.7%", "3.30 to 5.47"]
    s = ["incubation as long as 24 days.", "75 out of 148 had liver dysfunction.", "75 out of 148 agreed.", "The R 0 was 3.3.", "R0 between 3.3 and 5.47"]
    assert kept(spark, s, old + new, ["incubation", "liver dysfunction", "r0"], None, new) == [1, 4]
    assert kept(spark, ["half had liver dysfunction"], ["50.7%", "half"], ["liver dysfunction"], None, ["half"]) == []


def test_context_counts_for_the_property(spark):
    rows, head = ["Fan | 148 | 75 (50.7)"], ["Table 2 Abnormal liver function"]
    assert kept(spark, rows, ["50.7%"], ["abnormal liver function"], "%", contexts=head) == [0]
    assert kept(spark, rows, ["50.7%"], ["abnormal liver function"], "%") == []


def test_round_half_even_on_the_binary_value(spark):
    xs = [(2.675, 2), (0.35, 1), (6.25, 1), (50.67567567, 1), (2.5, 0), (3.5, 0), (99.95, 1), (1.005, 2), (0.125, 2), (700.25, 1)]
    d = spark.createDataFrame(xs, "x double, d int").select("x", "d", q.round_half_even(F.col("x"), F.col("d")).alias("r"))
    assert [(r.x, r.r) for r in d.collect() if r.r != round(r.x, r.d)] == []
