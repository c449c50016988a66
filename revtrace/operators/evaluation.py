"""Scoring against gold tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.when(b > 0, F.round(a / b, 3))


def score_citations(pred: DataFrame, gold: DataFrame, by: str = "target_id") -> DataFrame:
    """pred(target, work_id, cites, sentence_verified), gold(target, work_id, cites) -> tp, recall, precision, accuracy
    (a work outside the gold table counts as not_relying), missed and false works, unverified ones."""
    p = pred.select(by, "work_id", F.col("cites").alias("p"), "sentence_verified")
    g = gold.select(by, "work_id", F.col("cites").alias("g"))
    j = p.join(g, [by, "work_id"], "full_outer")
    is_p, is_g = F.coalesce(F.col("p") == "superseded", F.lit(False)), F.coalesce(F.col("g") == "superseded", F.lit(False))
    judged = F.col("p").isNotNull()
    n = j.groupBy(by).agg(
        F.count_if(is_g).alias("gold_superseded"), F.count_if(is_p).alias("predicted_superseded"), F.count_if(is_p & is_g).alias("tp"),
        F.count_if(judged).alias("n_judged"), F.count_if(judged & (F.col("p") == F.coalesce("g", F.lit("not_relying")))).alias("correct"),
        F.array_sort(F.collect_list(F.when(is_g & ~is_p, F.col("work_id")))).alias("missed"),
        F.array_sort(F.collect_list(F.when(is_p & ~is_g, F.col("work_id")))).alias("false_superseded"),
        F.count_if(is_p & ~F.coalesce("sentence_verified", F.lit(False))).alias("unverified_superseded"))
    return (n.withColumn("recall", _ratio(F.col("tp"), F.col("gold_superseded")))
            .withColumn("precision", _ratio(F.col("tp"), F.col("predicted_superseded")))
            .withColumn("accuracy_over_judged", _ratio(F.col("correct"), F.col("n_judged"))).drop("correct"))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Counts per gold->pred; a missing prediction is invalid."""
    return df.groupBy(F.concat_ws("->", F.col(gold).cast("string"), F.coalesce(F.col(pred).cast("string"), F.lit("invalid"))).alias("cell")).agg(
        F.count("*").alias("n"))


def accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Rows and accuracy to three places; null for no rows."""
    return df.agg(F.count("*").alias("n"), _ratio(F.count_if(F.col(gold).eqNullSafe(F.col(pred))), F.count("*")).alias("accuracy"))


def score_retrieval(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """ranked(query_id, event_id, rank, above_floor, verdict), queries(query_id, event_id, want, has_number) -> hit@1,
    found, above the floor, verdict right, and the same for queries with a number."""
    right = ranked.join(queries.select("query_id", "event_id"), ["query_id", "event_id"]).groupBy("query_id").agg(
        F.min("rank").alias("rank"), F.min_by("verdict", "rank").alias("verdict"))
    floor = ranked.groupBy("query_id").agg(F.bool_or("above_floor").alias("above"))
    j = queries.join(right, "query_id", "left").join(floor, "query_id", "left")
    ok = F.coalesce(F.col("verdict") == F.col("want"), F.lit(False))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("hit1"), F.count("rank").alias("found"),
                 F.count_if(F.coalesce("above", F.lit(False))).alias("above_floor"), F.count_if(ok).alias("old_new_correct"),
                 F.count_if(ok & F.col("has_number")).alias("correct_with_number"), F.count_if("has_number").alias("with_number"))


def drift_summary(rows: DataFrame) -> DataFrame:
    """rows(subdrift, detected, root_cause_ok, tier_ok, n_evidence, grounded): sums over positives; controls (id prefix N0)
    give negatives_ok as right/all."""
    neg = F.col("subdrift").startswith("N0")
    n = lambda c: F.count_if(~neg & F.col(c))
    total = lambda c: F.coalesce(F.sum(F.when(~neg, F.col(c))), F.lit(0)).cast("long")
    return rows.agg(
        F.count_if(~neg).alias("subdrifts"), n("detected").alias("detected"), n("root_cause_ok").alias("root_cause_ok"),
        n("tier_ok").alias("tier_exact"), total("n_evidence").alias("quotes"), total("grounded").alias("quotes_grounded"),
        F.concat_ws("/", F.count_if(neg & F.col("root_cause_ok")).cast("string"), F.count_if(neg).cast("string")).alias("negatives_ok"))
