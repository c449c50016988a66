"""Licence scan: a trained paragraph classifier (sparse word n-gram logistic regression), a calibrated unknown class, and comparison
with templates, which confirms or rejects what the classifier says. DataFrame and MLlib transformers only.

Trained on the templates below in varied framings, against paragraphs of a bounded sample of documents (SAMPLE_DOCS of them) that no
template matches. A paragraph is a line, or neighbouring lines joined, for notices that are broken over lines. Half of the rows fit the classifier, the other half calibrates the log-odds of "some licence".
"""
from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import LOWER, UPPER, written

# ---- Fixed values: licence families and wordings of their notices ----------------------------------------------------
TEMPLATES = {
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
             "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Licensed under the BSD License.", "Released under the BSD 3-Clause License.", "Distributed under the 2-Clause BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution License (CC BY)."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "SPDX-License-Identifier: MIT"],
    "MPL": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
                    "This document is confidential and proprietary and may not be copied or distributed without permission."],
}
# ----------------------------------------------------------------------------------------------------------------------
UNKNOWN = "none"
FRAMES = ["{}", "Copyright (c) 2021 The Authors. {}", "{} See the file for details.", "Note: {}", "Unless stated otherwise, {}", "(c) 2019-2023. {} Read it before use."]
SAMPLE_DOCS = 400
KNOWN, SIMILAR = 0.5, 0.6  # least calibrated probability of a licence, least share of a template's word pairs
TOKEN = r"[^\x20\x09-\x0D.,;:!?()\[\]\"'“”]+"


# what may stand before a line of a comment or a quotation
LEADER = r"^[\x20\x09]*(?:<!--|/\*+|\*+/?|//+|#+|--+|;+|%+|>+)?[\x20\x09\x0D]*"


def _template_words() -> tuple[int, list[str]]:
    """The most words a template has, and words of which a text that is similar to any template has at least one."""
    most, keys = 0, set()
    for text in (t for texts in TEMPLATES.values() for t in texts):
        w = re.findall(TOKEN, text.lower())
        most, both = max(most, len(w)), set(zip(w, w[1:]))
        for word in sorted(set(w), key=lambda x: (x not in keys, x in ("by", "under"), -len(x), x)):
            if sum(not keys & set(b) for b in both) < SIMILAR * len(both):
                break
            keys.add(word)
    return most, sorted(keys)


MOST_WORDS, KEYS = _template_words()


def words(text: Column) -> Column:
    """Words with A-Z in lower case, punctuation around them left out."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def pairs(tokens: Column) -> Column:
    """Adjacent words; an element for each word but the last."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array())


def with_terms(df: DataFrame, column: str = "paragraph") -> DataFrame:
    """Adds terms: words, then pairs. Bound, so that a filter which Spark pushes below does not compute the words once for each use."""
    return df.withColumn("terms", let(words(F.col(column)), lambda w: F.concat(w, pairs(w))))


def pairs_of(terms: Column) -> Column:
    return F.filter(terms, lambda t: F.contains(t, F.lit(" ")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, position, paragraph: the lines of a text that are not blank, at their line numbers."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "paragraph"))
    return lines.where(F.col("paragraph").rlike(r"[^\x20\x09-\x0D]"))


def joined_lines(docs: DataFrame) -> DataFrame:
    """doc_id, position, last, paragraph: two or more neighbouring lines without comment leaders, from each line on; as many as a template
    needs that begins in the first one. Lines without words part them. Only where a word of KEYS stands."""
    keys = F.array(*[F.lit(k) for k in KEYS])
    plain = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, LEADER, ""))
    line = lambda x: let(words(x), lambda w: F.struct(x.alias("t"), F.size(w).alias("n"), F.arrays_overlap(w, keys).alias("key")))
    lines = docs.where(F.contains("text", F.lit("\n"))).select("doc_id", F.transform(plain, line).alias("_all"))
    # MOST_WORDS lines hold that many words; the next one may hold the end
    after = lambda i: F.slice("_all", i + 1, F.lit(MOST_WORDS + 1))
    begins = F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: (F.get("_all", i).n > 0) & F.exists(after(i), lambda x: x.key))
    starts = lines.select("doc_id", F.inline(F.transform(begins, lambda i: F.struct(i.alias("position"), after(i).alias("_next")))))
    gap = F.array_position(F.transform("_next", lambda x: x.n == 0), F.lit(True)).cast("int")
    starts = starts.withColumn("_next", F.when(gap > 0, F.slice("_next", F.lit(1), gap - 1)).otherwise(F.col("_next"))).where(F.size("_next") > 1)
    ends = starts.select("doc_id", "position", "_next", F.explode(F.sequence(F.lit(2), F.size("_next"))).alias("_n"))
    between = F.aggregate(F.slice("_next", F.lit(2), F.col("_n") - 2), F.lit(0), lambda a, x: a + x.n)
    ends = ends.where((between < MOST_WORDS) & F.exists(F.slice("_next", F.lit(1), F.col("_n")), lambda x: x.key))
    text = F.array_join(F.transform(F.slice("_next", F.lit(1), F.col("_n")), lambda x: x.t), " ")
    return ends.select("doc_id", "position", (F.col("position") + F.col("_n") - 1).alias("last"), text.alias("paragraph"))


def templates(spark: SparkSession) -> DataFrame:
    """family, template, its distinct word pairs. A few dozen rows."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return with_terms(spark.createDataFrame(rows, "family string, template string"), "template").select(
        "family", "template", F.array_distinct(pairs_of(F.col("terms"))).alias("template_pairs"))


def similarity(df: DataFrame, own_family: bool) -> DataFrame:
    """Adds similar: the largest share of a template's word pairs that the paragraph holds; of templates of its `family`, or of any.
    The templates are fixed, so each paragraph carries them as an array."""
    t = templates(df.sparkSession).select(F.collect_list(F.struct("family", "template_pairs")).alias("_t"))
    joined = df.crossJoin(F.broadcast(t))  # one row
    usable = F.filter("_t", lambda x: x.family == F.col("family")) if own_family else F.col("_t")
    share = let(pairs_of(F.col("terms")), lambda own: F.transform(
        usable, lambda x: F.size(F.array_intersect(x.template_pairs, own)) / F.greatest(F.size(x.template_pairs), F.lit(1))))
    return joined.withColumn("similar", F.coalesce(F.array_max(share), F.lit(0.0))).drop("_t")


class LicenseModel:
    """Vocabulary, classifier and calibration."""

    def __init__(self, vocabulary: CountVectorizerModel, classifier: LogisticRegressionModel, labels: list[str], slope: float, offset: float):
        self.vocabulary, self.classifier, self.labels, self.slope, self.offset = vocabulary, classifier, labels, slope, offset

    def raw(self, df: DataFrame) -> DataFrame:
        """Adds family (the likeliest) and odds (log-odds that it is some licence, before calibration)."""
        scored = self.classifier.transform(self.vocabulary.transform(df)).withColumn("_p", vector_to_array("probability"))
        p = F.col("_p")
        names = F.array(*[F.lit(x) for x in self.labels])
        known = F.slice(p, 1, len(self.labels))
        scored = scored.withColumn("family", F.element_at(names, F.array_position(known, F.array_max(known)).cast("int")))
        odds = let(F.element_at(p, len(self.labels) + 1), lambda none: F.log(F.greatest(1 - none, F.lit(1e-12))) - F.log(F.greatest(none, F.lit(1e-12))))
        return scored.withColumn("odds", odds).drop("_p", "features", "rawPrediction", "probability", "prediction")

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds family and p_license (calibrated)."""
        return self.raw(with_terms(df)).withColumn("p_license", 1 / (1 + F.exp(-(F.col("odds") * self.slope + self.offset)))).drop("odds")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LicenseModel:
    """Fits and calibrates. The documents are those with the least hashes of their ids."""
    spark = docs.sparkSession
    labels = sorted(TEMPLATES)
    known = [(frame.format(t), float(labels.index(family)), (k + n) % 2) for family, texts in TEMPLATES.items() for k, t in enumerate(texts) for n, frame in enumerate(FRAMES)]
    positive = with_terms(spark.createDataFrame(known, "paragraph string, label double, part int"))
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    plain = paragraphs(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    plain = similarity(with_terms(plain), own_family=False).where(F.col("similar") < SIMILAR)
    negative = plain.select("paragraph", F.lit(float(len(labels))).alias("label"), F.pmod(F.xxhash64("paragraph"), F.lit(2)).cast("int").alias("part"), "terms")
    rows = written(positive.select("paragraph", "label", "part", "terms").unionByName(negative), "license-training").coalesce(2)
    vocabulary = sorted(r.t for r in with_terms(spark.createDataFrame([(x[0],) for x in known], "paragraph string")).select(
        F.explode("terms").alias("t")).distinct().collect())  # of the framed templates: fixed by them
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features", binary=True)
    data = vectors.transform(rows)
    weight = F.when(F.col("label") == len(labels), 1.0).otherwise(5.0)
    lr = LogisticRegression(family="multinomial", regParam=5e-4, elasticNetParam=1.0, maxIter=60, standardization=False, weightCol="weight")
    fitted = lr.fit(data.where("part = 0").withColumn("weight", weight).select("features", "label", "weight"))
    model = LicenseModel(vectors, fitted, labels, 1.0, 0.0)
    held = model.raw(rows.where("part = 1")).select((F.col("label") < len(labels)).cast("double").alias("label"), "odds")
    held = VectorAssembler(inputCols=["odds"], outputCol="features").transform(held)
    platt = LogisticRegression(regParam=1e-3, maxIter=50).fit(held.select("label", "features"))
    model.slope, model.offset = float(platt.coefficients[0]), float(platt.intercept)
    return model


def license_paragraphs(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, position, last, paragraph, family, p_license, similar: the lines and joined lines that hold a licence notice, by classifier
    and template. Of those that lie in one another, the most similar ones, and of these the shortest."""
    marked = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("doc_id"), "text")  # rows may share an id
    single = paragraphs(marked).select("doc_id", "position", F.col("position").alias("last"), "paragraph")
    found = model.predict(single.unionByName(joined_lines(marked))).where(F.col("p_license") >= KNOWN)
    found = similarity(found, own_family=True).where(F.col("similar") >= SIMILAR).drop("terms")
    near = Window.partitionBy("doc_id").orderBy("position").rangeBetween(-MOST_WORDS, MOST_WORDS)  # in lines, each of a word or more
    found = found.withColumn("_near", F.collect_set(F.struct("position", "last", "similar")).over(near))
    position, last, similar = F.col("position"), F.col("last"), F.col("similar")

    def better(x: Column) -> Column:
        around, inside = (x.position <= position) & (x["last"] >= last), (x.position >= position) & (x["last"] <= last)
        shorter = (x.similar == similar) & (x["last"] - x.position < last - position)
        return (around | inside) & ((x.similar > similar) | shorter)

    return found.where(~F.exists("_near", better)).drop("_near").withColumn("doc_id", F.col("doc_id.doc_id"))


def license_scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row per row: doc_id, n_paragraphs, n_license, licenses (families, sorted, joined by commas), first_license (line number).
    n_paragraphs counts lines that are not blank, n_license lines at which a notice begins.

    Null and empty texts have no paragraphs. Rows that repeat an id share what is found in any of them. A row without id is scanned
    like the others, all of them as one. An empty table gives no rows; further columns are not looked at. Texts are not shuffled.
    """
    docs = docs.select("doc_id", "text")
    found = license_paragraphs(docs, model or train(docs)).select("doc_id", "position", "family").distinct()
    by_doc = found.groupBy(F.col("doc_id").alias("_id")).agg(F.countDistinct("position").alias("n_license"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licenses"),
                                                             F.min("position").cast("long").alias("first_license"))
    count = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_paragraphs"))
    return rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_license", F.lit(0)).alias("n_license"), F.coalesce("licenses", F.lit("")).alias("licenses"), "first_license")
