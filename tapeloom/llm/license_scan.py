"""Licence detection by diagonal voting of word k-grams, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, lower_ascii, only, row_key, words

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
# Notices and licence texts that are matched approximately, and their labels.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", """you may not use this file except in compliance with the license you may obtain a copy of the license at
http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed
under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license"""),
    ("mit", "released under the mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to
use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
shall be included in all copies or substantial portions of the software"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met"""),
    ("bsd", """redistributions of source code must retain the above copyright notice this list of conditions and the following
disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held
liable for any damages arising from the use of this software permission is granted to anyone to use this software for any
purpose including commercial applications and to alter it and redistribute it freely"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
license as published by the free software foundation either version 3 of the license or at your option any later version
this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty
of merchantability or fitness for a particular purpose see the gnu general public license for more details"""),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
distributed with this file you can obtain one at"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial
or non commercial and by any means"""),
)
#: Words of a gram in templates of LONG words or more, and in shorter ones; the first SHORT_K words are hashed together.
LONG, LONG_K, SHORT_K = 16, 5, 2


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, exact, k, n_words, place and words of each k-gram; under a thousand rows, whatever the input."""
    rows = []
    for t, (exact, (label, text)) in enumerate([(True, p) for p in PHRASES] + [(False, p) for p in NOTICES]):
        w = text.split()
        k = LONG_K if len(w) >= LONG else SHORT_K
        rows += [(t, label, exact, k, len(w), p, w[p : p + k]) for p in range(len(w) - k + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, exact boolean, k int, n_words int, place int, t array<string>")
    return grams.select("*", F.xxhash64(F.get("t", 0), F.get("t", 1)).alias("gram"))


def license_spans(docs: DataFrame, coverage: float = 0.75, drift: int = 2) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: doc_id, row, n_words. spans: row, label, exact, first, last (words from 0), score.

    All rolling word grams of a text are joined to their places in the templates, by a hash of their first two words and then
    by all their words: five in long templates, two in short ones. A match votes for the diagonal (place in the
    text less place in the template). Phrases need all votes of one diagonal. For notices, diagonals that lie within
    ``drift`` of each other merge, as insertions and omissions shift them; in each merged run the span of at most twice
    the template's length whose grams cover most of its words is the match, if that is ``coverage`` of them or more.
    That share is the score. A run may be of any length: only its spans are judged, not its extent.

    Words are maximal runs of a-z, 0-9 and characters beyond ASCII after A-Z became lower case. Null texts count as empty.
    Rows that are there twice give equal rows. Other columns are ignored. An empty table gives empty results.

    The templates are the broadcast side: a fixed list of under a thousand rows. Only matches are shuffled, by row; a text
    of any length gives as many as it has words in notices.
    """
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), words(lower_ascii(F.col("text")), LICENSE_WORD).alias("w"))
    sizes = rows.select("doc_id", "row", F.size("w").cast("long").alias("n_words"))
    grams = rows.select("row", "w", F.posexplode("w").alias("at", "w0"))
    grams = grams.withColumn("gram", F.xxhash64("w0", F.get("w", F.col("at") + 1)))
    t = F.broadcast(template_grams(docs.sparkSession).withColumnRenamed("n_words", "t_words"))
    equal = (F.col("w0") == F.get("t", 0)) & (F.get("w", F.col("at") + 1) == F.get("t", 1))
    for j in range(SHORT_K, LONG_K):
        equal &= (F.col("k") <= j) | (F.get("w", F.col("at") + j) == F.get("t", j))
    hits = grams.join(t, "gram").where(F.coalesce(equal, F.lit(False)))
    hits = cut(hits.select("row", "template", "label", "exact", "k", "t_words", "place", "at", (F.col("at") - F.col("place")).alias("diagonal")).distinct())
    phrases = hits.where("exact").groupBy("row", "template", "label", "t_words", "diagonal").agg(F.count("*").alias("votes"))
    phrases = phrases.where("votes = t_words - 1").select(
        "row", "label", F.lit(True).alias("exact"), F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("t_words") - 1).alias("last"), F.lit(1.0).alias("score")
    )
    order = W.partitionBy("row", "template").orderBy("diagonal", "at")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(1))
    near = hits.where("NOT exact").withColumn("new", new)
    near = near.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    longest = 2 * max(len(x.split()) for _, x in NOTICES)
    ahead = W.partitionBy("row", "template", "run").orderBy("at").rangeBetween(0, longest)
    near = near.withColumn("seen", F.collect_list(F.struct("at", "place")).over(ahead))
    seen = F.filter("seen", lambda s: s["at"] + F.col("k") <= F.col("at") + 2 * F.col("t_words"))
    near = near.withColumn("seen", seen).withColumn("last", F.array_max(F.transform("seen", lambda s: s["at"])) + F.col("k") - 1)
    told = F.flatten(F.transform("seen", lambda s: F.sequence(s["place"], s["place"] + F.col("k") - 1)))
    near = near.withColumn("score", F.size(F.array_distinct(told)) / F.col("t_words"))
    best = near.groupBy("row", "template", "label", "run").agg(F.max_by(F.struct(F.col("at").alias("first"), "last", "score"), F.struct("score", -F.col("last") + F.col("at"), -F.col("at"))).alias("best"))
    notices = best.where(F.col("best.score") >= coverage).select("row", "label", F.lit(False).alias("exact"), "best.*")
    return sizes, phrases.unionByName(notices)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``.

    Texts that are null or have no words, and rows of an empty table, have no labels and score 0; equal rows give equal rows.
    """
    sizes, spans = license_spans(docs)
    found = spans.groupBy("row").agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return sizes.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
