"""License scan by diagonal voting. DataFrame operations only.

All rolling word k-grams of the corpus are hashed and joined to the positions of the
k-grams of the templates (a fixed list); a match votes for the diagonal position minus
template position. Votes are counted by diagonal, neighbouring diagonals (words put in or
left out) are merged into one span. The join compares the words themselves besides the hash,
so each vote is verified; a span is verified by reading its votes in the order of the
document: those count that go on in the order of the template, and a span is taken if they
are enough of it.

Cases: null and empty texts have no words; texts shorter than k words have no k-gram.
Rows that repeat id and text come out as often as they came in. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Neighbouring diagonals of one template merge when they lie this near.
GAP = 4

# Phrases whose places are counted exactly, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Sentences of public licences; a document with most of one gets its label.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ],
    "apache-2": ["licensed under the apache license version 2 0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "gpl": [
        "licensed under the gnu general public license",
        "it under the terms of the gnu general public license as published by the free software foundation either version",
    ],
    "gpl-3": ["gnu general public license version 3"],
    "gpl-2": ["gnu general public license version 2"],
    "lgpl": ["gnu lesser general public license"],
    "agpl": ["gnu affero general public license"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["cc by sa 4 0"],
}


def templates(spark: SparkSession) -> DataFrame:
    """(gram, t, tpos, gwords) of all k-grams of the fixed templates; t = -1 stands for the document itself."""
    rows = [(t, p, w[p : p + K]) for t, (_, _, w) in enumerate(listed()) for p in range(len(w) - K + 1)]
    made = spark.createDataFrame(rows, "t int, tpos int, gwords array<string>")
    made = made.withColumn("gram", gram("gwords[0]", "gwords[1]", "gwords[2]"))
    return made.unionByName(spark.sql("SELECT -1 t, 0 tpos, cast(array() as array<string>) gwords, 0L gram"))


def listed() -> list[tuple[str, bool, list[str]]]:
    """(label, whether a phrase, words) of each template."""
    return [(label, True, text.split()) for text, label in PHRASES.items()] + [(label, False, text.split()) for label, texts in TEMPLATES.items() for text in texts]


def gram(*of: str) -> F.Column:
    return F.expr(f"xxhash64({', '.join(of)})")


def doc_words(text: F.Column) -> F.Column:
    """Words in order, A-Z lower-cased. lower() maps one letter outside ASCII into ASCII, the Kelvin sign; it is replaced first, and so stays what it is: a letter of no template."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.8) -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    min_share: the share of a template's k-grams that a merged span must hold, in order, to be counted.
    spans: array of (label, first_word, end_word, share). Votes move by document, after the
    join; a text that never matches moves as one row without its words.
    """
    kinds = listed()
    docs = docs.select(F.col(id_col).alias("doc_id"), doc_words(F.col(text_col)).alias("words"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"))
    grams = F.expr(f"concat(array(0L), CASE WHEN size(words) >= {K} THEN transform(sequence(0, size(words) - {K}), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE cast(array() as array<bigint>) END)")
    # the outer form, as the plain one adds a filter that works the arrays out once more; no array is empty
    rolled = docs.withColumn("grams", grams).select("doc_id", "h", "words", F.size("words").alias("n"), F.posexplode_outer("grams").alias("pos", "gram"))
    # the first of the grams stands for the document; a gram of words that has its value is kept off by its position
    right = F.when(F.col("t") < 0, F.col("pos") == 0).otherwise((F.col("pos") > 0) & (F.slice("words", F.greatest(F.col("pos"), F.lit(1)), K) == F.col("gwords")))
    votes = rolled.join(F.broadcast(templates(docs.sparkSession)), "gram").where(right).select("doc_id", "h", "n", "t", (F.col("pos") - 1).alias("pos"), "tpos")
    # one exchange, by document, serves all that follows
    by = votes.repartition("doc_id", "h")
    size = F.expr("element_at(array(" + ",".join(str(len(w) - K + 1) for _, _, w in kinds) + "), t + 1)")
    diagonal = by.groupBy("doc_id", "h", "n", "t", F.when(F.col("t") < 0, 0).otherwise(F.col("pos") - F.col("tpos")).alias("d")).agg(F.collect_set("tpos").alias("hit"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("copies"))
    each = Window.partitionBy("doc_id", "h", "n", "t").orderBy("d")
    phrase = F.col("t").between(0, len(PHRASES) - 1)
    fresh = F.coalesce(phrase | (F.col("d") - F.lag("d").over(each) > GAP), F.lit(True))
    merged = diagonal.withColumn("part", F.sum(fresh.cast("int")).over(each)).groupBy("doc_id", "h", "n", "t", "part").agg(F.collect_list(F.struct("d", "hit")).alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("d").alias("d"), F.max("copies").alias("copies"))
    in_order = F.expr("""aggregate(array_sort(flatten(transform(parts, p -> transform(p.hit, x -> struct(x + p.d AS pos, x AS tpos))))),
        named_struct('last', -1, 'n', 0), (a, x) -> CASE WHEN x.tpos > a.last THEN named_struct('last', x.tpos, 'n', a.n + 1) ELSE a END, a -> a.n)""")
    share = F.when(F.col("t") < 0, F.lit(-1.0)).otherwise(in_order / F.when(F.col("t") >= 0, size))
    span = F.struct("t", F.when(phrase, F.col("d")).otherwise(F.col("lo")).alias("first_word"), (F.col("hi") + K).alias("end_word"), F.round(share, 6).alias("share"))
    spans = merged.withColumn("span", span).groupBy("doc_id", "h", "n").agg(F.collect_list(F.when((F.col("t") >= 0), F.col("span"))).alias("all"), F.max(F.when(F.col("t") < 0, F.col("copies"))).alias("copies"))
    names = "array(" + ",".join(f"'{label}'" for label, _, _ in kinds) + ")"
    spans = spans.withColumn("base", F.expr(f"filter(all, s -> s.t < {len(PHRASES)} AND s.share = 1)"))
    spans = spans.withColumn("own", F.expr(f"filter(all, s -> s.t >= {len(PHRASES)} AND s.share >= {min_share})"))
    label = lambda c: F.expr(f"array_join(array_sort(array_distinct(transform({c}, s -> element_at({names}, s.t + 1)))), ',')")
    starts = F.expr("transform(base, s -> cast(s.first_word as bigint))")
    return spans.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label("base").alias("base_labels"), label("concat(base, own)").alias("labels"), F.coalesce(F.expr("array_max(transform(all, s -> s.share))"), F.lit(0.0)).alias("score"),
        F.expr(f"transform(array_sort(concat(base, own)), s -> struct(element_at({names}, s.t + 1) AS label, s.first_word, s.end_word, s.share))").alias("spans"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
