"""License scans by diagonal voting. DataFrame functions only.

Words are runs of letters, digits and characters beyond ASCII, A-Z lowered. Every run of ``GRAM`` words of a document is hashed
(shorter templates: as many words as they have) and joined to the places of the templates' runs; a hit's words are
compared, so no hash collision counts. Hits vote for their diagonal, the document's place less the template's. Neighbouring
diagonals, as words that were put in or left out make them, are merged into one span, and a span is verified: the words of
the template that its hits cover, each once, must be ``COVERED`` of all, and all of its marked words must be among them.

Templates are a parameter. Base phrases are templates of few words, which must stand as they are; each place is a span.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
COVERED = 0.7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words in square brackets must be found; a base template must be found whole, word by word."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(SEPARATORS, self.text.lower()) if w]

    @property
    def marked(self) -> list[int]:
        marks = [(m.start(), m.end()) for m in re.finditer(r"\[[^]]*\]", self.text)]
        places = [m.start() for m in re.finditer(r"[0-9a-z]+", self.text.lower())]
        return [i for i, p in enumerate(places) if any(a < p < b for a, b in marks)]


# The phrases that the result counts, and the wording of public licenses and of their usual notices.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
NOTICES = (
    Template("mit", "released under the [MIT] License"),
    Template("mit", "licensed under the [MIT] License"),
    Template("mit", "this project is licensed under the terms of the [MIT] license"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("apache-2.0", "licensed under the [Apache] License, Version [2].0"),
    Template(
        "apache-2.0",
        "Licensed under the [Apache] License, Version [2].0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    Template("bsd-3-clause", "licensed under the [BSD] [3] clause license"),
    Template("bsd-2-clause", "licensed under the [BSD] [2] clause license"),
    Template("gpl-2.0", "licensed under the GNU [General] Public License, version [2]"),
    Template("gpl-3.0", "licensed under the GNU [General] Public License, version [3]"),
    Template(
        "gpl-2.0",
        "redistribute it and/or modify it under the terms of the GNU [General] Public License as published by the Free Software Foundation; "
        "either version [2] of the License",
    ),
    Template(
        "gpl-3.0",
        "redistribute it and/or modify it under the terms of the GNU [General] Public License as published by the Free Software Foundation, "
        "either version [3] of the License",
    ),
    Template("lgpl", "under the terms of the GNU [Lesser] General Public License"),
    Template("agpl", "under the terms of the GNU [Affero] General Public License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the [Mozilla] Public License, v. [2].0"),
    Template("bsl-1.0", "Distributed under the [Boost] Software License, Version 1.0"),
    Template("epl-2.0", "made available under the terms of the [Eclipse] Public License [2].0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages"),
    Template("cc-by-4.0", "licensed under a Creative Commons [Attribution] [4].0 International License"),
    Template("cc-by-4.0", "licensed under [CC] [BY] [4].0"),
    Template("cc-by-sa-4.0", "licensed under a Creative Commons Attribution [ShareAlike] [4].0 International License"),
    Template("cc-by-sa-4.0", "licensed under CC [BY] [SA] [4].0"),
    Template("cc-by-nc-4.0", "licensed under a Creative Commons Attribution [NonCommercial] [4].0 International License"),
    Template("cc-by-nc-4.0", "licensed under CC [BY] [NC] [4].0"),
    Template("cc0-1.0", "waived all copyright and related or neighboring rights to this work"),
    Template("reserved-notice", "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means"),
)
TEMPLATES = BASE + NOTICES


def words_of(text: Column) -> Column:
    """Words in order. The one letter beyond ASCII that is lowered to an ASCII letter alone, U+212A, is put aside first."""
    plain = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def _gram(words: Column, at: Column, size: int) -> Column:
    """A hash of ``size`` words from a place on; null where they do not fit."""
    return F.when(at + size <= F.size(words), F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size))))


def _places(spark: SparkSession, templates: Sequence[Template], gram: int) -> DataFrame:
    """One row for each run of words of each template; as many as the given templates have."""
    rows = [
        F.struct(
            F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(t.words)).alias("length"),
            F.lit(min(gram, len(t.words))).alias("size"), F.lit(t.words).alias("own"), F.lit(t.marked).cast("array<int>").alias("marked"),
        )
        for i, t in enumerate(templates)
    ]
    whole = spark.range(1).select(F.inline(F.array(*rows)))
    own = F.col("own")
    runs = whole.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))))
    hashed = F.coalesce(*(F.when(F.col("size") == s, _gram(own, F.col("place"), s)) for s in sorted({min(gram, len(t.words)) for t in templates})))
    return runs.select("template", "label", "base", "length", "size", "marked", "place", hashed.alias("hash"), F.slice(own, F.col("place") + 1, F.col("size")).alias("run"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows by id and two hashes of the text, so that texts that share an id are told apart."""
    given = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(given).alias("h1"), F.xxhash64(F.lit(17), given).alias("h2"), words_of(given).alias("words"))


_KEY = ["doc_id", "h1", "h2"]


def _spans(rows: DataFrame, templates: Sequence[Template], gram: int, covered: float) -> DataFrame:
    sizes = sorted({min(gram, len(t.words)) for t in templates})
    words, at = F.col("words"), F.col("pos")
    # The outer form keeps Spark from working the words out a second time to see whether there are any.
    placed = rows.select(*_KEY, "words", F.posexplode_outer("words").alias("pos", "word"))
    grams = placed.select(*_KEY, "words", "pos", F.explode_outer(F.array(*(_gram(words, at, s) for s in sizes))).alias("hash"))
    same = (grams["hash"] == F.col("t.hash")) & (F.slice(words, at + 1, F.col("t.size")) == F.col("t.run"))
    hits = grams.join(F.broadcast(_places(rows.sparkSession, templates, gram).alias("t")), same).select(
        *_KEY, F.struct("t.template", "t.label", "t.base", "t.length", "t.size", "t.marked").alias("t"), (at - F.col("t.place")).alias("diagonal"), "t.place"
    )
    # Repeated rows vote alike, so a diagonal keeps its places once.
    votes = hits.groupBy(*_KEY, "t", "diagonal").agg(F.collect_set("place").alias("places"))
    by_template = Window.partitionBy(*_KEY, "t").orderBy("diagonal")
    slack = F.when(F.col("t.base"), 0).otherwise(F.floor(F.col("t.length") / 6))
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_template) > slack).cast("int"), F.lit(1))
    merged = (
        votes.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(by_template))
        .groupBy(*_KEY, "t", "span")
        .agg(
            F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
            F.max(F.col("diagonal") + F.array_max("places") + F.col("t.size")).alias("end"),
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        )
    )
    found = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("t.size") - 1))))
    scored = merged.withColumn("found", found).withColumn("score", F.size("found") / F.col("t.length"))
    verified = F.when(F.col("t.base"), F.col("score") == 1).otherwise((F.col("score") >= covered) & (F.size(F.array_except("t.marked", "found")) == 0))
    return scored.where(verified).select(*_KEY, "t.label", "t.base", "t.template", "start", "end", "score")


def license_spans(
    docs: DataFrame, *, templates: Sequence[Template] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, covered: float = COVERED
) -> DataFrame:
    """Verified spans: ``doc_id``, ``label``, ``base``, ``template`` (its number), ``start``, ``end`` (words from 0, exclusive), ``score``.

    Null and empty texts have none. Rows that repeat id and text give their spans once. Extra columns are ignored.
    """
    return _spans(_keyed(docs, doc_id, text), templates, gram, covered).drop("h1", "h2")


def scan_licenses(
    docs: DataFrame, *, templates: Sequence[Template] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, covered: float = COVERED
) -> DataFrame:
    """One row per row of ``docs``: words, places of base phrases, first and last of them, labels, and the best span's score.

    Null and empty texts count no words and have no label, a null first and last word, and score 0. Repeated rows give
    repeated rows; rows that share an id are told apart by text. Extra columns are ignored. An empty table gives no rows.
    """
    rows = _keyed(docs, doc_id, text)
    based = F.when(F.col("base"), F.col("start")).cast("long")
    written = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    found = (
        _spans(rows, templates, gram, covered)
        .groupBy(*_KEY)
        .agg(
            F.count(based).alias("n_base"),
            F.min(based).alias("first_word"),
            F.max(based).alias("last_word"),
            written(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            written(F.col("label")).alias("labels"),
            F.max("score").alias("score"),
        )
        .alias("f")
    )
    counted = rows.select(*_KEY, F.size("words").cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("d.h1").eqNullSafe(F.col("f.h1")) & F.col("d.h2").eqNullSafe(F.col("f.h2"))
    return counted.join(found, same, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _literal(x) -> str:
    return "[" + ", ".join(map(_literal, x)) + "]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)


def oracle(templates: Sequence[Template] = TEMPLATES, gram: int = GRAM, covered: float = COVERED) -> str:
    """The same as DuckDB SQL, on words instead of hashes."""
    values = ",\n".join(
        f"({i}, '{t.label}', {t.base}, {min(gram, len(t.words))}, {_literal(t.words)}, {_literal(t.marked)}::INT[])" for i, t in enumerate(templates)
    )
    return f"""WITH templates(t, label, base, k, own, marked) AS (VALUES {values}),
places AS (SELECT t, p - 1 AS p, k, array_to_string(own[p:p + k - 1], ' ') AS run FROM
  (SELECT t, k, own, unnest(range(1, len(own) - k + 2)) AS p FROM templates)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
firsts AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
grams AS (SELECT r, i - 1 AS i, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM firsts, (SELECT DISTINCT k FROM templates) WHERE i + k - 1 <= len(w)),
hits AS (SELECT r, t, i - p AS d, p FROM grams JOIN places USING (k, run)),
votes AS (SELECT r, t, d, list(p) AS ps FROM hits GROUP BY ALL),
marked_off AS (SELECT *, coalesce(d - lag(d) OVER (PARTITION BY r, t ORDER BY d) >
  (SELECT CASE WHEN base THEN 0 ELSE len(own) // 6 END FROM templates x WHERE x.t = votes.t), true) AS apart FROM votes),
numbered AS (SELECT *, sum(apart::INT) OVER (PARTITION BY r, t ORDER BY d) AS span FROM marked_off),
merged AS (SELECT r, t, span, min(d + list_min(ps)) AS start, list_distinct(flatten(list(ps))) AS ps FROM numbered GROUP BY ALL),
found AS (SELECT r, t, start, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + k)))) AS f, label, base, own, marked
  FROM merged JOIN templates USING (t)),
spans AS (SELECT r, label, base, start, len(f) / len(own) AS score FROM found
  WHERE CASE WHEN base THEN len(f) = len(own) ELSE len(f) / len(own) >= {covered} AND list_has_all(f, marked) END),
summed AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(score) AS score FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score FROM docs LEFT JOIN summed USING (r)"""
