r"""License scans by diagonal voting.

Every k-gram of words of a document is joined, by hash, to the places where it stands in license templates. A hit
votes for the diagonal (place in the document minus place in the template); diagonals of one template that lie close
together are one span, since inserted or missing words shift the diagonal. Spans with enough votes are verified word
by word against the text: they must share LEAST_COVER of their words, and agree in all words that decide between
relatives (`nd`, `affero`, the version's digits); of overlapping ones the best stays. SPDX lines name their license.

Words are lower-cased (A-Z) runs `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. NULL texts count as empty; texts may have any length; repeated rows
give their result once per row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobsieve.llm.common import once, saved, small_side

GRAM = 4
NEAR = 6                # diagonals at most this far apart belong to one span
LEAST_VOTES = 0.3       # of a template's k-grams, for a span to be verified
LEAST_COVER = 0.75      # common words, in order, of the longer one of template and span
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases, and notices of public licenses.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License"),
)
# Words of which one makes another license. Versions do so too.
DECIDING = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike affero lesser library".split())
SPDX = (r"spdx-license-identifier:[ \t]*\(*([a-z0-9][a-z0-9.+-]*(?:[ \t()]+(?:or|and|with)[ \t()]+[a-z0-9][a-z0-9.+-]*)*)")


def _lowered(text: Column) -> Column:
    """Lower case. Two characters whose lower case holds an ASCII letter are masked, by one that is part of words."""
    masked = F.coalesce(text, F.lit(""))
    for odd in ("İ", "K"):
        masked = F.replace(masked, F.lit(odd), F.lit("�"))
    return F.lower(masked)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(_lowered(text), GAP), "")


def plain_words(text: str | None) -> list[str]:
    """The same words, outside Spark, for the few texts that are verified."""
    out, word = [], []
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or c >= "\x80":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out + ["".join(word)] if word else out


def with_grams(df: DataFrame, keep: list[str], words: Column) -> DataFrame:
    """`keep` and `grams`, the hash of every GRAM words in a row (pairs of pairs)."""
    def joined(x: str, by: int) -> Column:
        return F.zip_with(x, F.slice(x, F.lit(by + 1), F.size(x)), lambda a, b: F.xxhash64(a, b))

    df = once(df, keep, _one=F.transform(words, lambda x: F.xxhash64(x)))
    df = once(df, [*keep, "_one"], _two=joined("_one", 1))
    return once(df, keep, grams=F.slice(joined("_two", 2), F.lit(1), F.greatest(F.size("_one") - GRAM + 1, F.lit(0))))


def template_grams(spark, templates=TEMPLATES) -> DataFrame:
    """`gram`, `template`, `place` and `grams` (of the template) of all templates; its size is the parameter's."""
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "template int, text string")
    rows = with_grams(rows, ["template"], split_words(F.col("text")))
    return rows.select("template", F.size("grams").alias("grams"), F.posexplode("grams").alias("place", "gram"))


def spans(docs: DataFrame, keys: list[str], text: str, templates=TEMPLATES) -> DataFrame:
    """Candidate spans: `keys`, `template`, `start` and `stop` (words of the document)."""
    rows = with_grams(docs, keys, split_words(F.col(text))).select(*keys, F.posexplode("grams").alias("at", "gram"))
    hits = rows.join(small_side(saved(template_grams(docs.sparkSession, templates), "templates")), "gram")
    votes = hits.groupBy(*keys, "template", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("start"), F.max("at").alias("stop"),
        F.min("place").alias("first"), F.max("place").alias("last"))
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    votes = votes.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(order))
    return votes.groupBy(*keys, "template", "grams", "span").agg(
        F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.min("first").alias("first"), F.max("last").alias("last")).where(F.col("votes") >= F.col("grams") * LEAST_VOTES).select(
        *keys, "template", F.greatest(F.col("start") - F.col("first"), F.lit(0)).alias("start"),
        (F.col("stop") + F.col("grams") - F.col("last") + GRAM - 1).alias("stop"))


def aligned(template: list[str], words: list[str]) -> tuple[float, int, int]:
    """Share of words that template and span have in common, in order, and the place of the span in the words."""
    blocks = SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks()[:-1]
    if not blocks:
        return 0.0, 0, 0
    start, stop = blocks[0].b, blocks[-1].b + blocks[-1].size
    return sum(b.size for b in blocks) / max(len(template), stop - start), start, stop


def agree(template: list[str], words: list[str]) -> bool:
    """Whether template and span have the same deciding words, and the same numbers where the template has any."""
    if DECIDING.intersection(template) != DECIDING.intersection(words):
        return False
    numbers = [w for w in template if w.isdigit()]
    return not numbers or numbers == [w for w in words if w.isdigit()]


def settled(found: list[tuple[float, int, int, str]]) -> list[tuple[float, int, int, str]]:
    """Of overlapping spans (cover, start, stop, label) the best one: highest cover, then longest, then first."""
    out: list[tuple[float, int, int, str]] = []
    for x in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in out):
            out.append(x)
    return out


def verified(docs: DataFrame, found: DataFrame, keys: list[str], text: str, templates=TEMPLATES) -> DataFrame:
    """Spans that hold: `keys`, `label`, `start`, `stop`, `cover`."""
    labels, words = [t[0] for t in templates], [plain_words(t[1]) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (t, spans_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = plain_words(t)
                held = []
                for s in spans_:
                    share, a, b = aligned(words[s["template"]], own[s["start"]:s["stop"]])
                    a, b = s["start"] + a, s["start"] + b
                    if share >= LEAST_COVER and agree(words[s["template"]], own[a:b]):
                        held.append((share, a, b, labels[s["template"]]))
                rows += [(i, label, a, b, share) for share, a, b, label in settled(held)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k + 2).take(at) for k in range(len(keys))], pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()),
                 pa.array([r[4] for r in rows], pa.float64())], [*keys, "label", "start", "stop", "cover"])

    per_text = found.groupBy(*keys).agg(F.collect_list(F.struct("template", "start", "stop")).alias("spans"))
    rows = docs.select(*keys, text).join(small_side(saved(per_text, "spans")), keys).select(text, "spans", *keys)
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", label string, start int, stop int, cover double")


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans of all documents: _row, _sum (hashes of id and text), label, start, stop, cover."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("_row"), F.crc32(text).alias("_sum"), text.alias("text"))
    found = spans(rows, ["_row", "_sum"], "text", templates)
    return verified(rows, found, ["_row", "_sum"], "text", templates).distinct()


def _places(words: str, phrase: str, low: Column) -> Column:
    """Word places where the phrase starts; texts without its first word are not searched."""
    first, *rest = phrase.split()

    def here(x: Column, i: Column) -> Column:
        test = x == first
        for k, w in enumerate(rest, 1):
            test &= F.get(words, i + k) == w
        return F.when(test, i)

    places = F.filter(F.transform(words, here), lambda x: x.isNotNull())
    return F.when(F.contains(low, F.lit(first)), places).otherwise(F.array().cast("array<int>"))


def spdx_labels(low: Column) -> Column:
    """Identifiers of the SPDX lines of a lower-cased text."""
    parts = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(SPDX), F.lit(1)), lambda x: F.split(x, r"[ \t()]+")))
    ids = F.transform(F.filter(parts, lambda x: ~x.isin("or", "and", "with")), lambda x: F.rtrim(x, F.lit(".")))
    return F.when(F.contains(low, F.lit("spdx-license-identifier:")), F.array_distinct(ids)).otherwise(
        F.array().cast("array<string>"))


def document_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases whose words stand consecutively; the scan adds labels of its own. `score` is the
    best share of a template that was found, 1 where a base phrase or an SPDX line was. No label gives ''.
    """
    text = F.coalesce("text", F.lit(""))
    rows = once(docs, ["doc_id", F.xxhash64("doc_id", text).alias("_row"), F.crc32(text).alias("_sum")],
                _low=_lowered(F.col("text")), _words=split_words(F.col("text")))
    keys = ["doc_id", "_row", "_sum"]
    names = sorted(PHRASES)
    places = [_places("_words", PHRASES[n], F.col("_low")) for n in names]
    rows = once(rows, keys, n_words=F.size("_words").cast("bigint"), _places=F.array(*places),
                _spdx=spdx_labels(F.col("_low")))
    every = F.flatten("_places")
    base = F.concat_ws(",", *[F.when(F.size(F.get("_places", F.lit(i))) > 0, F.lit(n)) for i, n in enumerate(names)])
    rows = rows.select(*keys, "n_words", F.size(every).cast("bigint").alias("n_base"),
                       F.array_min(every).cast("bigint").alias("first_word"),
                       F.array_max(every).cast("bigint").alias("last_word"), base.alias("base_labels"), "_spdx")
    found = scan(docs, templates).groupBy("_row", "_sum").agg(
        F.collect_set("label").alias("_labels"), F.max("cover").alias("_cover"))
    rows = rows.join(found, ["_row", "_sum"], "left")
    none = F.array().cast("array<string>")
    base = F.array_remove(F.split("base_labels", ","), "")
    labels = F.array_sort(F.array_union(F.array_union(base, F.col("_spdx")), F.coalesce("_labels", none)))
    told = (F.col("n_base") > 0) | (F.size("_spdx") > 0)
    score = F.greatest(F.coalesce("_cover", F.lit(0.0)), F.when(told, 1.0).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                       F.array_join(labels, ",").alias("labels"), score.alias("score"))
