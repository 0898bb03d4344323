"""Licence notices in documents, by MinHash bands over text windows.

A template is its set of five-word shingles.  ``ROWS * BANDS`` hash functions each pick the template's smallest shingle; a
window of a document collides with the template in a band if it holds the shingles that the band's functions picked.  A
window with share c of the template's shingles holds a given one with probability c, so at the required containment of 0.8
and bands of two, all 16 bands fail with probability (1 - 0.64) ** 16 < 1e-7, and that is the only way to miss a
template.  Windows are a quarter longer than the template and overlap by four fifths, so each occurrence lies in one whole.
Candidates are verified by exact containment of the shingles.

Words are runs of letters and digits, lower-cased: comment signs and line breaks don't count.  Null, empty and shorter texts
match nothing, as do templates of fewer than five words; repeated rows give one row; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.llm.common import bounded, let, row_key, token_hashes
from lobwright.sources.stages import cut

SHINGLE = 5
CONTAINMENT = 0.8
ROWS, BANDS = 2, 16

#: Notices of public licences.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
                  "OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met:",
}


def shingles(tokens: Column) -> Column:
    """Hashes of the runs of five tokens, by position."""
    return F.when(F.size(tokens) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(tokens) - SHINGLE), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)])))


def _signature(templates: DataFrame) -> DataFrame:
    """(hash, template, picked, ...): bit k of ``picked`` says that function k picks this shingle of the template."""
    functions = ROWS * BANDS
    each = templates.select("template", "n", "stride", "width", F.explode("wanted").alias("hash")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(functions - 1))).alias("k"))
    least = each.groupBy("template", "k", "n", "stride", "width").agg(F.min_by("hash", F.struct(F.xxhash64("k", "hash"), "hash")).alias("hash"))
    return least.groupBy("hash", "template", "n", "stride", "width").agg(
        F.bit_or(F.expr("shiftleft(1L, k)")).alias("picked"))


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, template, start, words, found, wanted): the best window of each document and template.

    ``docs`` has doc_id and text, ``templates`` template and text.  ``start`` and ``words`` give the window in words, ``found`` of
    ``wanted`` shingles are in it.  Documents are read twice: their shingles against the templates' picked ones (counted,
    then broadcast), then those with candidates only, to verify.
    """
    size = F.size("wanted")
    known = bounded(templates.select("template", F.array_distinct(let(token_hashes(F.col("text")), shingles)).alias("wanted")).where(
        "wanted is not null").select("template", "wanted", size.alias("n"), F.ceil(size / 4).cast("int").alias("stride"),
                                     (size + F.ceil(size / 4)).cast("int").alias("width")).distinct(), name="templates")
    picked = bounded(_signature(known), name="template_picks")
    found = docs.select(row_key().alias("key"), F.posexplode(let(token_hashes(F.col("text")), shingles)).alias("pos", "hash"))
    anchors = found.join(picked, "hash")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("width") + 1) / F.col("stride"))).cast("int")
    windows = anchors.select("key", "template", "n", "stride", "width", "picked", F.explode(
        F.sequence(first, F.floor(F.col("pos") / F.col("stride")).cast("int"))).alias("window"))
    held = windows.groupBy("key", "template", "stride", "width", "window").agg(F.bit_or("picked").alias("held"))
    band = sum(1 << (ROWS * b) for b in range(BANDS))
    full = F.col("held").bitwiseAND(F.shiftrightunsigned("held", 1)).bitwiseAND(F.lit(band)) != 0
    candidates = cut(held.where(full).groupBy("key", "template", "stride", "width").agg(
        F.collect_set("window").alias("windows")), "license_windows")
    wanted = bounded(candidates.select("key").distinct(), name="license_documents")
    texts = docs.select(row_key().alias("key"), "doc_id", "text").join(wanted, "key", "left_semi").select(
        "key", "doc_id", let(token_hashes(F.col("text")), shingles).alias("own"))
    tested = texts.join(candidates, "key").join(known.select("template", "wanted", "n"), "template").select(
        "doc_id", "template", "n", F.array_max(F.transform("windows", lambda w: F.struct(
            F.size(F.array_intersect(F.slice("own", w * F.col("stride") + 1, F.col("width")), F.col("wanted"))).alias("found"),
            (-w * F.col("stride")).alias("before"), F.col("width").alias("width")))).alias("best"))
    least = F.ceil(CONTAINMENT * F.col("n"))
    return tested.where(F.col("best.found") >= least).groupBy("doc_id", "template", "n").agg(F.max("best").alias("best")).select(
        "doc_id", "template", (-F.col("best.before")).alias("start"), (F.col("best.width") + SHINGLE - 1).alias("words"),
        F.col("best.found").alias("found"), F.col("n").alias("wanted"))
