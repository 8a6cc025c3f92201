"""Licence scans: Dice coefficient over word bigrams, in native operations.

A text is normalised to words of a-z and 0-9, line breaks and marks being
spaces, and its runs of neighbouring words are compared with templates of
licence notices: ``2 common / (run + template)``, where ``common`` counts the
template's distinct bigrams in the run, ``run`` the bigrams of the run and
``template`` the template's distinct bigrams.  The best run of each template
counts, wherever it stands and however the notice is wrapped.

Bounds prune without loss: a run that reaches the threshold has between
``least`` and ``most`` bigrams, and the best one begins and ends with bigrams
of the template.  So of a text only the places of template bigrams go on, and
of these only where ``least`` of one template stand close enough together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices as their licences word them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]


def template_rows(templates: list[tuple[str, str]], percent: int) -> list[tuple[str, int, int, int, int, str]]:
    """``(licence, template, size, least, most, bigram)`` for every bigram of
    every template; ``least`` and ``most`` bound the size of a run that can reach
    ``percent``: the common part is as large as the smaller of both at most."""
    rows = []
    for k, (name, text) in enumerate(templates):
        words = re.findall("[a-z0-9]+", text.lower())
        grams = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        n = len(grams)
        rows += [(name, k, n, -(-percent * n // (200 - percent)), (200 - percent) * n // percent, g) for g in grams]
    return rows


def bigrams(words: Column, first_words: list[str]) -> Column:
    """The pairs of neighbouring words in lower case, in order; null where the
    first is none of ``first_words``."""
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(words, after, lambda a, b: F.when(F.lower(a).isin(first_words), F.lower(F.concat(a, F.lit(" "), b))))


def best_dice(places: Column, size: Column, least: Column, most: Column) -> Column:
    """The greatest coefficient of a run.  ``places`` has ``struct<at, gram>`` of
    the template's bigrams in a text, in order; linear in their count, as a run
    has at most ``most`` bigrams."""

    def of_start(i: Column) -> Column:
        start = F.get(places, i)["at"]

        def step(state: Column, x: Column) -> Column:
            count = F.size(state["seen"]) + 1
            dice = 2 * count / (x["at"] - start + 1 + size)
            wider = F.struct(F.greatest(state["best"], dice).alias("best"), F.array_append(state["seen"], x["gram"]).alias("seen"))
            return F.when((x["at"] - start >= most) | F.array_contains(state["seen"], x["gram"]), state).otherwise(wider)

        empty = F.struct(F.lit(0.0).alias("best"), F.array().cast("array<string>").alias("seen"))
        return F.aggregate(F.slice(places, i + 1, most), empty, step, lambda state: state["best"])

    n = F.size(places)
    starts = F.when(n >= least, F.sequence(F.lit(0), n - least)).otherwise(F.array().cast("array<int>"))
    dense = F.filter(starts, lambda i: F.get(places, i + least - 1)["at"] - F.get(places, i)["at"] < most)
    return F.coalesce(F.array_max(F.transform(dense, of_start)), F.lit(0.0))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, percent: int = 75) -> DataFrame:
    """One row for each id: ``n_matches`` (templates of which a run reaches
    ``percent``), ``license`` and ``dice`` of the best (then the larger template,
    then the first name; null and 0 without a match) and ``licenses`` (all
    names found, sorted, comma-joined).

    Null or empty text: no match.  Texts of any length are read whole.  Rows of
    one id are one document; null ids are one document too.  Further columns
    are not read.  Empty input: no rows.
    """
    rules = template_rows(templates, percent)
    known = docs.sparkSession.createDataFrame(rules, "name string, template int, size int, least int, most int, gram string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = sorted({r[-1] for r in rules})
    words = rows.select("doc_id", F.sha2("text", 256).alias("of"), F.split("text", "[^A-Za-z0-9]+").alias("words"))
    grams = bigrams(F.col("words"), sorted({g.split()[0] for g in every}))
    each = words.select("doc_id", "of", F.posexplode(grams).alias("at", "gram")).filter(F.col("gram").isin(every)).distinct()
    met = each.join(F.broadcast(known), "gram")  # as many rows as the templates have bigrams
    lists = met.groupBy("doc_id", "of", "template", "name", "size", "least", "most").agg(F.sort_array(F.collect_list(F.struct("at", "gram"))).alias("places"))
    dice = F.round(best_dice(F.col("places"), F.col("size"), F.col("least"), F.col("most")), 6)
    # least far first: the greatest (dice, size), then the least name
    found = lists.select("doc_id", "template", dice.alias("dice"), "size", "name").filter(F.col("dice") * 100 >= percent - 1e-4)
    found = found.select("doc_id", "template", F.struct((-F.col("dice")).alias("far"), (-F.col("size")).alias("less"), "name").alias("rank"))
    told = found.union(rows.select("doc_id", F.lit(None), F.lit(None)).distinct())
    out = told.groupBy("doc_id").agg(F.count_distinct("template").alias("n_matches"), F.min("rank").alias("r"), F.array_join(F.sort_array(F.collect_set("rank.name")), ",").alias("licenses"))
    return out.select("doc_id", "n_matches", F.col("r.name").alias("license"), F.coalesce(-F.col("r.far"), F.lit(0.0)).alias("dice"), "licenses")
