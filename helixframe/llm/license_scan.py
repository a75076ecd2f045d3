"""License scans by an exact set-similarity join (operator 5). Spark expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, lower_ascii, words

#: What stands between words: every ASCII character but letters and digits (after lower-casing).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Fixed phrases, their words, and their labels.
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}
#: Notices that the join looks for: label -> texts. Wordings of public licenses, and the
#: lines that name one. None has more words than the stride of its family (see ``FAMILIES``).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": (
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu affero general public license along with this program if not see https www gnu org licenses",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "available under the creative commons attribution sharealike 4 0 license"),
    "cc0-1.0": (
        "dedicated to the public domain under cc0 1 0 universal",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under cc0 1 0",
    ),
    "gpl-2.0": (
        "this work is licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages",
    ),
    "lgpl-3.0": (
        "licensed under the gnu lesser general public license version 3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    ),
    "mpl-2.0": (
        "subject to the terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ),
    "reserved": (
        "all rights reserved no part of this publication may be reproduced",
        "no part of this publication may be reproduced distributed or transmitted in any form or by any means including photocopying recording or other electronic or mechanical methods without the prior written permission of the publisher",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "zlib": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
}
#: Words that tell one license or version from another: a notice may not lack them.
NAMING = frozenset("0 1 2 3 4 affero apache attribution by cc cc0 commons creative gnu lesser mit mozilla nc noncommercial sa sharealike".split())
#: Families of templates by their words: (most words, words of a block). Blocks start every half block, so as
#: many words in a row as a template has at most lie in one block.
FAMILIES = ((25, 50), (80, 160))
#: Words up to which a notice must stand in as many words in a row.
SHORT = 11


def _is(word: str):
    return lambda w: w == word


def _block(width: int, vocabulary: Column):
    return lambda begin: F.struct(begin.alias("begin"), F.array_intersect(F.slice("words__", begin, width), vocabulary).alias("own"))


def _at_least(least: int):
    return lambda block: F.size(block["own"]) >= least


def _ranked(family: int, width: int, order: Column):
    """A block's family, its vocabulary words as sorted ranks, and all its words in a row."""
    ranks = lambda own: F.sort_array(F.transform(own, lambda w: F.array_position(order, w).cast("int")))
    return lambda block: F.struct(F.lit(family).alias("family"), ranks(block["own"]).alias("words"), F.slice("words__", block["begin"], width).alias("near"))


def _span(n: int) -> int:
    """Words in a row that a notice of n words must stand within: as many as it has, and a quarter more for
    longer ones."""
    return n if n <= SHORT else n + n // 4


def _starts(phrase: tuple[str, ...]) -> Column:
    """Places, from 0, where the phrase's words stand one after the other in words__."""
    size = F.size("words__") - len(phrase) + 1
    joined = [F.slice("words__", at + 1, F.greatest(size, F.lit(0))) for at in range(len(phrase))]
    flags = F.transform(joined[0], lambda w: w == phrase[0])
    for part, word in zip(joined[1:], phrase[1:]):
        flags = F.zip_with(flags, F.transform(part, _is(word)), lambda a, b: a & b)
    placed = F.filter(F.transform(flags, lambda ok, i: F.when(ok, i)), lambda i: i.isNotNull())
    there = F.array_contains("words__", phrase[0])
    for word in phrase[1:]:
        there = there & F.array_contains("words__", word)
    return F.when(there, placed).otherwise(F.expr("cast(array() as array<int>)"))


def _template_rows() -> list[tuple[int, str, int, list[str], int]]:
    """(number, label, family, sorted distinct words, span) of every template."""
    texts = [(label, text.split()) for label, some in TEMPLATES.items() for text in some]
    family = lambda own: next(f for f, (most, _) in enumerate(FAMILIES) if len(own) <= most)
    return [(i, label, family(own), sorted(set(own)), _span(len(own))) for i, (label, own) in enumerate(texts)]


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", containment: float = 0.8) -> DataFrame:
    """The ``keep`` columns, then n_words, n_base, first_word, last_word, base_labels, labels, score, contained
    and containment. ``labels`` is stricter than the join's threshold; ``contained`` has all that meets it.

    Base labels come from fixed phrases standing word by word. The others come from a
    set-similarity join: a text is cut into overlapping blocks of words, and each block that holds at
    least ``containment`` of a template's distinct words is found. Labels of all of those are ``contained``, the largest
    share of words is ``containment``. A notice counts for ``labels`` if moreover as many of its words stand
    together (within ``_span`` words in a row), and all of them that are in ``NAMING`` with them: scattered
    words are no notice. Blocks are as long as the family of a template asks for. The
    join is exact. Words of templates are ordered by the number of texts that hold them, rarest
    first, over all texts; the rarest words of a template, as many as it may lack and one more,
    must include one of the block's first words (prefix filter), the block must hold
    enough template words (length filter) and enough after the first common one
    (positional filter); what remains is checked on the whole sets.

    ``score`` is 1 if a base label is there, else the largest share of words of a notice that counts,
    else 0. A null or empty text has no words and no labels (empty strings). Texts of any
    length are scanned whole. Repeated rows count each on its own.
    """
    spark, store = docs.sparkSession, Scratch(docs.sparkSession)
    templates = _template_rows()
    vocabulary = sorted({w for *_, own, _ in templates for w in own})
    taken = docs.select(*[F.col(c).alias(f"keep__{i}") for i, c in enumerate(keep)], words(lower_ascii(F.col(text)), BETWEEN).alias("words__"))
    array = lambda items: F.split(F.lit(" ".join(items)), " ")
    # one row a vocabulary word; the vocabulary is that of the fixed templates
    held = taken.select(F.explode(F.array_intersect("words__", array(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in held.collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    sides = []
    for i, label, family, own, span in templates:
        ranks = sorted(rank[w] for w in own)
        need = math.ceil(containment * len(ranks) - 1e-9)
        sides += [(i, label, family, ranks, need, ranks[at], at) for at in range(len(ranks) - need + 1)]
    prefixes = spark.createDataFrame(sides, "template int, label string, family int, ranks array<int>, need int, rank int, at int")
    wordings = spark.createDataFrame([(i, own, [w for w in own if w in NAMING], span) for i, *_, own, span in templates], "template int, own array<string>, named array<string>, span int")

    # blocks as sorted ranks of their template words, only of texts with a prefix word of the family
    cut = []
    for family, (_, width) in enumerate(FAMILIES):
        mine = [side for side in sides if side[2] == family]
        first, least = array([order[r - 1] for r in sorted({side[5] for side in mine})]), min(side[4] for side in mine)
        begins = F.sequence(F.lit(1), F.greatest(F.size("words__"), F.lit(1)), F.lit(width // 2))
        blocks = F.transform(begins, _block(width, array(order)))
        ranked = F.transform(F.filter(blocks, _at_least(least)), _ranked(family, width, array(order)))
        cut.append(F.when(F.arrays_overlap("words__", first), ranked).otherwise(F.expr("cast(array() as array<struct<family: int, words: array<int>, near: array<string>>>)")))
    rows = taken.withColumn("n_words", F.size("words__").cast("long"))
    for label, phrase in PHRASES.items():
        rows = rows.withColumn(f"at__{label}", _starts(phrase))
    rows = rows.withColumn("blocks__", F.concat(*cut)).drop("words__")
    at = [F.col(f"at__{label}") for label in PHRASES]
    smallest = F.array_min(F.concat(*at)).cast("long")
    largest = F.array_max(F.concat(*at)).cast("long")
    base = F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in zip(PHRASES, at)]), lambda x: x.isNotNull())
    rows = rows.select(*[f"keep__{i}" for i in range(len(keep))], "n_words", F.size(F.concat(*at)).cast("long").alias("n_base"), smallest.alias("first_word"), largest.alias("last_word"), base.alias("base__"), "blocks__")
    rows = store.cut(rows.withColumn("row__", F.monotonically_increasing_id()))

    blocks = rows.select("row__", F.posexplode("blocks__").alias("block", "own")).select("row__", "block", "own.family", "own.words")
    entries = blocks.select("row__", "block", "family", "words", F.size("words").alias("size"), F.posexplode("words").alias("place", "rank"))
    # prefixes come from the fixed templates: a few hundred rows, always safe to broadcast
    pairs = entries.join(F.broadcast(prefixes), ["rank", "family"]).filter("size >= need AND place <= size - need AND least(size - place, size(ranks) - at) >= need")
    found = F.size(F.array_intersect("words", "ranks"))
    met = pairs.withColumn("found", found).filter("found >= need").select("row__", "block", "template", "label", "need", (F.col("found") / F.size("ranks")).alias("share")).distinct()
    near = rows.select("row__", F.posexplode("blocks__").alias("block", "x")).select("row__", "block", "x.near")
    # one row a template
    told = met.join(F.broadcast(wordings), "template").join(near, ["row__", "block"])
    begins = F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("span") + 1, F.lit(1)))
    held = lambda at: F.slice("near", at, F.col("span"))
    together = F.exists(begins, lambda at: (F.size(F.array_intersect("own", held(at))) >= F.col("need")) & (F.size(F.array_except("named", held(at))) == 0))
    told = told.withColumn("told", F.when(together, F.col("label")))
    hits = told.groupBy("row__").agg(F.collect_set("told").alias("own__"), F.max(F.when(F.col("told").isNotNull(), F.col("share"))).alias("best__"), F.collect_set("label").alias("met__"), F.max("share").alias("share__"))
    none = F.expr("cast(array() as array<string>)")
    labels = F.array_sort(F.array_union("base__", F.coalesce("own__", none)))
    score = F.when(F.size("base__") > 0, 1.0).otherwise(F.coalesce("best__", F.lit(0.0)))
    out = rows.drop("blocks__").join(hits, "row__", "left")
    return out.select(*[F.col(f"keep__{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base__"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.array_join(F.array_sort(F.coalesce("met__", none)), ",").alias("contained"), F.coalesce("share__", F.lit(0.0)).alias("containment"))
