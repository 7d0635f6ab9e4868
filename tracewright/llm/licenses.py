"""License scans: base phrases and licence headers, found by a positional index of the rarest words of their key phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between the words of a text, and the base phrases with their labels.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Headers of well-known public licences, each with the phrase that has to stand at its place.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "you may not use this file except in compliance",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "modify it under the terms of the gnu general public license",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "under the terms of the gnu lesser general public license",
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "under the terms of the gnu affero general public license",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "subject to the terms of the mozilla public license"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software",
    ),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", "licensed under a creative commons attribution"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
)
#: Words of each key phrase that are in the index: its rarest ones, over all documents.
PROBES = 3
#: Words in place from which on a template's share is whole; fewer where it has fewer words.
ENOUGH = 12


def words_of(text: Column) -> Column:
    """The words of a text, in lower case, with an empty one at an end that isn't a word.

    Letters past ASCII are lowered too, which moves no word's end and makes no base phrase.
    """
    return F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1)


def rarity(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> list[str]:
    """The words of the key phrases, the rarest first: by the number of documents that have them, over all documents.

    Ties go by the alphabet. One row a word of the vocabulary comes to the driver.
    """
    own = docs.select(F.explode(F.array_intersect(words_of(F.col(text_col).cast("string")), F.lit(vocabulary))).alias("word"))
    seen = {r["word"]: r["n"] for r in own.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _offset(text: str, key: str) -> int:
    words, part = text.split(), key.split()
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def postings(templates, rank: list[str], probes: int = PROBES) -> list[list[tuple[str, int]]]:
    """The index: for each template the rarest words of its key phrase with their places in the template, rarest first."""
    at = {w: i for i, w in enumerate(rank)}
    out = []
    for _, text, key in templates:
        begin, seen = _offset(text, key), {}
        for i, w in enumerate(key.split()):
            seen.setdefault(w, begin + i)
        out.append([(w, seen[w]) for w in sorted(seen, key=at.__getitem__)[:probes]])
    return out


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _starts(words: Column, posted: list[tuple[str, int]], text: str, key: str) -> Column:
    """Where a template would begin: its rarest word's places, kept where the others stand at their relative positions,
    and where the whole key phrase then stands."""
    (rare, place), *others = posted
    begin = F.filter(F.transform(words, lambda w, i: F.when(w == rare, i - place)), lambda s: s.isNotNull())
    met = F.filter(begin, lambda s: _all([F.coalesce(F.get(words, s + p) == w, F.lit(False)) for w, p in others])) if others else begin
    offset, size = _offset(text, key), len(key.split())
    phrase = lambda s: F.array_join(F.slice(words, F.greatest(s + offset, F.lit(0)) + 1, F.lit(size)), " ")
    return F.filter(met, lambda s: (s + offset >= 0) & (phrase(s) == key))


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, hits): base phrase places and template hits of every whole text.

    base: array<struct<start, label>>, by start. hits: array<struct<label, at, agree, share>>: the template would begin at
    word ``at`` (negative where the file begins within it), ``agree`` of all its words stand where it has them, ``share`` is
    that of ENOUGH words, 1 at most. Base phrases are templates that consist of their key phrase.

    All files are looked up: of each file's words those of the index are taken, which are the rarest PROBES words of every
    template's own key phrase, so that one template's words can't displace another's. A template is a candidate of a file
    that has all its index words; their places are intersected by relative position, the whole key phrase is verified, and
    the rest of the template is counted word by word. As the key phrase is mandatory, nothing that has it is lost, whatever
    other words the file has or lacks. Every place is a hit of its own; ties in rarity go by the alphabet.

    Null is taken as empty; an empty text has no words. Texts may be of any length. Repeated rows are repeated; an empty
    table gives an empty one; other columns aren't read.
    """
    every = [(label, phrase, phrase) for phrase, label in PHRASES] + list(templates)
    rank = rarity(docs, sorted({w for _, _, key in every for w in key.split()}), text_col)
    index = postings(every, rank)
    lookup = F.lit(sorted({w for posted in index for w, _ in posted}))
    texts = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    first = (F.get("words", F.lit(0)) == "").cast("int")
    last = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    texts = texts.select("doc_id", "words", first.alias("lead"), (F.size("words") - first - last).cast("long").alias("n_words"), F.array_intersect("words", lookup).alias("own"))

    def found(t: int) -> Column:
        _, text, key = every[t]
        has = _all([F.array_contains("own", w) for w, _ in index[t]])
        return F.when(has, _starts(F.col("words"), index[t], text, key)).otherwise(F.array().cast("array<int>"))

    def places(t: int, label: str) -> Column:
        return F.transform(found(t), lambda s: F.struct((s - F.col("lead")).alias("start"), F.lit(label).alias("label")))

    base = F.concat(*(places(t, label) for t, (_, label) in enumerate(PHRASES)))

    def hits(t: int) -> Column:
        label, text, _ = every[t]
        body = text.split()
        agree = lambda s: F.size(F.filter(F.transform(F.lit(body), lambda w, i: F.get("words", s + i) == w), lambda same: same))
        counted = F.transform(found(t), lambda s: F.struct(F.lit(label).alias("label"), (s - F.col("lead")).alias("at"), agree(s).alias("agree")))
        return F.transform(counted, lambda h: F.struct(h["label"].alias("label"), h["at"].alias("at"), h["agree"].alias("agree"), F.least(F.lit(1.0), h["agree"] / F.lit(min(ENOUGH, len(body)))).alias("share")))

    return texts.select("doc_id", "n_words", F.array_sort(base).alias("base"), F.array_sort(F.concat(*map(hits, range(len(PHRASES), len(every))))).alias("hits"))


def licenses(docs: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, first and last base place, labels, and the score (1 with a base phrase, else the best share)."""
    out = scan(docs)
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("hits", lambda h: h["label"]))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.size("hits").cast("long").alias("n_hits"))
