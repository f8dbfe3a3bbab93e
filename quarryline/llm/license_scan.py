"""Licence notices in texts, by DataFrame operations alone.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.
Two findings are made:

* base: every place where the words of a licence's name stand in a row;
* the positional rare-token index over the templates below.  The inverse
  document frequency of every template word is counted over all documents.
  Every word's postings are its places in each template.  Of the template words
  that a file holds, those of highest frequency of that kind are looked up, and
  each posting and each place in the file give the place where the template
  would start.  Postings are intersected by that place: where two agree, the
  template is compared word by word, and counts if its mandatory phrases stand
  in place and at least ``least`` of its words agree.

So many words of a template are looked up as may disagree, and two more: at every
place that counts, two of them must stand, so the index loses none.  A template
is tried only in files that hold all words of its mandatory phrases.

The templates are constants of a few hundred words, so the index is part of the
expression that scans a file: a file is read twice (once to count, once to
scan) and never shuffled.  Only the counts of template words are.  Work on a file
grows with its length, also where a licence word fills a very long text.

Defined results: null and empty texts have no words, labels "" and score 0; a
repeated row (same id, same text) is reported as often as it occurs; a null id
is an id like any other; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# (label, template, mandatory phrases inside the template).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "released under the cc0 1 0 universal public domain dedication", ["cc0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["without warranties or conditions of any kind"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see", ["gnu general public license"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see", ["gnu lesser general public license"]),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program if not see", ["gnu affero general public license"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["will the authors be held liable"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
]
LEAST_AGREEING = 0.75  # of a template's words


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def word_idf(docs: DataFrame, text_column: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each template word over all documents."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    present = F.array_intersect(F.array(*map(F.lit, vocabulary)), words(F.col(text_column)))
    # The empty word counts the documents.
    counted = docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    df = {r["word"]: r["n"] for r in counted.collect()}
    return {w: log((1 + df.get("", 0)) / (1 + df.get(w, 0))) for w in vocabulary}


@dataclass(frozen=True)
class Entry:
    """A template in the index."""

    label: str
    body: list[str]
    by_idf: list[str]  # its words, rarest first
    places: dict[str, list[int]]  # postings: where each word stands
    look_up: int  # words to look up in a file
    votes: int  # postings that must agree on a start
    phrases: list[tuple[int, list[str]]]  # mandatory phrases and where they stand


def build_index(idf: dict[str, float], templates=TEMPLATES, least: float = LEAST_AGREEING) -> list[Entry]:
    index = []
    for label, text, phrases in templates:
        body = text.split()
        places = {w: [k for k, x in enumerate(body) if x == w] for w in body}
        must = [(next(k for k in range(len(body)) if body[k : k + len(p)] == p), p) for p in (p.split() for p in phrases)]
        agree, votes = ceil(least * len(body)), min(2, ceil(least * len(body)))
        index.append(Entry(label, body, sorted(places, key=lambda w: (-idf[w], w)), places, len(body) - agree + votes, votes, must))
    return index


def _strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(w: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words, from 0."""
    parts = phrase.split()
    last = F.size(w) - len(parts)
    at = lambda i: reduce(lambda a, b: a & b, [F.get(w, i + k) == F.lit(x) for k, x in enumerate(parts)])
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<int>"))


def best_share(occurrences: Column, w: Column, entry: Entry, least: float = LEAST_AGREEING) -> Column:
    """The share of a template's words that stand in place, at its best verified start; 0 without one."""
    size = len(entry.body)
    postings = F.create_map(*[x for word, at in entry.places.items() for x in (F.lit(word), F.array(*map(F.lit, at)))])

    def starts(chosen: Column) -> Column:
        looked_up = F.filter(occurrences, lambda o: F.array_contains(chosen, o["word"]))
        return F.array_sort(F.flatten(F.transform(looked_up, lambda o: F.transform(postings[o["word"]], lambda p: o["i"] - p))))

    def intersected(sorted_starts: Column) -> Column:
        """Each start from 0 on that enough postings agree on, once."""
        enough = lambda x, i: F.coalesce(F.get(sorted_starts, i + (entry.votes - 1)) == x, F.lit(False))
        first = lambda x, i: (i == 0) | (F.get(sorted_starts, i - 1) != x)
        return F.filter(sorted_starts, lambda x, i: (x >= 0) & first(x, i) & enough(x, i))

    def checked(at: Column) -> Column:
        held = reduce(lambda a, b: a & b, [F.slice(w, at + (k + 1), len(p)) == _strings(p) for k, p in entry.phrases])
        agreeing = F.size(F.filter(F.zip_with(F.slice(w, at + 1, size), _strings(entry.body), lambda a, b: a == b), lambda x: x))
        return F.when(held, agreeing / float(size)).otherwise(0.0)

    chosen = F.slice(F.array_intersect(_strings(entry.by_idf), F.transform(occurrences, lambda o: o["word"])), 1, entry.look_up)
    share = _let(chosen, lambda c: _let(starts(c), lambda s: F.array_max(F.transform(intersected(s), checked))))
    return F.when(share >= least, share).otherwise(0.0)


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """A row for each document: counts and places of base phrases, labels and a score.

    The score is the best share of a template's words found in place, 1 where a
    base phrase stands; 0 if nothing was found.
    """
    index = build_index(word_idf(docs, text_column, templates), templates)
    vocabulary = sorted({word for e in index for word in e.body})
    must = [sorted({word for _, p in e.phrases for word in p}) for e in index]
    required = sorted({word for m in must for word in m})
    ends = sorted({p.split()[-1] for p in base.values()})
    split = docs.select(F.col(id_column).alias("_id"), words(F.col(text_column)).alias("_w"))
    split = split.select("_id", "_w", F.arrays_overlap("_w", _strings(ends)).alias("_named"), F.array_intersect(_strings(required), F.col("_w")).alias("_m"))
    # The templates to try in a file, by number.
    tried = F.array_compact(F.array(*[F.when(F.size(F.array_except(_strings(m), F.col("_m"))) == 0, F.lit(k)) for k, m in enumerate(must)]))
    split = split.select("_id", "_w", "_named", tried.alias("_try"))
    at = F.filter(F.transform("_w", lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda o: o["word"].isin(vocabulary))
    nowhere = F.array().cast("array<int>")
    found = split.select(
        "_id", "_w", "_try", F.size("_w").cast("bigint").alias("n_words"), F.when(F.size("_try") > 0, at).alias("_o"),
        *[F.when(F.col("_named"), _places(F.col("_w"), p)).otherwise(nowhere).alias(f"_{k}") for k, p in base.items()],
    )
    shares = [F.when(F.array_contains("_try", k), best_share(F.col("_o"), F.col("_w"), e)).otherwise(0.0) for k, e in enumerate(index)]
    scored = found.select("_id", "n_words", F.concat(*[F.col(f"_{k}") for k in base]).alias("_p"), F.array_compact(F.array(*[F.when(F.size(f"_{k}") > 0, F.lit(k)) for k in base])).alias("_own"), F.array(*shares).alias("_s"))
    labels = F.filter(F.transform("_s", lambda x, i: F.when(x > 0, F.get(F.array(*[F.lit(e.label) for e in index]), i))), lambda x: x.isNotNull())
    return scored.select(
        F.col("_id").alias(id_column),
        "n_words",
        F.size("_p").cast("bigint").alias("n_base"),
        F.array_min("_p").cast("bigint").alias("first_word"),
        F.array_max("_p").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("_own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_own", labels))), ",").alias("labels"),
        F.when(F.size("_p") > 0, F.lit(1.0)).otherwise(F.array_max("_s")).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
