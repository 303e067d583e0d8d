"""Licence scan by a positional index of rare words (operator 1); DataFrame functions only.

Every template is a passage of a licence with a mandatory key phrase in it. The inverse document frequencies of the
key words over all documents give each template's rarest one, under which the index holds the template and the word's
offset in it. The highest-IDF words of a file are looked up there: each of their places, less the offset in the posting,
proposes a start of the passage; the words at the same relative positions must agree with the whole key phrase, and the
rest of the passage is scored. A file that holds a key phrase holds its rarest word, so none is missed. Index and
templates are two constants, so the plan doesn't grow with the number of templates.

Null and empty texts have no words and score 0. Ties in frequency go to the word that sorts first; the choice
of word changes the cost only. Rows are judged one by one: repeated rows give equal rows, an empty table an empty one,
and a very long text is one row, read whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Letters, digits and whatever is not ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Label, passage of the licence, its mandatory key phrase.
TEMPLATES = [
    ("mit", "mit license", "mit license"),
    ("apache", "apache license", "apache license"),
    ("gpl", "general public license", "general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: The first templates are the base phrases.
N_BASE = 3


def words_of(text: Column) -> Column:
    # The Kelvin sign is the one letter outside ASCII whose lower case is in A-Z.
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("ÿ"))), F.lit(WORD), F.lit(0))


def _parts(template):
    label, passage, key = template
    p, k = passage.split(" "), key.split(" ")
    at = next(i for i in range(len(p)) if p[i : i + len(k)] == k)
    return label, p, k, at


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each licence word occurs; one number per word of the templates comes to the driver."""
    present = F.array_distinct(F.filter(words_of(text_of()), lambda w: w.isin(vocabulary)))
    return {r["word"]: r["n"] for r in docs.select(F.explode(present).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, templates=TEMPLATES, n_base: int = N_BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    score: the largest share of a verified template's passage that stands in place; 0 without any.
    """
    parsed = [_parts(t) for t in templates]
    frequency = document_frequencies(docs, sorted({w for _, _, k, _ in parsed for w in k}))
    index: dict[str, list[Column]] = {}
    for t, (_, _, key, at) in enumerate(parsed):
        rarest = min(range(len(key)), key=lambda k: (frequency.get(key[k], 0), key[k]))
        index.setdefault(key[rarest], []).append(F.struct(F.lit(t).alias("t"), F.lit(at + rarest).alias("offset")))
    postings = F.create_map(*[c for word, found in index.items() for c in (F.lit(word), F.array(*found))])
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, p)).alias("passage"), F.lit(at).alias("at"), F.lit(at + len(k) - 1).alias("to")) for label, p, k, at in parsed])
    template = lambda h, field: F.get(table, h["t"])[field]
    agrees = lambda h, k: F.get("w", h["start"] + k).eqNullSafe(F.get(template(h, "passage"), k))

    rows = docs.select("doc_id", words_of(text_of()).alias("w"))
    n = F.size("w")
    # Places of the looked-up words, from 0, and the starts of passages that they propose.
    places = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("w"), i).isin(sorted(index)))).otherwise(F.array().cast("array<int>"))
    proposed = F.flatten(F.transform(places, lambda i: F.transform(postings[F.get(F.col("w"), i)], lambda x: F.struct(x["t"].alias("t"), (i - x["offset"]).alias("start")))))
    rows = rows.select("doc_id", "w", proposed.alias("h"))
    whole = F.filter("h", lambda h: F.forall(F.sequence(template(h, "at"), template(h, "to")), lambda k: agrees(h, k)))
    found = rows.select("doc_id", "w", whole.alias("h"))

    def share(h) -> Column:
        length = F.size(template(h, "passage"))
        return F.size(F.filter(F.sequence(F.lit(0), length - 1), lambda k: agrees(h, k))) / length

    def labels(hits) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: template(h, "label")))), ",")

    base_hits = F.filter("h", lambda h: h["t"] < n_base)
    base = F.array_sort(F.transform(base_hits, lambda h: h["start"] + template(h, "at")))
    return found.select(
        F.col("doc_id"),
        F.size("w").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.get(base, F.lit(0)).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        labels(base_hits).alias("base_labels"),
        labels(F.col("h")).alias("labels"),
        F.coalesce(F.array_max(F.transform("h", share)), F.lit(0.0)).alias("score"),
    )


def oracle(templates=TEMPLATES, n_base: int = N_BASE) -> str:
    """The same rows in DuckDB's SQL, from every word of every text."""
    parsed = [_parts(t) for t in templates]
    cols = []
    for t, (_, _, key, _) in enumerate(parsed):
        test = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(key))
        cols.append(f"list_filter(range(len(w)), lambda i: coalesce({test}, false)) AS s{t}")
    label = lambda m: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len(s{t}) > 0 THEN '{x[0]}' END" for t, x in enumerate(parsed[:m])) + "], lambda x: x IS NOT NULL))), ',')"
    shares = []
    for t, (_, passage, _, at) in enumerate(parsed):
        hits = " + ".join(f"(CASE WHEN i >= {at - k} AND w[i + {k - at + 1}] = '{word}' THEN 1 ELSE 0 END)" for k, word in enumerate(passage))
        shares.append(f"coalesce(list_max(list_transform(s{t}, lambda i: ({hits}) / {float(len(passage))!r}::DOUBLE)), 0)")
    base = "list_sort(" + " || ".join(f"s{t}" for t in range(n_base)) + ")"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{re.sub(r"x", "x", WORD)}') AS w FROM documents),
f AS (SELECT doc_id, w, {", ".join(cols)} FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, len({base})::BIGINT AS n_base, ({base})[1]::BIGINT AS first_word, list_max({base})::BIGINT AS last_word,
  {label(n_base)} AS base_labels, {label(len(parsed))} AS labels, greatest({", ".join(shares)})::DOUBLE AS score
FROM f"""
