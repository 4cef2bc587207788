"""Licence scan over a positional index of rare licence words, in DataFrame functions only.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. The fixed phrases
are counted at every place where their words stand consecutively. Beyond them, all of a file's licence words
are looked up in the templates' postings; postings that agree on the relative position (file position less
template position) vote for a template at an offset, and a template is reported if its mandatory key phrases
stand where that offset puts them, whatever else the file holds. The score counts the votes of the file's
licence words of the highest IDF (over all files).

Null or empty text: no words, no labels, score 0. Each row is a file of its own, whether its doc_id is null,
repeated or not. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import saved

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices (label, words of the notice, mandatory key phrases).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", ["gnu general public license", "either version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("copyright-notice", "copyright all rights reserved", ["all rights reserved"]),
]

# Every phrase above holds one of these; a file without any can have no label.
SIGNS = ["license", "general", "rights", "cc", "permission", "redistribution", "mozilla", "commons", "waived", "unencumbered"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _places(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def at(w, i):
        ok = w == first
        for j, x in enumerate(rest, 1):
            ok = ok & F.coalesce(F.try_element_at(words, i + F.lit(j + 1)) == x, F.lit(False))
        return F.when(ok, i.cast("long"))

    return F.filter(F.transform(words, at), lambda x: x.isNotNull())


def _vocabulary() -> list[str]:
    return sorted({w for _, words, _ in TEMPLATES for w in words.split()})


def scan_licenses(docs: DataFrame, rarest: int = 12, least_votes: int = 2) -> DataFrame:
    """One row per document: word count, places of the base phrases, labels and a score in 0..1.

    least_votes: so many different words must agree on an offset. rarest: so many of a file's licence words,
    those of the highest IDF, count for its score, never for its labels. The score is the greatest share of a
    template's words that agree among these (among all, where fewer than least_votes of these agree on any of
    the file's labels), or 1 where a base phrase stands.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    may = reduce(or_, (low.contains(w) for w in SIGNS))
    words = F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(f"({_WORD})"), F.lit(1)), F.array().cast("array<string>"))
    known = F.array(*map(F.lit, _vocabulary()))
    scanned = docs.select("doc_id", words.alias("every"), may.alias("may"))
    scanned = scanned.select("doc_id", F.size("every").cast("long").alias("n_words"), F.array_intersect("every", known).alias("has"), F.when(F.col("may"), F.col("every")).otherwise(F.array().cast("array<string>")).alias("words"))
    places = F.when(F.size("words") == 0, F.array().cast("array<array<bigint>>")).otherwise(F.array(*(_places(F.col("words"), p) for p in PHRASES)))
    base = scanned.withColumn("places", places).withColumn("all", F.flatten("places"))
    labels = F.array_compact(F.array(*(F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    base = base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "has", "words", F.size("all").cast("long").alias("n_base"), F.array_min("all").alias("first_word"), F.array_max("all").alias("last_word"), F.array_sort(labels).alias("base_set")
    )
    base = saved(base, "licenses")  # the only pass over the texts; its row numbers stay
    df = base.select(F.explode("has").alias("word")).groupBy("word").agg(F.count("*").alias("df"))  # over all files
    found = match_templates(base.where(F.size("words") > 0).select("row", "words", "has"), df, rarest, least_votes)
    out = base.drop("words", "has").join(found, "row", "left")
    both = F.array_sort(F.array_union("base_set", F.coalesce("method_set", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def match_templates(files: DataFrame, df: DataFrame, rarest: int, least_votes: int) -> DataFrame:
    """(row, method_set, share) of files (row, words, has: the licence words among them) by the positional index.

    The templates and their postings are constants of a few hundred rows, broadcast; df has at most the licence
    vocabulary. A file contributes only its licence words.
    """
    spark = files.sparkSession
    rows = [(t, label, w, p) for t, (label, words, _) in enumerate(TEMPLATES) for p, w in enumerate(words.split())]
    postings = spark.createDataFrame(rows, "template int, label string, word string, tpos int")
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: x["word"].isin(_vocabulary()))
    # the vocabulary's document frequencies: one row, one map
    table = df.agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("table")).withColumn("one", F.lit(1))
    used = files.select("row", hits.alias("hits"), "has", F.lit(1).alias("one")).join(F.broadcast(table), "one")
    rare = F.slice(F.array_sort(F.transform("has", lambda w: F.struct(F.try_element_at("table", w).alias("df"), w.alias("word")))), 1, rarest)
    used = used.select("row", "hits", rare.alias("rare")).select("row", "hits", F.col("rare.word").alias("rare"))
    looked = used.select("row", "rare", F.explode("hits").alias("h")).select("row", "h.word", F.col("h.pos").alias("pos"), F.array_contains("rare", F.col("h.word")).alias("scores"))
    votes = (
        looked.join(F.broadcast(postings), "word")
        .groupBy("row", "template", "label", (F.col("pos") - F.col("tpos")).alias("shift"))
        .agg(F.size(F.collect_set("word")).alias("votes"), F.size(F.collect_set(F.when(F.col("scores"), F.col("word")))).alias("rare_votes"))
        .where(F.col("votes") >= least_votes)
    )
    sizes = spark.createDataFrame([(t, len(set(w.split()))) for t, (_, w, _) in enumerate(TEMPLATES)], "template int, distinct_words int")
    full = F.least(F.lit(rarest), F.col("distinct_words"))
    votes = votes.join(F.broadcast(sizes), "template").withColumn("share", F.least(F.lit(1.0), F.col("votes") / full)).withColumn("rare_share", F.when(F.col("rare_votes") >= least_votes, F.least(F.lit(1.0), F.col("rare_votes") / full)))
    shifts = votes.groupBy("row").agg(F.collect_list(F.struct("template", "label", "shift", "share", "rare_share")).alias("votes"))
    kept = F.filter("votes", _verified)
    out = files.select("row", "words").join(shifts, "row").select("row", kept.alias("v")).where(F.size("v") > 0)
    return out.select("row", F.array_distinct("v.label").alias("method_set"), F.coalesce(F.array_max("v.rare_share"), F.array_max("v.share")).alias("share"))


def _verified(vote: Column) -> Column:
    """The template's key phrases stand in `words` where the vote's offset puts them."""
    ok = F.lit(False)
    for t, (_, words, keys) in enumerate(TEMPLATES):
        own, each = words.split(), vote["template"] == t
        for key in (k.split() for k in keys):
            at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
            for j, w in enumerate(key):
                place = vote["shift"] + (at + j)
                each = each & (place >= 0) & F.coalesce(F.get("words", place) == w, F.lit(False))
        ok = ok | each
    return ok


def oracle(rarest: int = 12, least_votes: int = 2) -> str:
    """DuckDB SQL of scan_licenses over documents."""
    postings = ", ".join(f"({t}, '{label}', '{w}', {p})" for t, (label, words, _) in enumerate(TEMPLATES) for p, w in enumerate(words.split()))
    keys = []
    for t, (_, words, phrases) in enumerate(TEMPLATES):
        own = words.split()
        for k in (p.split() for p in phrases):
            at = next(i for i in range(len(own)) if own[i : i + len(k)] == k)
            keys += [f"({t}, '{w}', {at + j})" for j, w in enumerate(k)]
    phrases = ", ".join(f"({i}, '{label}', '{w}', {j}, {len(p.split())})" for i, (p, label) in enumerate(PHRASES.items()) for j, w in enumerate(p.split()))
    one = "CAST(1 AS DOUBLE)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tok AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
ph(p, label, word, j, n) AS (VALUES {phrases}),
base AS (SELECT r, p, label, pos - j AS start FROM tok JOIN ph USING (word) GROUP BY r, p, label, n, pos - j HAVING count(*) = n),
b AS (SELECT r, count(*) AS n, min(start) AS f, max(start) AS l, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY r),
post(t, label, word, tpos) AS (VALUES {postings}), kw(t, word, off) AS (VALUES {", ".join(keys)}),
hit AS (SELECT r, word, pos FROM tok WHERE word IN (SELECT word FROM post)),
df AS (SELECT word, count(DISTINCT r) AS df FROM hit GROUP BY word),
rare AS (SELECT r, word FROM (SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY df, word) AS k FROM (SELECT DISTINCT r, word FROM hit) JOIN df USING (word)) WHERE k <= {rarest}),
votes AS (SELECT hit.r, t, label, pos - tpos AS shift, count(DISTINCT hit.word) AS v, count(DISTINCT rare.word) AS v_rare FROM hit JOIN post ON post.word = hit.word LEFT JOIN rare ON rare.r = hit.r AND rare.word = hit.word GROUP BY hit.r, t, label, pos - tpos HAVING count(DISTINCT hit.word) >= {least_votes}),
size AS (SELECT t, least({rarest}, count(DISTINCT word)) AS n FROM post GROUP BY t), kn AS (SELECT t, count(*) AS n FROM kw GROUP BY t),
ok AS (SELECT v.r, v.t, v.label, v.shift, v.v, v.v_rare FROM votes v JOIN kw ON kw.t = v.t JOIN tok ON tok.r = v.r AND tok.pos = v.shift + kw.off AND tok.word = kw.word JOIN kn ON kn.t = v.t GROUP BY v.r, v.t, v.label, v.shift, v.v, v.v_rare, kn.n HAVING count(*) = kn.n),
m AS (SELECT r, list(DISTINCT label) AS labels, coalesce(max(least({one}, CAST(v_rare AS DOUBLE) / n)) FILTER (v_rare >= {least_votes}), max(least({one}, CAST(v AS DOUBLE) / n))) AS share FROM ok JOIN size USING (t) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(b.n, 0) AS n_base, b.f AS first_word, b.l AS last_word, coalesce(list_aggregate(b.labels, 'string_agg', ','), '') AS base_labels,
  coalesce(list_aggregate(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), 'string_agg', ','), '') AS labels, CASE WHEN b.n > 0 THEN {one} ELSE coalesce(m.share, 0) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""
