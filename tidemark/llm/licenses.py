"""License scans with a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

from functools import partial
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels (fixed values).
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices to look for: label, whole notice, phrase that must stand in it (fixed values).
TEMPLATES = (
    ("mit-notice", "released under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge",
    ),
    (
        "apache-2.0-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2 0",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software",
    ),
)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, for comparison with ASCII words.

    Other letters may be lowered too, which makes no ASCII word of them; the
    one sign that would become an ASCII letter takes the slower way.
    """
    upper = "".join(map(chr, range(65, 91)))
    return F.when(text.contains("K"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _stands(words: str, at: Column, phrase: list[str]) -> Column:
    found = F.get(words, at) == phrase[0]
    for i, w in enumerate(phrase[1:], 1):
        found = found & (F.get(words, at + i) == w)
    return found


def _places(holds) -> Column:
    """Indices of ``words`` where ``holds`` is true."""
    every = F.sequence(F.lit(0), F.size("words") - 1)
    return F.filter(every, lambda i: F.coalesce(holds(at=i), F.lit(False)))


def _starts(posting: list[tuple[str, int]]) -> Column:
    """Places where a template can start: the postings of its words, brought to relative position and intersected."""
    at = lambda w, q: F.transform(F.filter("hits", lambda x: x["w"] == w), lambda x: x["i"] - q)
    lists = [at(w, q) for w, q in posting]
    out = lists[0]
    for other in lists[1:]:
        out = F.array_intersect(out, other)
    return out


def _share(d: Column, notice: list[str], phrase: list[str], key: int) -> Column:
    """Share of the template's words in place at start ``d``; 0 if the phrase does not stand."""
    inside = lambda i: F.when(d + i >= 0, F.get("words", d + i))
    hits = sum((F.when(inside(i) == w, 1).otherwise(0) for i, w in enumerate(notice)), F.lit(0))
    whole = F.coalesce((d + key >= 0) & _stands("words", d + key, phrase), F.lit(False))
    return F.when(whole, hits / F.lit(float(len(notice)))).otherwise(0.0)


def license_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, anchors: int = 3, least: float = 0.6
) -> DataFrame:
    """One row per document with its licence words, base places, labels and score.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered.
    IDF of every template word is counted over all documents.  A file's words
    that are among the ``anchors`` rarest of a template's mandatory phrase are
    looked up once and posted with their places.  Each posting, less the
    word's place in the template, is a set of places where the template can
    start; the sets of its anchors are intersected.  As the whole phrase is
    mandatory, no place that would pass is missed.  At what is left the phrase
    is verified and the share of the template's words in place is the score.  A
    label needs a share of ``least``.  Base phrases are searched word by word.
    score is the best share of an accepted template, and 1 where a base phrase stands.

    A null or empty text has no words, null places, empty labels and score 0.
    Repeated rows are scanned each; other columns are ignored.  Everything but
    the word counts (at most one row per template word) happens within a row:
    no shuffle, no group.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), _WORD_GAP), "").alias("words"),
    )
    split = [(label, notice.split(), phrase.split()) for label, notice, phrase in templates]
    vocabulary = sorted({w for _, notice, _ in split for w in notice})
    seen = rows.select(
        F.explode(F.concat(F.array_intersect("words", F.array(*map(F.lit, vocabulary))), F.array(F.lit("")))).alias("w")
    )
    df = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most one row per template word
    idf = {w: log((1 + df.get("", 0)) / (1 + df.get(w, 0))) for w in vocabulary}
    rare = {label: sorted(set(phrase), key=lambda w: (-idf[w], w))[:anchors] for label, _, phrase in split}
    posted = sorted({w for own in rare.values() for w in own})
    first = sorted({own[0] for own in rare.values()})  # a file without any of these holds no template
    some = F.arrays_overlap("words", F.array(*map(F.lit, first)))
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.withColumn("hits", F.when(some, F.filter(pairs, lambda x: F.array_contains(F.array(*map(F.lit, posted)), x["w"]))))

    none = F.array().cast("array<int>")
    for phrase, label in BASE_PHRASES.items():
        here = F.when(F.array_contains("words", "license"), _places(partial(_stands, "words", phrase=phrase.split())))
        rows = rows.withColumn(f"_{label}", F.coalesce(here, none))

    shares = []
    for number, (label, notice, phrase) in enumerate(split):
        key = next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)
        posting = [(w, key + q) for q, w in enumerate(phrase) if w in rare[label]]
        share = partial(_share, notice=notice, phrase=phrase, key=key)
        present = F.array_contains(F.col("hits")["w"], rare[label][0])
        best = F.when(present, F.array_max(F.transform(_starts(posting), lambda d: share(d))))
        rows = rows.withColumn(f"_share{number}", F.coalesce(best, F.lit(0.0)))
        shares.append((label, f"_share{number}"))

    places = F.concat(*[F.col(f"_{label}") for label in BASE_PHRASES.values()])
    base = F.array_compact(F.array(*[F.when(F.size(f"_{x}") > 0, x) for x in BASE_PHRASES.values()]))
    own = F.array_compact(F.array(*[F.when(F.col(c) >= least, label) for label, c in shares]))
    best = F.greatest(*[F.when(F.col(c) >= least, F.col(c)).otherwise(0.0) for _, c in shares])
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(best).alias("score"),
    )


def oracle_sql(templates=TEMPLATES, least: float = 0.6) -> str:
    """The same scan in SQL, over all places where a template's phrase begins."""
    upper = "".join(map(chr, range(65, 91)))
    rows = ", ".join(
        f"('{label}', {notice.split()}, {phrase.split()}, {next(i for i in range(len(notice.split())) if notice.split()[i : i + len(phrase.split())] == phrase.split())})"
        for label, notice, phrase in templates
    )
    stands = {label: " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split())) for phrase, label in BASE_PHRASES.items()}
    lists = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: coalesce({cond}, false)) AS p_{label}" for label, cond in stands.items())
    every = "list_concat(" + "list_concat(p_mit, p_apache), p_gpl)"
    base = ", ".join(f"CASE WHEN len(p_{x}) > 0 THEN '{x}' END" for x in BASE_PHRASES.values())
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) v(label, notice, phrase, key)),
u AS (SELECT r, i, w[i + 1] AS x FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d)),
start AS (SELECT DISTINCT r, label, i - key AS s FROM u JOIN t ON x = phrase[1]),
share AS (SELECT r, label, max(list_sum(list_transform(range(len(notice)), lambda q: CASE WHEN s + q >= 0 AND w[s + q + 1] = notice[q + 1] THEN 1 ELSE 0 END)) / len(notice)) AS best
  FROM start JOIN t USING (label) JOIN d USING (r)
  WHERE s + key >= 0 AND list_sum(list_transform(range(len(phrase)), lambda j: CASE WHEN w[s + key + j + 1] = phrase[j + 1] THEN 1 ELSE 0 END)) = len(phrase) GROUP BY ALL),
own AS (SELECT r, list(label) AS labels, max(best) AS best FROM share WHERE best >= {least}::DOUBLE GROUP BY r),
b AS (SELECT r, doc_id, len(w) AS n_words, {lists} FROM d),
c AS (SELECT *, {every} AS every, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM b)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(every) > 0 THEN 1 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM c LEFT JOIN own USING (r)"""
