"""License scan through a positional index of rare licence words (SQL functions only).

A template is a licence line with one mandatory key phrase inside it. Document
frequencies of all template words are counted over the whole corpus; the word of
each key phrase with the highest IDF becomes its posting (word -> template,
offset). Each file's words are looked up in that index, every hit gives one
template start by its relative position, and the start stands only if the whole
key phrase is there. The share of template words found at their relative
positions is the hit's coverage. A phrase always holds its own rarest word, so
no place is missed, whatever the frequencies are.

Words: A-Z lower-cased, then runs of ASCII digits, ASCII letters and non-ASCII
characters. Null and empty texts have no words, no labels and score 0. Repeated
rows give a result each; columns other than doc_id and text are ignored; an
empty table gives an empty result. There is no shuffle but that of the word
frequencies, of at most as many rows as the templates have words.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # first word and number of words of the key phrase
    base: bool = False


def _t(label: str, before: str, key: str, after: str = "", base: bool = False) -> Template:
    b, k, a = before.split(), key.split(), after.split()
    return Template(label, (*b, *k, *a), (len(b), len(k)), base)


TEMPLATES = (
    _t("cc-by", "", "cc by", base=True),
    _t("gpl", "", "general public license", base=True),
    _t("reserved", "", "all rights reserved", base=True),
    _t("apache-2.0", "licensed under the", "apache license version 2 0"),
    _t("bsd", "", "redistribution and use in source and binary forms", "with or without modification are permitted"),
    _t("cc-by-nc", "licensed under", "cc by nc", "4 0"),
    _t("cc-by-sa", "licensed under", "cc by sa", "4 0"),
    _t("cc0", "released under", "cc0 1 0", "universal"),
    _t("gpl-3.0", "this work is licensed under the gnu", "general public license version 3"),
    _t("lgpl", "licensed under the", "gnu lesser general public license"),
    _t("mit", "released under the", "mit license"),
    _t("mit", "", "permission is hereby granted free of charge", "to any person obtaining a copy"),
    _t("mpl-2.0", "subject to the terms of the", "mozilla public license", "v 2 0"),
    _t("spdx", "", "spdx license identifier"),
)


def lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() also folds other letters, which stay word
    characters; of those only the Kelvin sign would become an ASCII letter."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def rare_words(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> dict[str, int]:
    """Number of files that hold each template word; at most one row a word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def license_hits(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and hits: array of (label, base, start, coverage), one for
    each place of a template's key phrase; start is the key phrase's first word."""
    df = rare_words(docs, templates)
    postings: dict[str, list[tuple[int, Template]]] = {}
    for t in templates:
        k, n = t.key
        at = min(range(k, k + n), key=lambda j: (df[t.words[j]], j))
        postings.setdefault(t.words[at], []).append((at, t))

    def probe(t: Template, at: int, words: Column, i: Column) -> Column:
        start = i - F.lit(at)
        word = lambda j: F.get(words, start + F.lit(j))
        same = [F.coalesce(word(j) == F.lit(w), F.lit(False)) for j, w in enumerate(t.words)]
        key = same[t.key[0]]
        for j in range(t.key[0] + 1, sum(t.key)):
            key = key & same[j]
        found = sum((s.cast("int") for s in same[1:]), same[0].cast("int"))
        hit = F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), (start + F.lit(t.key[0])).cast("long").alias("start"), (found.cast("double") / F.lit(float(len(t.words)))).alias("coverage"))
        return F.when(key, hit)

    def look_up(words: Column, i: Column) -> Column:
        w, out = F.get(words, i), None
        for anchor, entries in sorted(postings.items()):
            hits = F.array(*(probe(t, at, words, i) for at, t in entries))
            out = F.when(w == F.lit(anchor), hits) if out is None else out.when(w == F.lit(anchor), hits)
        return out

    anchors = sorted(postings)
    places = F.filter(F.transform(F.col("words"), lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    return (
        docs.select("doc_id", words_of(F.col("text")).alias("words"))
        .select("doc_id", "words", F.size("words").cast("long").alias("n_words"), places.alias("places"))
        .select("doc_id", "n_words", F.filter(F.flatten(F.transform("places", lambda i: look_up(F.col("words"), i))), lambda h: h.isNotNull()).alias("hits"))
    )


def license_digest(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per file: counts, places and labels of its licence lines."""
    hits = license_hits(docs, templates)
    base = F.filter("hits", lambda h: h["base"])
    label = lambda hs: F.array_join(F.array_sort(F.array_distinct(F.transform(hs, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["start"])
    return hits.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["coverage"])), F.lit(0.0)).alias("score"),
    )


def license_sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """DuckDB SQL of license_digest over the view documents, without an index."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = []
    for t in templates:
        k, n = t.key
        key = " and ".join(f"words[i+{j}]='{t.words[k + j]}'" for j in range(n))
        cov = " + ".join(f"coalesce((words[i+{j - k}]='{w}')::int, 0)" if j >= k else f"(case when i>{k - j} then coalesce((words[i-{k - j}]='{w}')::int, 0) else 0 end)" for j, w in enumerate(t.words))
        parts.append(f"select doc_id, rid, '{t.label}' as label, {str(t.base).lower()} as base, i-1 as start, ({cov})::double / {float(len(t.words))} as coverage from p where {key}")
    return f"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text,''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
p as (select doc_id, rid, words, unnest(range(1, len(words) + 1)) as i from d),
h as ({" union all ".join(parts)}),
g as (select rid, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
  coalesce(array_to_string(list_sort(list(distinct label) filter (base)), ','), '') as base_labels,
  array_to_string(list_sort(list(distinct label)), ',') as labels, max(coverage) as score from h group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join g using (rid)"""
