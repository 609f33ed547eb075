"""Operator 4, licence scans: a positional index of rare licence words. DataFrame functions only.

A template is a clause of a licence text. Its key phrase is mandatory, so the index holds the places of the
key phrase's words in each template. Of the licence words that a file holds, those with the highest IDF are
looked up, as many as it takes for each template that could stand there to have two of its own. The starts
that each posting gives (place in the file less place in the template) are intersected, and what is left is
compared word by word.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.llm.base import LOWER, UPPER, ascii_lower, whole_text
from quadrel.llm.license_texts import BASE, CLAUSES

# What is not part of a word once A-Z is lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's IDF weight that must stand in place.
COVER = 0.7
#: Postings of a template that are intersected: those of its rarest key words.
ANCHORS = 2
_PLACE = "struct<template:int,start:int,cover:double,ok:boolean>"


def plain_words(text: str) -> list[str]:
    """The words of a text as words_of() has them."""
    return [w for w in re.split(NO_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


@dataclass(frozen=True)
class Template:
    """Words of a clause, where its key phrase stands in them, and the share of its weight that must stand in place."""

    label: str
    words: tuple[str, ...]
    key_from: int
    key: tuple[str, ...]
    least: float


def _template(label: str, phrase: str, clause: str, least: float) -> Template:
    words, key = plain_words(clause), plain_words(phrase)
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return Template(label, tuple(words), at, tuple(key), least)


TEMPLATES = [*(_template(label, phrase, phrase, 1.0) for label, phrase in BASE), *(_template(label, phrase, clause, COVER) for label, phrase, clause in CLAUSES)]


def words_of(text: Column) -> Column:
    """All words of a lower-cased text in order, then one empty string if something follows the last."""
    return F.split(F.regexp_replace(text, "^" + NO_WORD, ""), NO_WORD, -1)


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = docs.select(F.col(id_col).alias("doc_id"), words_of(ascii_lower(whole_text(text_col))).alias("words"))
    return words.withColumn("n_words", (F.size("words") - (F.element_at("words", -1) == "").cast("int")).cast("long"))


def word_weights(words: DataFrame) -> dict[str, float]:
    """IDF of the licence words, from all documents."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.words})
    # The aggregate has a row for each licence word, and one for the number of documents.
    own = F.array_append(F.array_intersect("words", F.array(*map(F.lit, vocabulary))), F.lit(""))
    found = dict(words.select(F.explode(own).alias("word")).groupBy("word").count().collect())
    total = found.pop("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def _index(weights: dict[str, float]) -> Column:
    """The templates as one constant: anchors are the rarest words of the key phrase with their places, the rarest first."""
    made = []
    for k, t in enumerate(TEMPLATES):
        total = sum(weights[w] for w in t.words)
        at = sorted(range(len(t.key)), key=lambda i: (-weights[t.key[i]], t.key[i], i))[:ANCHORS]
        made.append({
            "template": k, "words": t.words, "shares": [weights[w] / total for w in t.words], "key_from": t.key_from, "key": t.key, "least": t.least,
            "anchors": [{"word": t.key[i], "at": t.key_from + i} for i in at],
        })
    kind = "array<struct<template:int,words:array<string>,shares:array<double>,key_from:int,key:array<string>,least:double,anchors:array<struct<word:string,at:int>>>>"
    return F.from_json(F.lit(json.dumps(made)), kind)


def places(words: DataFrame, weights: dict[str, float]) -> DataFrame:
    """words with `places`: template (index), start and cover of each verified place.

    The key phrase stands in every place, its rarest words among it, so neither the choice of words nor the
    intersection loses one.
    """
    index = _index(weights)
    vocabulary = sorted({w for t in TEMPLATES for w in t.key})
    own = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    rarest = lambda t: F.element_at(t["anchors"], 1)["word"]
    possible = F.filter(index, lambda t: F.array_contains(F.col("_own"), rarest(t)) & (F.size(F.array_except(t["key"], F.col("_own"))) == 0))
    chosen = F.array_distinct(F.flatten(F.transform("_possible", lambda t: F.transform(t["anchors"], lambda a: a["word"]))))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda h: F.array_contains(F.col("_chosen"), h["word"]))

    def starts(t: Column, k: int) -> Column:
        a = F.element_at(t["anchors"], k)
        return F.transform(F.filter("_hits", lambda h: h["word"] == a["word"]), lambda h: h["pos"] - a["at"])

    def proposed(t: Column) -> Column:
        common = F.when(F.size(t["anchors"]) < ANCHORS, starts(t, 1)).otherwise(F.array_intersect(starts(t, 1), starts(t, -1)))
        return F.transform(common, lambda start: verified(t, start))

    def verified(t: Column, start: Column) -> Column:
        # words before the text's first or behind its last match nothing
        there = F.concat(F.array_repeat(F.lit(""), F.greatest(-start, F.lit(0))), F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size(t["words"]) + F.least(start, F.lit(0))))
        cover = F.aggregate(F.arrays_zip(there.alias("a"), t["words"].alias("b"), t["shares"].alias("s")), F.lit(0.0), lambda x, z: x + F.when(z["a"] == z["b"], z["s"]).otherwise(0.0))
        key = F.slice(there, t["key_from"] + 1, F.size(t["key"])) == t["key"]
        return F.struct(t["template"].alias("template"), start.alias("start"), cover.alias("cover"), (key & (cover >= t["least"] - 1e-9)).alias("ok"))

    none = lambda kind: F.array().cast(f"array<{kind}>")
    found = words.withColumn("_own", own).withColumn("_possible", F.when(F.size("_own") > 1, possible))
    found = found.withColumn("_chosen", F.when(F.size("_possible") > 0, chosen)).withColumn("_hits", F.when(F.col("_chosen").isNotNull(), hits))
    checked = F.filter(F.flatten(F.transform("_possible", proposed)), lambda p: p["ok"])
    return found.withColumn("places", F.when(F.size("_hits") > 0, checked).otherwise(none(_PLACE))).drop("_own", "_possible", "_chosen", "_hits")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    score is the largest IDF-weighted share of a template that stands in the text, 0 without a verified
    place. Null and empty texts have no words and no places; a text of any length is one row, whose places
    are all listed. Of several places or clauses with one label the label stands once; equal shares give one
    score. Repeated rows are scanned each; an empty table gives no rows. Other columns of docs, whatever
    their names, are ignored.
    """
    words = with_words(docs, id_col, text_col)
    found = places(words, word_weights(words))
    names = F.array(*(F.lit(t.label) for t in TEMPLATES))
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.element_at(names, p["template"] + 1)))), ",")
    found = found.withColumn("_base", F.filter("places", lambda p: p["template"] < len(BASE)))
    starts = F.transform("_base", lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("_base")).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.least(F.coalesce(F.array_max(F.transform("places", lambda p: p["cover"])), F.lit(0.0)), F.lit(1.0)).alias("score"), "places",
    )
