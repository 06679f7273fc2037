"""License scans: a positional rare-token index over licence templates.

Every licence template is a short word sequence; the index keeps the postings of all template words, and their inverse
document frequency in the scanned corpus (counted over all documents). A file's licence words are ranked by that: for
each template whose key phrases' words it holds, its RARE_WORDS rarest ones of that template are looked up; postings that
agree on the relative position (file position minus template position) propose the template at that place, which counts
only when the template's mandatory key phrases stand there word for word.

The templates are fixed, so vocabulary, postings and the driver's share are of constant size. Both passes over
the corpus are map-only but for the count of the template words, which is combined per task before its shuffle.

Nulls and empty texts: zero words, no labels, score 0. Equal templates at one place count once as a label; words of equal
frequency go by spelling. Very long texts are scanned whole, in time linear in their words. Empty tables give no rows.
Repeated rows and null ids are scanned each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Label, template words, mandatory key phrases. The wording is that of the public licence notices.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted", "to any person obtaining a copy"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
]
# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Words by which a template is looked up: so many of the file's rarest words of it, and so many of them must agree on the place.
RARE_WORDS, AGREEING = 4, 2
#: Words by which a key phrase may stand off its expected place (inserted or dropped words).
SLACK = 2

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # on UTF-8 bytes after lower-casing: the contract's class
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []  # bytes.lower() touches A-Z only


def template_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents and, for each template word, of documents that hold it, over the whole corpus."""
    wanted = {w.encode() for w in words}

    def count(batches):
        n, df = 0, Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                n += 1
                df.update(wanted.intersection(_words(text)))
        yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in df)], "n": pa.array([n, *df.values()], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most one row a template word
    found = {r["word"]: r["n"] for r in rows}
    return found.pop("", 0), found


class RareTokenIndex:
    """Postings of all template words: word -> [(template, position)]; IDF of the words; words without which a template can't be verified."""

    def __init__(self, n_docs: int, df: dict[str, int], templates=TEMPLATES):
        self.labels, self.words, self.phrases, self.mandatory = [], [], [], []
        self.postings, self.idf = defaultdict(lambda: defaultdict(list)), {}
        for t, (label, text, phrases) in enumerate(templates):
            self.labels.append(label)
            self.words.append([w.encode() for w in text.split()])
            self.phrases.append([[w.encode() for w in p.split()] for p in phrases])
            self.mandatory.append({w for p in self.phrases[-1] for w in p})
            for at, w in enumerate(self.words[-1]):
                self.postings[t][w].append(at)
                self.idf[w] = math.log((1 + n_docs) / (1 + df.get(w.decode(), 0)))

    def matches(self, words: list[bytes], present: set[bytes], places) -> list[tuple[str, int, float]]:
        """(label, place, share of the template's words at their place) of every verified template. present: the file's template words; places(word): where it stands."""
        found = []
        for t, mandatory in enumerate(self.mandatory):
            if not mandatory <= present:
                continue
            own = self.words[t]
            rare = sorted(present.intersection(self.postings[t]), key=lambda w: (-self.idf[w], w))[:RARE_WORDS]
            votes = defaultdict(set)
            for w in rare:
                for p in self.postings[t][w]:
                    for i in places(w):
                        votes[i - p].add(w)
            for shift, agreeing in votes.items():
                if len(agreeing) >= min(AGREEING, len(set(own))) and all(self._near(words, p, own, shift) for p in self.phrases[t]):
                    same = sum(1 for k, w in enumerate(own) if 0 <= shift + k < len(words) and words[shift + k] == w)
                    found.append((self.labels[t], shift, same / len(own)))
        return sorted(found, key=lambda x: (x[1], x[0]))

    @staticmethod
    def _near(words, phrase, template, shift) -> bool:
        n = len(phrase)
        own = next((i for i in range(len(template) - n + 1) if template[i : i + n] == phrase), None)
        if own is None:  # a phrase that the template's text lacks is sought beside it
            return any(words[i : i + n] == phrase for i in range(max(0, shift - n - SLACK), shift + len(template) + SLACK + 1))
        return any(words[i : i + n] == phrase for i in range(max(0, shift + own - SLACK), shift + own + SLACK + 1))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, the base figures, labels, score and `matches`: label, word place and share of each verified template."""
    n, df = document_frequencies(docs, template_words(templates))
    index = RareTokenIndex(n, df, templates)
    base = [(p.encode().split(), label) for p, label in BASE]
    looked_up = set(index.idf) | {w for p, _ in base for w in p}
    kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        for batch in batches:
            out = defaultdict(list)
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = _words(text)
                present = looked_up.intersection(words)
                known: dict[bytes, list[int]] = {}

                def places(w, words=words, known=known):
                    if w not in known:
                        known[w] = [i for i, v in enumerate(words) if v == w]
                    return known[w]

                hits = [(i, label) for p, label in base if present.issuperset(p) for i in places(p[0]) if words[i : i + len(p)] == p]
                method = index.matches(words, present, places) if present else []
                own = {label for _, label in hits}
                out["n_words"].append(len(words))
                out["n_base"].append(len(hits))
                out["first_word"].append(min((i for i, _ in hits), default=None))
                out["last_word"].append(max((i for i, _ in hits), default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {m[0] for m in method})))
                out["score"].append(1.0 if hits else max((m[2] for m in method), default=0.0))
                out["matches"].append([{"label": m[0], "word": m[1], "share": m[2]} for m in method])
            types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": kind}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], ["doc_id", *out]) if batch.num_rows else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), *((k, types.get(k, pa.int64())) for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"))]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT + ", matches array<struct<label: string, word: long, share: double>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence words, base phrases and verified licence labels."""
    return scan(table(spark, sf_dir, "documents")).drop("matches")


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE_SQL: dict[str, str] = {}
