import math
import random
import re
from collections import Counter

from memloom.llm import license_scan as op

from .common import empty, frame, odd_texts, rows_of

LINES = [
    "Some text. Released under the MIT License. More.",
    "Licensed under CC BY-NC 4.0.",
    "ALL RIGHTS RESERVED, all rights reserved",
    "the GNU General  Public\nLicense applies",
    "Licensed under the Apache License, Version 2.0.",
    "mit without a licence; rights all reserved; general public",
    "CC BY is one word with a wide space, cc by is not",
]


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for p, label in op.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_columns_and_labels(spark):
    texts = odd_texts() + LINES
    got = rows_of(op.scan(frame(spark, texts)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    n = len(odd_texts())
    assert [got[n + i].labels for i in (0, 1, 4)] == ["mit", "cc-by,cc-by-nc", "apache-2.0"]
    assert got[n + 5].labels == "" and got[n + 5].score == 0
    assert [(m.label, m.word) for m in got[n].matches] == [("mit", 2)]


def test_empty_table_and_rows_without_id(spark):
    assert op.scan(empty(spark)).count() == 0
    assert op.scan(frame(spark, ["x"])).count() == 3


def test_template_anywhere_in_a_long_text(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    got = rows_of(op.scan(frame(spark, ["word " * 20_000 + notice, notice.replace("hereby", "")])))
    assert got[0].labels == "mit" and got[0].matches[0].word == 20_000
    assert got[1].labels == ""  # a mandatory phrase is missing


def brute(words, n, df):
    """Labels and score by trying every place of every template, without postings."""
    idf = lambda w: math.log((1 + n) / (1 + df[w]))
    at = lambda i: words[i] if 0 <= i < len(words) else None
    found = []
    for label, text, phrases in op.TEMPLATES:
        own = text.split()
        if not {w for p in phrases for w in p.split()} <= set(words):
            continue
        rare = sorted(set(own) & set(words), key=lambda w: (-idf(w), w))[: op.RARE_WORDS]
        for shift in range(-len(own), len(words)):
            agreeing = {w for k, w in enumerate(own) if w in rare and at(shift + k) == w}
            near = lambda p, i: any(words[j : j + len(p)] == p for j in range(len(words)) if abs(j - shift - i) <= op.SLACK)
            verified = all(near(p.split(), next(i for i in range(len(own)) if own[i : i + len(p.split())] == p.split())) for p in phrases)
            if len(agreeing) >= min(op.AGREEING, len(set(own))) and verified:
                found.append((label, sum(at(shift + k) == w for k, w in enumerate(own)) / len(own)))
    return {label for label, _ in found}, max((s for _, s in found), default=0.0)


def test_labels_and_scores_against_every_place(spark):
    r = random.Random(12)
    filler = ["word", "license", "the", "free", "public", "software", "of"]
    texts = ["", "mit license"]
    for _ in range(150):
        parts = []
        for _, text, _ in r.sample(op.TEMPLATES, r.randint(0, 3)):
            own = text.split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                i = r.randrange(len(own))
                own[i : i + r.randint(0, 1)] = [r.choice(filler)] if r.random() < 0.6 else []
            parts += [r.choice(filler) for _ in range(r.randint(0, 12))] + own
        texts.append(" ".join(parts))
    docs = frame(spark, texts)
    got, every = rows_of(op.scan(docs)), [(t or "").split() for t in [*texts, "no id here", "no id here"]]
    df = Counter(w for words in every for w in set(words))
    seen = 0
    for i, words in enumerate(every[: len(texts)]):
        labels, score = brute(words, len(every), df)
        hits = [label for p, label in op.BASE if any(words[j : j + len(p.split())] == p.split() for j in range(len(words)))]
        assert set(filter(None, got[i].labels.split(","))) == labels | set(hits), i
        assert abs(got[i].score - (1.0 if hits else score)) < 1e-12, i
        seen += bool(labels)
    assert seen > 60
