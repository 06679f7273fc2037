"""Toxicity: a linear-chain conditional random field tags toxic words; documents are scored from its marginals.

Only documents carry labels, so words are labelled from them: in a toxic document, the words (or their beginnings)
whose documents are far more often toxic than clean, counted over distinct texts of the training sample. The chain has
two states; a word's evidence comes from itself and its first five and four characters. Forward-backward gives every
word's probability of being part of a toxic span; a document's score is a logistic of its largest marginal and of the
expected number of toxic words among those above one half, fitted to the labels of the training sample.

Learning uses a bounded sample of the labelled rows whose crc32(doc_id as text) mod 3 is not 1: up to SAMPLE_TOXIC and
SAMPLE_CLEAN documents by a digest of the id. Words are counted, and the document's logistic is fitted, on all of it; the
chain itself on CHAIN_DOCS toxic and as many clean documents of it, whose texts the driver holds. A feature has to stand in
ENOUGH_SUPPORT toxic texts (20), in small samples in 1 % of them and in LEAST_SUPPORT at least: fewer would make chance words
toxic. So the number of features is bounded by the sample. Scoring is a map over all whole texts; the model travels with the function.

Null and word-less texts score the prior of no evidence. Very long texts are scored whole, in segments of bounded length;
empty tables give no rows. Of several labels for an id the largest counts, of several texts the smallest; null labels and
ids are not learnt from. Digests that tie go by id. Without toxic or without clean training rows the score is 0 throughout. A null id is
never held out. Repeated rows are scored each; extra columns are ignored by score(), carried by reject().
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table, written

SAMPLE_TOXIC, SAMPLE_CLEAN, CHAIN_DOCS = 3000, 6000, 600
LEAST_SUPPORT, SUPPORT_SHARE, ENOUGH_SUPPORT, LEAST_LOG_ODDS = 3, 0.01, 20, 3.0
SEGMENT, ROUNDS, RATE, L2 = 256, 60, 0.3, 1e-5
THRESHOLD = 0.7
#: Words that are scored together, about; known words a task remembers.
BATCH_WORDS, MEMORY = 1_000_000, 500_000

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = "score double, spans array<struct<start: int, end: int, p: double>>"


def features(word: bytes) -> tuple[bytes, bytes, bytes]:
    text = word.decode("utf-8", "ignore")
    return b"w" + word, b"5" + text[:5].encode(), b"4" + text[:4].encode()


def _layout(lengths: np.ndarray):
    """Order of sequences by falling length; for each step the number of sequences that reach it; place of each word, step by step."""
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    steps = int(sorted_lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")
    offsets = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return active, offsets, offsets[within] + np.repeat(rank, lengths)


@dataclass
class Chain:
    """Weights of the features (state 1 against 0), log weights of start, 0-1, 1-0 and 1-1 (0-0 is 0), and of the document's logistic."""

    vocabulary: dict[bytes, int]
    weights: np.ndarray
    moves: np.ndarray = field(default_factory=lambda: np.zeros(4))
    document: np.ndarray = field(default_factory=lambda: np.array([-4.0, 4.0, 2.0]))
    constant: float | None = None

    def evidence(self, word: bytes) -> float:
        return sum(self.weights[i] for f in features(word) if (i := self.vocabulary.get(f, -1)) >= 0) + self.weights[-1]

    def marginals(self, u: np.ndarray, lengths: np.ndarray, expected: bool = False):
        """Probability of state 1 of each word of the sequences; if asked for, also the expected counts of the moves."""
        active, offsets, place = _layout(lengths)
        e = np.empty(len(u))
        e[place] = np.exp(np.clip(u, -30, 30))
        start, a01, a10, a11 = np.exp(self.moves)
        forward, backward = np.empty(len(u)), np.ones(len(u))
        for t in range(len(active)):  # the ratio of state 1 to state 0, all sequences at once
            now = slice(offsets[t], offsets[t + 1])
            if t == 0:
                forward[now] = start * e[now]
            else:
                r = forward[offsets[t - 1] : offsets[t - 1] + active[t]]
                forward[now] = e[now] * (a01 + r * a11) / (1 + r * a10)
        for t in range(len(active) - 2, -1, -1):
            n = active[t + 1]
            x = e[offsets[t + 1] : offsets[t + 1] + n] * backward[offsets[t + 1] : offsets[t + 1] + n]
            backward[offsets[t] : offsets[t] + n] = (a10 + a11 * x) / (1 + a01 * x)
        odds = forward * backward
        p = odds / (1 + odds)
        if not expected:
            return p[place]
        counts = np.zeros(4)
        counts[0] = p[: active[0]].sum() if len(active) else 0
        for t in range(len(active) - 1):
            n = active[t + 1]
            r, x = forward[offsets[t] : offsets[t] + n], e[offsets[t + 1] : offsets[t + 1] + n] * backward[offsets[t + 1] : offsets[t + 1] + n]
            total = 1 + a01 * x + r * a10 + r * a11 * x
            counts[1:] += (a01 * x / total).sum(), (r * a10 / total).sum(), (r * a11 * x / total).sum()
        return p[place], counts

    def score(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each document: from its largest marginal and the mass of those above one half."""
        if self.constant is not None:
            return np.full(len(lengths), self.constant)
        top, mass = document_evidence(p, lengths)
        return 1 / (1 + np.exp(-(np.stack([np.ones(len(top)), top, np.log1p(mass)], 1) @ self.document)))


def document_evidence(p: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = np.flatnonzero(lengths)
    begins = (np.cumsum(lengths) - lengths)[full]
    top, mass = np.zeros(len(lengths)), np.zeros(len(lengths))
    if len(full):
        top[full] = np.maximum.reduceat(p, begins)
        mass[full] = np.add.reduceat(np.where(p >= 0.5, p, 0), begins)
    return top, mass


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of a bounded number of labelled rows that aren't held out."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = own.where(~held_out())
    digest = F.xxhash64("doc_id", F.lit("toxicity"))
    few = own.where("toxic > 0").orderBy(digest, "doc_id").limit(SAMPLE_TOXIC).unionByName(own.where("toxic <= 0").orderBy(digest, "doc_id").limit(SAMPLE_CLEAN))
    few = F.broadcast(few)  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(few, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # a label's document once, whatever rows share its id
    return written(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).alias("toxic")), "toxicity-sample")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxic_features(sample: DataFrame) -> pd.DataFrame:
    """feature, toxic and clean counts of distinct texts, of the features in enough of the toxic texts."""

    def count(batches):
        tally = {True: Counter(), False: Counter()}
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                tally[bool(toxic)].update({f for w in set(WORD.findall(text.encode().lower())) for f in features(w)})
                tally[bool(toxic)][b""] += 1
        names = list(set(tally[True]) | set(tally[False]))
        yield pd.DataFrame({"feature": names, "toxic": [tally[True][f] for f in names], "clean": [tally[False][f] for f in names]})

    texts = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    counts = texts.mapInPandas(count, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = counts.where(F.length("feature") == 0).select("toxic", "clean").first() or (0, 0)
    least = max(LEAST_SUPPORT, min(ENOUGH_SUPPORT, SUPPORT_SHARE * n[0]))
    found = counts.where((F.col("toxic") >= least) & (F.length("feature") > 0)).toPandas().sort_values("feature")  # at most the features of the sample's toxic texts / 20
    found["odds"] = np.log((found["toxic"] + 0.5) / (n[0] + 1)) - np.log((found["clean"] + 0.5) / (n[1] + 1))
    return found


def fit(sample: DataFrame) -> Chain:
    """The chain, learnt from the sample on the driver; then the document's logistic, from the sample's scores."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        return Chain({}, np.zeros(1), constant=0.0)
    found = toxic_features(sample)
    vocabulary = {bytes(f): i for i, f in enumerate(found["feature"])}
    toxic = {bytes(f) for f in found.loc[found["odds"] >= LEAST_LOG_ODDS, "feature"]}
    digest = F.xxhash64("doc_id", F.lit("chain"))
    few = sample.where("toxic").orderBy(digest, "doc_id").limit(CHAIN_DOCS).unionByName(sample.where("NOT toxic").orderBy(digest, "doc_id").limit(CHAIN_DOCS)).toPandas()  # 2 x CHAIN_DOCS texts
    numbers, rows, y, lengths = {}, [], [], []
    for text, label in zip(few["text"], few["toxic"], strict=True):
        words = WORD.findall(text.encode().lower())
        rows += [numbers.setdefault(w, len(numbers)) for w in words]
        y += [bool(label) and not toxic.isdisjoint(features(w)) for w in words] if label else [False] * len(words)
        lengths += [min(SEGMENT, len(words) - i) for i in range(0, len(words), SEGMENT)]
    chain = Chain(vocabulary, np.zeros(len(vocabulary) + 1))
    if rows:
        _learn(chain, list(numbers), np.array(rows), np.array(y, float), np.array(lengths))

    def evidence(batches):
        known = _Known(chain)
        for pdf in batches:
            u, sizes = _evidence([t.encode() for t in pdf["text"]], known)
            top, mass = document_evidence(chain.marginals(u, sizes), sizes)
            yield pd.DataFrame({"top": top, "mass": mass, "toxic": pdf["toxic"].astype(float)})

    seen = sample.mapInPandas(evidence, "top double, mass double, toxic double").toPandas()
    chain.document = _logistic(np.stack([np.ones(len(seen)), seen["top"], np.log1p(seen["mass"])], 1), seen["toxic"].to_numpy())
    return chain


def _learn(chain: Chain, words: list[bytes], rows: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> None:
    """Penalised likelihood of the labelled chains by Adam over all of them."""
    known = [[chain.vocabulary[f] for f in features(w) if f in chain.vocabulary] + [len(chain.weights) - 1] for w in words]
    sizes = np.array([len(k) for k in known])
    flat, of_word = np.array([i for k in known for i in k]), np.repeat(np.arange(len(known)), sizes)
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[firsts] = False
    before = np.roll(y, 1)
    seen = np.array([y[firsts].sum(), ((1 - before) * y)[inner].sum(), (before * (1 - y))[inner].sum(), (before * y)[inner].sum()])
    wanted = np.bincount(rows, y, len(known))
    theta, m, v = np.zeros(len(chain.weights) + 4), 0, 0
    for step in range(1, ROUNDS + 1):
        chain.weights, chain.moves = theta[:-4], theta[-4:]
        u = np.bincount(of_word, chain.weights[flat], len(known))
        p, counts = chain.marginals(u[rows], lengths, expected=True)
        word_gap = wanted - np.bincount(rows, p, len(known))
        gap = np.concatenate([np.bincount(flat, word_gap[of_word], len(chain.weights)), seen - counts]) / len(lengths) - L2 * theta
        m, v = 0.9 * m + 0.1 * gap, 0.999 * v + 0.001 * gap * gap
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    chain.weights, chain.moves = theta[:-4], theta[-4:]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


class _Known(dict):
    """Evidence by word, worked out when first asked for."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain

    def __missing__(self, word: bytes) -> float:
        self[word] = value = float(self.chain.evidence(word))
        return value


def _evidence(texts: list[bytes], known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Each word's evidence, text after text, and the texts' numbers of words."""
    out, sizes = [], []
    for text in texts:
        words = WORD.findall(text.lower())
        out.append(np.array(list(map(known.__getitem__, words)), float))
        sizes.append(len(words))
        if len(known) > MEMORY:
            known.clear()
    return np.concatenate(out or [np.zeros(0)]), np.array(sizes, np.int64)


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Runs of words at one half or more, in code points."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    out: list[dict] = []
    for i in np.flatnonzero(p >= 0.5).tolist():
        if out and out[-1]["i"] == i - 1:
            out[-1] |= {"i": i, "b": places[i][1], "p": max(out[-1]["p"], float(p[i]))}
        else:
            out.append({"i": i, "a": places[i][0], "b": places[i][1], "p": float(p[i])})
    at, chars = 0, 0
    for s in out:
        s["start"] = chars + len(text[at : s["a"]].decode())
        s["end"] = s["start"] + len(text[s["a"] : s["b"]].decode())
        at, chars = s["b"], s["end"]
    return [{k: s[k] for k in ("start", "end", "p")} for s in out]


def score(docs: DataFrame, chain: Chain, kept: tuple[str, ...] = ("doc_id",), with_spans: bool = True) -> DataFrame:
    """Columns `kept` with `score` and `spans` (offending offsets) of every whole text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        known = _Known(chain)
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            scores, spans = np.zeros(len(texts)), [[]] * len(texts)
            while order:
                part, size = [], 0
                while order and size < 6 * BATCH_WORDS:
                    part.append(order.pop())
                    size += len(texts[part[-1]])
                u, sizes = _evidence([texts[i] for i in part], known)
                p = chain.marginals(u, sizes)
                scores[part] = chain.score(p, sizes)
                if with_spans:
                    top, _ = document_evidence(p, sizes)
                    ends = np.cumsum(sizes)
                    for n in np.flatnonzero(top >= 0.5):
                        spans[part[n]] = _spans(texts[part[n]], p[ends[n] - sizes[n] : ends[n]])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores), pa.array(spans, kind)], [*kept, "score", "spans"])

    schema = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL(RESULT).fields])
    return docs.select(F.col("text").cast("string").alias("_t"), *kept).mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold."""
    chain = fit(training_sample(docs, labels))
    own = [f"k_{c}" for c in docs.columns]  # so that no column of the documents clashes with the score's
    scored = score(docs.select("text", *(F.col(c).alias(k) for c, k in zip(docs.columns, own, strict=True))), chain, tuple(own), with_spans=False)
    return scored.where(F.col("score") < THRESHOLD).select(*(F.col(k).alias(c) for c, k in zip(docs.columns, own, strict=True)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, whether it was held out of learning, and the decision."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(training_sample(docs, table(spark, sf_dir, "labels"))))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), spans.alias("spans"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
