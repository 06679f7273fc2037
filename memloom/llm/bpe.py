"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Each task splits its texts into pre-tokens (words), numbers the distinct ones of a chunk of documents and keeps the
documents as sequences of those numbers. The chunks' words are shuffled by a digest, so every occurrence of a word
meets in one bucket, where each distinct word is encoded once; a frequent word comes once a chunk, never once an
occurrence. The ids go back to the chunks, where documents are reassembled by position. Decoding looks the ids up in
the token-byte table, whose size is the vocabulary's.

Words and sequences travel packed and compressed, a row a (chunk, bucket) and a chunk. A bucket's rows stream through
the encoder one by one, whatever their number. Both sides come from one scan, which Spark reuses or, after a loss,
repeats over the same files in the same order; documents that come out of a shuffle have no such order, so they are
written to the shared folder first. A chunk's dictionary carries a check sum besides.

Nulls count as empty texts: no tokens, the digests of nothing. Null ids, repeated rows and extra columns are kept as
they are asked for. A very long text is a chunk of its own; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters after which a chunk ends.
CHUNK_CHARS = 12_000_000
#: Word buckets: as many as input partitions, from 4,096 on as their square root grows.
LEAST_BUCKETS, ROOT_BUCKETS = 32, 64
#: Distinct words whose ids a task remembers at once.
REMEMBERED = 2_000_000

SHUFFLED = "key string, chunk string, bucket int, words long, crc long, payload binary, rows binary"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:  # on the driver
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays) + tail)


def _unpack(data: bytes, *types: str) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 8 * (1 + len(types))
    out = []
    for kind, size in zip(types, np.frombuffer(raw, "<i8", len(types), 8), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out, raw[at:]


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of numbers by place: they compress better so."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _chunk_rows(chunk: str, kept: pd.DataFrame, numbers: dict[str, int], docs: list[np.ndarray], buckets: int):
    """A row for each bucket with its words in order, and one with the documents as numbers into all buckets' words."""
    words = [w.encode() for w in numbers]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    crc = 0
    for b in range(buckets):
        own = [words[i] for i in order[starts[b] : starts[b + 1]]]
        crc = zlib.crc32(joined := b"".join(own), crc)
        if own:
            yield {"key": f"w{b}", "chunk": chunk, "bucket": b, "words": len(own), "crc": 0, "payload": _pack(np.array([len(w) for w in own], "<u4"), tail=joined), "rows": b""}
    lengths = np.array([len(d) for d in docs], "<u4")
    flat = place.astype("<u4")[np.concatenate(docs)]
    rows = zstandard.compress(kept.to_parquet(compression=None, index=False))
    yield {"key": f"c{chunk}", "chunk": chunk, "bucket": -1, "words": len(words), "crc": crc, "payload": _pack(lengths, _planes(flat)), "rows": rows}


def encode(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",), ranks_path: str = RANKS, pattern: str = PATTERN, with_ids: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Columns `kept` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    spark = docs.sparkSession
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs.select(*kept, "text"), "bpe-documents")
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))  # the vocabulary: of fixed size
    kept_schema = docs.select(*kept).schema
    scanned = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    partitions = docs.rdd.getNumPartitions()
    buckets = max(LEAST_BUCKETS, min(partitions, int(ROOT_BUCKETS * partitions**0.5)))

    def scan(batches):
        find, part, number = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        numbers, done, frames, chars = {}, [], [], 0
        for pdf in batches:
            frames.append(pdf[list(kept)])
            begun = 0
            for at, text in enumerate(pdf["_text"]):
                done.append(np.array([numbers.setdefault(w, len(numbers)) for w in find(text)], "<u4"))
                chars += len(text)
                if chars >= chunk_chars:
                    frames[-1] = frames[-1].iloc[: at + 1 - begun]
                    yield pd.DataFrame(_chunk_rows(f"{part}.{number}", pd.concat(frames), numbers, done, buckets))
                    frames, begun, number = [pdf[list(kept)].iloc[at + 1 :]], at + 1, number + 1
                    numbers, done, chars = {}, [], 0
        if done:
            yield pd.DataFrame(_chunk_rows(f"{part}.{number}", pd.concat(frames), numbers, done, buckets))

    def encode_words(batches):
        encoder, known = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}), {}
        for pdf in batches:
            out = []
            for bucket, chunk, payload in zip(pdf["bucket"], pdf["chunk"], pdf["payload"], strict=True):
                if bucket < 0:  # a chunk's documents
                    continue
                (lengths,), joined = _unpack(payload, "<u4")
                ends = np.cumsum(lengths).tolist()
                counts, ids = [], []
                for a, b in zip([0, *ends], ends, strict=False):
                    word = joined[a:b]
                    if (own := known.get(word)) is None:
                        own = known[word] = encoder._encode_single_piece(word)
                    counts.append(len(own))
                    ids += own
                out.append((f"c{chunk}", bucket, _pack(np.array([zlib.crc32(joined)], "<u4"), np.array(counts, "<u4"), np.array(ids, "<u4"))))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.DataFrame(out, columns=["key", "bucket", "payload"])

    def reassemble(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
        if not len(left):
            return pd.DataFrame([], columns=names)
        table_of = [b""] * (max(ranks.value.values()) + 1)
        for token, rank in ranks.value.items():
            table_of[rank] = token
        ids_of, text_of, bytes_of = [], [], []
        for r in right.sort_values("bucket").itertuples():
            (_, counts, ids), _ = _unpack(r.payload, "<u4", "<u4", "<u4")
            ids, ends = ids.tolist(), np.cumsum(counts).tolist()
            for a, b in zip([0, *ends], ends, strict=False):
                own = ids[a:b]
                ids_of.append(own)
                text_of.append(" ".join(map(str, own)))
                bytes_of.append(b"".join([table_of[i] for i in own]))
        out = []
        for r in left.itertuples():
            if r.words != len(ids_of) or r.crc != zlib.crc32(b"".join(bytes_of)):
                raise RuntimeError("a repeated scan met its rows in another order; write the documents first")
            (lengths, planes), _ = _unpack(r.payload, "<u4", "<u1")
            flat = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
            frame = pd.read_parquet(io.BytesIO(zstandard.decompress(r.rows)))
            sizes = np.array([len(x) for x in ids_of], np.int64)
            ends = np.cumsum(lengths).tolist()
            n, digests, decoded, ids = [], [], [], []
            for a, b in zip([0, *ends], ends, strict=False):
                own = flat[a:b].tolist()
                n.append(int(sizes[flat[a:b]].sum()))
                digests.append(hashlib.sha256(" ".join([text_of[w] for w in own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([bytes_of[w] for w in own])).hexdigest())
                if with_ids:
                    ids.append([i for w in own for i in ids_of[w]])
            frame["n_tokens"], frame["ids_sha256"], frame["decoded_sha256"] = n, digests, decoded
            if with_ids:
                frame["ids"] = ids
            out.append(frame[names])
        return pd.concat(out)

    shuffled = scanned.mapInPandas(scan, SHUFFLED).repartition("key")
    encoded = shuffled.mapInPandas(encode_words, "key string, bucket int, payload binary")
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema = StructType([*kept_schema.fields, *StructType.fromDDL(added).fields])
    # Word rows don't enter the last step. A plain filter would sink below the exchange and cost a second scan; one that numbers rows stays above.
    chunks = shuffled.where(F.when(F.monotonically_increasing_id() >= 0, F.col("bucket")) < 0)
    return chunks.groupBy("key").cogroup(encoded.groupBy("key")).applyInPandas(reassemble, schema)


def token_bytes(spark: SparkSession, ranks_path: str = RANKS) -> DataFrame:
    """The token-byte table: id and its bytes."""
    return spark.createDataFrame([(rank, token) for token, rank in load_ranks(ranks_path).items()], "id int, bytes binary")


def decode(encoded: DataFrame, kept: tuple[str, ...] = ("doc_id",), ranks_path: str = RANKS) -> DataFrame:
    """Columns `kept` with `text` of rows that hold `ids`: each id is joined with its bytes, in order of position."""
    rows = encoded.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", F.posexplode_outer("ids").alias("pos", "id"))
    bytes_of = F.broadcast(token_bytes(encoded.sparkSession, ranks_path))  # the vocabulary: of fixed size
    parts = each.join(bytes_of, "id", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.hex(x["bytes"])), "")
    text = parts.select("_row", F.decode(F.unhex(joined), "UTF-8").alias("text"))
    return rows.select("_row", *kept).join(text, "_row").drop("_row")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as digests."""
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
