"""Suffix-array dedup: exact removal of repeated 100-byte strings with a logarithmic family of suffix indexes.

Which suffixes. Of every LENGTH-byte window the K-byte string with the least fingerprint (the last of equals) is its
anchor; equal windows have equal anchors at equal places, so comparing suffixes at anchors loses no match. About one
byte in 39 is an anchor. A window reaches at least ARM bytes beyond its anchor to one side, so an anchor has up to two
suffixes: one from the anchor on, for the windows that reach far enough right, one from ARM bytes before it for the
others. Both are known by their first K + ARM bytes, which seldom repeat by chance.

The family. The texts come in batches by id. A batch's anchors are sorted into a suffix array, in the order of the
fingerprint of their first K + ARM bytes (one row a bucket, packed). It is scanned side by side with every level of the
family; suffixes that stand in both, or twice in the batch, are matched. Then the batch is merged with levels of its
own size, and so on up, so a text is rewritten a logarithmic number of times. Levels hold a prefix once, with its first
place; they are tables in the shared folder, and a merged level replaces those it came from.

Exact comparison. The windows of matched anchors are cut out with their bytes, equal cuts are folded in each task, the
rest meets by anchor. Windows are sorted by fingerprint and compared byte by byte with their predecessor; each but the
first (by id and start) of equal windows is a repeat. Documents then drop the bytes of their repeats.

Hot anchors. The family counts each suffix as it merges. One that stands HOT_LEAST times and more (a line in many texts,
each time between other words) is not sent to one bucket by its anchor: its windows go one by one, by a 128-bit
fingerprint of their own (folded in the task first), so equal windows meet and no bucket holds the line's texts.

Texts are shuffled once, by id (both later steps reuse that exchange). Copies fold in the task that reads them, so a
group of copies brings each bucket at most a row a task.

Nulls count as empty texts. Rows that share an id are one document: equal starts in them are the same place and don't
remove each other. Rows without id come after all others, in the order of a digest of their texts; those of equal text
are one document. Texts shorter than LENGTH keep everything, very long ones are cut without loss. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, table, work_path

LENGTH, K = 100, 24
WINDOW = LENGTH - K + 1
ARM = (LENGTH - K) // 2
BATCHES = 4
#: Anchors of an index bucket, about; input bytes a compared bucket stands for; bytes of a scanned stretch (as a power of two).
BUCKET_ANCHORS, COMPARED_BYTES, STRETCH_BITS = 400_000, 2_000_000, 20
#: Text bytes whose windows a task cuts at once.
PORTION_BYTES = 4_000_000
#: Windows that a task sorts at once.
COMPARED_WINDOWS = 1_000_000
#: Occurrences from which an anchor is hot; a larger input raises it, so that at most MOST_HOT anchors are.
HOT_LEAST, MOST_HOT = 4000, 1_000_000
#: Ids of rows that have none start here.
NO_ID = 2**62

_rng = np.random.default_rng(20)
_BYTE, _BYTE_AGAIN = _rng.integers(0, 2**64, (2, 256), np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_table: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _table:
        _table.clear()
        _table[size] = _powers(size, int(_BASE)), _powers(size, pow(int(_BASE), -1, 2**64))
    return _table[size]


def prefix_sums(data: np.ndarray, of_byte: np.ndarray = _BYTE) -> np.ndarray:
    up, _ = _power_tables(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(of_byte[data] * up[: len(data)], dtype=np.uint64)])


def fingerprints(sums: np.ndarray, starts, ends) -> np.ndarray:
    """64-bit fingerprints of the strings between starts and ends; they depend on the bytes only."""
    _, down = _power_tables(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Place of the anchor of each window of the stretch."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    mask = np.uint64(2 ** (STRETCH_BITS + 1) - 1)
    at = np.arange(n - K + 1)
    m = fingerprints(sums, at, at + K) & ~mask | (mask - at.astype(np.uint64))
    wide = 1
    while 2 * wide <= WINDOW:
        m = np.minimum(m[:-wide], m[wide:])
        wide *= 2
    if wide < WINDOW:
        m = np.minimum(m[: len(m) - (WINDOW - wide)], m[WINDOW - wide :])
    return (mask - (m & mask)).astype(np.int64)


def stretches(texts: list[bytes]):
    """The texts' bytes in stretches of bounded length: (data, owner of each window or -1, start of each window in its text).

    Short texts share a stretch, long ones are cut with LENGTH - 1 bytes of overlap; windows never cross texts.
    """
    most = 2**STRETCH_BITS
    parts, size = [], 0

    def flush():
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        owner, start = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        at = 0
        for i, offset, p in parts:
            n = max(0, len(p) - LENGTH + 1)
            owner[at : at + n] = i
            start[at : at + n] = np.arange(offset, offset + n)
            at += len(p)
        windows = max(0, len(data) - LENGTH + 1)
        return data, owner[:windows], start[:windows]

    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - LENGTH + 1), most):
            piece = text[offset : offset + most + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > most + LENGTH and parts:
                yield flush()
                parts, size = [], 0
            parts.append((i, offset, piece))
            size += len(piece)
    if parts:
        yield flush()


def runs(texts: list[bytes]):
    """Per stretch: data and its suffixes: owner, code (twice the anchor's place in the text, plus 1 for the left one),
    fingerprint, first and last of its windows in the stretch, shift from stretch to text; by owner."""
    for data, owner, start in stretches(texts):
        sums = prefix_sums(data)
        at = anchors(data, sums)
        ok = np.flatnonzero(owner >= 0)
        at, own = at[ok], owner[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (ok[1:] != ok[:-1] + 1)
        begin = np.flatnonzero(new)
        q, own, first, last = at[begin], own[begin], ok[begin], ok[np.append(begin[1:], len(ok)) - 1]
        shift = start[first] - first
        right, left = np.flatnonzero(last >= q - ARM), np.flatnonzero(first < q - ARM)
        both = np.concatenate([right, left])
        side = np.repeat([0, 1], [len(right), len(left)])
        head = q[both] - ARM * side
        first = np.where(side == 0, np.maximum(first[both], q[both] - ARM), first[both])
        last = np.where(side == 0, last[both], np.minimum(last[both], q[both] - ARM - 1))
        order = np.argsort(own[both], kind="stable")
        h = fingerprints(sums, head, head + K + ARM)
        code = 2 * (q + shift)[both] + side
        yield data, own[both][order], code[order], h[order], first[order], last[order], shift[both][order]


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of 8-byte numbers, byte by place (which compresses well), and raw bytes."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes) + tail)


def unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(raw, "<i8", n, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T).view("<i8").ravel())
        at += 8 * size
    return out, raw[at:]


def _steps(h: np.ndarray) -> np.ndarray:
    """Rising fingerprints as differences."""
    return np.diff(h, prepend=np.uint64(0)).view(np.int64)


def _by_bucket(bucket: np.ndarray, n: int):
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the fingerprints."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


#: Rows of the family: kind 0 a batch's suffix array, 1 matched places, 2 a level, 3 a level to merge, 4 hot anchors.
ROWS = "kind int, bucket int, did long, payload binary"


def batch_arrays(docs: DataFrame, buckets: int) -> DataFrame:
    """Each task's suffix arrays by bucket: rising fingerprints with their first places and counts; further places of equal ones."""

    def scan(batches):
        parts = []
        for pdf in batches:
            did = pdf["did"].to_numpy(np.int64)
            for _, own, code, h, _, _, _ in runs([t or b"" for t in pdf["data"]]):
                parts.append((h, did[own], code))
        if not parts:
            return
        h, did, q = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = []
        for b, rows in _by_bucket(_bucket_of(h, buckets), buckets):
            own = rows[np.lexsort((q[rows], did[rows], h[rows]))]
            new = np.append(True, h[own][1:] != h[own][:-1])
            first, more = own[new], own[~new]
            count = np.diff(np.append(np.flatnonzero(new), len(own)))
            out.append((0, b, 0, pack(_steps(h[first]), did[first], q[first], count.astype(np.int64))))
            if len(more):
                out.append((1, (b + int(did[more[0]])) % buckets, 0, pack(did[more], q[more])))
        yield pd.DataFrame(out, columns=["kind", "bucket", "did", "payload"])

    return docs.mapInPandas(scan, ROWS)


def _scan_and_merge(parts: int, hot_least: int):
    """For one bucket: matched places of the batch against itself and the levels; hot anchors; the merged level.

    Levels hold a suffix with its first place and its count (2 at least once its place has been given).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        matched = [unpack(p)[0] for p in pdf.loc[pdf["kind"] == 1, "payload"]]
        mine = [unpack(p)[0] for p in pdf.loc[pdf["kind"] == 0, "payload"]]
        levels = {k: [unpack(p)[0] for p in pdf.loc[pdf["kind"] == k, "payload"]] for k in (2, 3)}
        bucket, arrays, out = int(pdf["bucket"].iloc[0]), [], []
        if mine:
            h = np.concatenate([np.cumsum(m[0].view(np.uint64), dtype=np.uint64) for m in mine])
            did, q, count = (np.concatenate([m[i] for m in mine]) for i in (1, 2, 3))
            order = np.lexsort((q, did, h))
            h, did, q, count = h[order], did[order], q[order], count[order]
            same = np.zeros(len(h), bool)
            same[1:] |= h[1:] == h[:-1]
            same[:-1] |= h[1:] == h[:-1]
            hit = same | (count > 1)
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            total = np.add.reduceat(count, begin)
            for steps, level_did, level_q, told in (x for k in (2, 3) for x in levels[k]):
                level = np.cumsum(steps.view(np.uint64), dtype=np.uint64)
                at = np.minimum(np.searchsorted(level, h), len(level) - 1)
                both = level[at] == h
                hit |= both
                total += np.where(both, told[at], 0)[begin]
                other = np.unique(at[both])
                fresh = other[told[other] == 1]
                matched.append([level_did[fresh], level_q[fresh]])
            matched.append([did[hit], q[hit]])
            if (hot := total >= hot_least).any():
                out.append((4, bucket, 0, pack(h[begin][hot].view(np.int64))))
            arrays.append((h, did, q, np.where(hit, np.maximum(count, 2), count)))
        arrays += [(np.cumsum(x[0].view(np.uint64), dtype=np.uint64), *x[1:]) for x in levels[3]]
        if arrays:
            h, did, q, count = (np.concatenate(x) for x in zip(*arrays, strict=True))
            order = np.lexsort((q, did, h))
            begin = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            first = order[begin]
            out.append((2, bucket, 0, pack(_steps(h[first]), did[first], q[first], np.add.reduceat(count[order], begin))))
        if matched:
            did, code = (np.concatenate([m[i] for m in matched]) for i in (0, 1))
            out += [(1, part, 0, pack(did[rows], code[rows])) for part, rows in _by_bucket(_part_of(did, parts), parts)]
        return pd.DataFrame(out, columns=["kind", "bucket", "did", "payload"])

    return run


def _part_of(did: np.ndarray, parts: int) -> np.ndarray:
    return (did.astype(np.uint64) * _BASE >> np.uint64(33)).astype(np.int64) % parts


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """did, places: a row a document of the part."""
    pairs = [unpack(p)[0] for p in pdf["payload"]]
    did, code = (np.concatenate([x[i] for x in pairs]) for i in (0, 1))
    order = np.lexsort((code, did))
    did, code = did[order], code[order]
    new = np.append(True, (did[1:] != did[:-1]) | (code[1:] != code[:-1]))
    did, code = did[new], code[new]
    cuts = [*np.flatnonzero(np.append(True, did[1:] != did[:-1])).tolist(), len(did)]
    return pd.DataFrame({"did": did[cuts[:-1]], "places": [code[a:b].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]})


def between(docs: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows with low < did <= high; a given id is its own did, rows without id have one from NO_ID on."""
    inside = (F.lit(True) if low is None else F.col("doc_id") > low) & (F.lit(True) if high is None else F.col("doc_id") <= high)
    docs = docs.where(inside if high is not None and high < NO_ID else inside | F.col("doc_id").isNull())
    docs = docs if low is None else docs.where(F.col("did") > low)
    return docs if high is None else docs.where(F.col("did") <= high)


def matched_places(docs: DataFrame, cuts: list[int], buckets: int, parts: int, hot_least: int) -> tuple[DataFrame, np.ndarray]:
    """did, places: suffixes that stand more than once, from the family built over batches of ids; and the hot ones' fingerprints.

    Reads `docs` (doc_id, did, data) once a batch; a filter on doc_id itself reaches the scan, rows without id are in the last batches. Matches travel packed by parts of the ids. A merged
    level replaces those it came from, which are deleted.
    """
    spark = docs.sparkSession
    levels: list[tuple[int, str]] = []
    rest = ROWS.replace("kind int, ", "")
    read = lambda path, kind, put: spark.read.schema(rest).parquet(f"{path}/kind={kind}").where("bucket >= 0").select(F.lit(put).alias("kind"), "bucket", "did", "payload")
    matched = hot = None
    for i, high in enumerate([*cuts, None]):
        rank, merged = 0, []
        while levels and levels[-1][0] == rank:
            merged.append(levels.pop()[1])
            rank += 1
        rows = batch_arrays(between(docs, None if i == 0 else cuts[i - 1], high).select("did", "data"), buckets)
        for put, paths in ((2, [p for _, p in levels]), (3, merged)):
            for path in paths:
                rows = rows.unionByName(read(path, 2, put))
        path = work_path(spark, f"suffix-level-{i}")
        both = rows.groupBy("bucket").applyInPandas(_scan_and_merge(parts, hot_least), ROWS)
        # An empty row of each kind, so that both folders are there.
        none = spark.createDataFrame([(k, -1, 0, pack(*[np.zeros(0, np.int64)] * n)) for k, n in ((1, 2), (2, 4), (4, 1))], ROWS)
        both.unionByName(none).write.partitionBy("kind").parquet(path)
        for old in merged:
            drop_path(spark, f"{old}/kind=2")
        own = read(path, 1, 1)
        matched = own if matched is None else matched.unionByName(own)
        told = read(path, 4, 4)
        hot = told if hot is None else hot.unionByName(told)
        levels.append((rank, path))
    found = [unpack(r["payload"])[0][0] for r in hot.select("payload").collect()]  # at most MOST_HOT numbers, by hot_least
    return matched.groupBy("bucket").applyInPandas(_gather, "did long, places binary"), np.unique(np.concatenate([*found, np.zeros(0, np.int64)]).view(np.uint64))


def _portions(pdf: pd.DataFrame):
    """The rows in portions of few bytes, so that what is worked out for them stays small."""
    size = np.cumsum([len(x or b"") for x in pdf["data"]])
    for _, rows in pdf.groupby(size // PORTION_BYTES):
        yield rows


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each number is among the rising ones."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _single_windows(cut, d, t, p, size, buckets: int):
    """Rows of the windows of hot anchors, each under its own 128-bit fingerprint; those equal in the task are repeats at once."""
    width, heads = LENGTH + ARM, []
    for i in range(0, len(d), 4096):
        part = slice(i, i + 4096)
        data, windows = np.ascontiguousarray(cut[part, :width]).ravel(), size[part] - LENGTH + 1
        row = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = row * width + within
        f, g = (fingerprints(prefix_sums(data, of_byte), at, at + LENGTH) for of_byte in (_BYTE, _BYTE_AGAIN))
        heads.append((f, g, d[part][row], t[part][row], p[part][row] + within))
    f, g, d, t, start = (np.concatenate(x) for x in zip(*heads, strict=True))
    order = np.lexsort((start, d, g, f))
    f, g, d, t, start = f[order], g[order], d[order], t[order], start[order]
    new = np.append(True, (f[1:] != f[:-1]) | (g[1:] != g[:-1]))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))
    again = (d != d[lead]) | (start != start[lead])
    keep = np.flatnonzero(~again)
    for b, rows in _by_bucket(_bucket_of(f[keep], buckets), buckets):
        rows = keep[rows]
        yield 2, b, pack(f[rows].view(np.int64), g[rows].view(np.int64), d[rows], t[rows], start[rows])
    if again.any():
        marks = _runs(d[again], t[again], start[again])
        yield 1, int(d[again][0] % buckets), pack(*(marks[c].to_numpy(np.int64) for c in ("did", "tid", "lo", "hi")))


def _cut_windows(buckets: int, hot: np.ndarray):
    """Matched anchors' windows with their bytes, by bucket; cuts that are equal in the task are repeats at once."""
    width = LENGTH + ARM

    def run(batches):
        for pdf in (part for batch in batches for part in _portions(batch)):
            wanted = [np.frombuffer(x, "<i8") for x in pdf["places"]]
            did, tid = pdf["did"].to_numpy(np.int64), pdf["tid"].to_numpy(np.int64)
            cuts, heads = [], []
            for data, own, code, h, first, last, shift in runs([t or b"" for t in pdf["data"]]):
                take = np.zeros(len(code), bool)
                begins = np.searchsorted(own, np.arange(len(wanted) + 1))
                for i in np.unique(own).tolist():
                    a, b = begins[i], begins[i + 1]
                    take[a:b] = np.isin(code[a:b], wanted[i])
                own, code, h, first, last, shift = (x[take] for x in (own, code, h, first, last, shift))
                size = last - first + LENGTH
                at = np.minimum(first[:, None] + np.arange(width), len(data) - 1)
                cut = np.where(np.arange(width) < size[:, None], data[at], 0).astype(np.uint8)
                reach = (code // 2 - shift - first).astype(np.uint8)
                cuts.append(np.concatenate([cut, size.astype(np.uint8)[:, None], reach[:, None]], axis=1))
                heads.append((did[own], tid[own], first + shift, h, size))
            if not cuts:
                continue
            cut = np.ascontiguousarray(np.concatenate(cuts))
            d, t, p, h, size = (np.concatenate(x) for x in zip(*heads, strict=True))
            order = np.lexsort((p, d))
            cut, d, t, p, h, size = cut[order], d[order], t[order], p[order], h[order], size[order]
            _, lead, group = np.unique(cut.view(f"V{width + 2}").ravel(), return_index=True, return_inverse=True)
            one = lead[group.ravel()]
            again = (d != d[one]) | (p != p[one])
            out = []
            burning = ~again & _in(h, hot)
            if burning.any():
                out += _single_windows(cut[burning], d[burning], t[burning], p[burning], size[burning], buckets)
            keep = np.flatnonzero(~again & ~burning)
            for b, rows in _by_bucket(_bucket_of(h[keep], buckets), buckets):
                rows = keep[rows]
                tail = b"".join(cut[i, :n].tobytes() for i, n in zip(rows.tolist(), size[rows].tolist(), strict=True))
                out.append((0, b, pack(d[rows], t[rows], p[rows], size[rows], tail=tail)))
            if again.any():
                rows = np.flatnonzero(again)
                out.append((1, int(d[rows[0]] % buckets), pack(d[rows], t[rows], p[rows], p[rows] + size[rows] - LENGTH)))
            yield pd.DataFrame(out, columns=["kind", "bucket", "payload"])

    return run


MARKS = "did long, tid long, lo long, hi long"


def _repeats(data: np.ndarray, h, d, t, start, at) -> pd.DataFrame:
    """Runs of windows that equal an earlier one (by id and start); their bytes decide, fingerprints only sort."""
    order = np.lexsort((start, d, h))
    h, d, t, start, at = h[order], d[order], t[order], start[order], at[order]
    equal = np.zeros(len(h), bool)
    equal[1:] = h[1:] == h[:-1]
    span = np.arange(LENGTH)
    for i in range(0, len(h), 65536):
        rows = np.flatnonzero(equal[i : i + 65536]) + i
        equal[rows] = (data[at[rows][:, None] + span] == data[at[rows - 1][:, None] + span]).all(1)
    lead = np.maximum.accumulate(np.where(equal, 0, np.arange(len(h))))
    again = equal & ((d != d[lead]) | (start != start[lead]))
    return _runs(d[again], t[again], start[again])


def _runs(d: np.ndarray, t: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """First and last start of the runs of windows."""
    order = np.lexsort((start, t, d))
    d, t, start = d[order], t[order], start[order]
    new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (start[1:] > start[:-1] + 1))[: len(d)]
    first = np.flatnonzero(new)
    return pd.DataFrame({"did": d[first], "tid": t[first], "lo": start[first], "hi": start[np.append(first[1:], len(d))[: len(first)] - 1]})


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """First and last start of the runs of repeated windows of one bucket."""
    told = [unpack(p)[0] for p in pdf.loc[pdf["kind"] == 1, "payload"]]
    out = [pd.DataFrame(dict(zip(("did", "tid", "lo", "hi"), x, strict=True))) for x in told]
    single = [unpack(p)[0] for p in pdf.loc[pdf["kind"] == 2, "payload"]]
    if single:
        f, g, d, t, start = (np.concatenate([x[i] for x in single]) for i in range(5))
        order = np.lexsort((start, d, g, f))
        f, g, d, t, start = f[order], g[order], d[order], t[order], start[order]
        lead = np.maximum.accumulate(np.where(np.append(True, (f[1:] != f[:-1]) | (g[1:] != g[:-1])), np.arange(len(f)), 0))
        again = (d != d[lead]) | (start != start[lead])
        if again.any():
            out.append(_runs(d[again], t[again], start[again]))
    cuts = [unpack(p) for p in pdf.loc[pdf["kind"] == 0, "payload"]]
    if cuts:
        d, t, p, size = (np.concatenate([c[0][i] for c in cuts]) for i in range(4))
        data = np.frombuffer(b"".join(c[1] for c in cuts), np.uint8)
        windows, ends = size - LENGTH + 1, np.cumsum(size)
        row = np.repeat(np.arange(len(size)), windows)
        within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(ends - size, windows) + within
        h = np.empty(len(at), np.uint64)
        for part in range(int(ends[-1] >> STRETCH_BITS) + 1):  # whole cuts, in stretches of bounded length
            a, b = np.searchsorted(ends >> STRETCH_BITS, [part, part + 1])
            if a < b:
                own = slice(*np.searchsorted(row, [a, b]))
                begin = int(ends[a] - size[a])
                h[own] = fingerprints(prefix_sums(data[begin : ends[b - 1]]), at[own] - begin, at[own] - begin + LENGTH)
        parts = len(h) // COMPARED_WINDOWS + 1
        for part in range(parts):  # equal windows have equal fingerprints, so parts of the fingerprints can go one by one
            mine = np.flatnonzero(h % np.uint64(parts) == part)
            marks = _repeats(data, h[mine], d[row[mine]], t[row[mine]], p[row[mine]] + within[mine], at[mine])
            if len(marks):
                out.append(marks)
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("did", "tid", "lo", "hi")})


def _drop(with_text: bool):
    def run(batches):
        for pdf in batches:
            out = []
            for data, tid, marks in zip(pdf["data"], pdf["tid"], pdf["marks"], strict=True):
                data = data or b""
                covered = sorted((m["lo"], m["hi"] + LENGTH) for m in (marks if marks is not None else ()) if m["tid"] == tid)
                merged: list[list[int]] = []
                for a, b in covered:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                ends = [0, *(x for m in merged for x in m), len(data)]
                kept = b"".join(data[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *((kept.decode("utf-8", "replace"),) if with_text else ())))
            yield pd.concat([pdf[["doc_id"]], pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])], axis=1)

    return run


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text (cut code points replaced)."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    did = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(data).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), did.alias("did"), data.alias("data"))
    shares = [i / BATCHES for i in range(1, BATCHES)]
    cuts, size = rows.agg(F.percentile_approx("did", shares, 1000), F.sum(F.length("data"))).first()
    buckets = max(16, -(-(size or 0) // (20 * BUCKET_ANCHORS)))  # two suffixes in 39 bytes
    compared = max(16, -(-(size or 0) // COMPARED_BYTES))
    hot_least = max(HOT_LEAST, (size or 0) // (20 * MOST_HOT))
    places, hot = matched_places(rows, sorted(set(cuts or [])), buckets, compared, hot_least)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.withColumn("tid", F.xxhash64("data")).repartition(parts, "did")
    cuts_out = texts.join(places, "did").mapInPandas(_cut_windows(compared, hot), "kind int, bucket int, payload binary")
    marks = cuts_out.groupBy("bucket").applyInPandas(_compare, MARKS)
    marks = marks.groupBy("did").agg(F.collect_list(F.struct("tid", "lo", "hi")).alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return texts.join(marks, "did", "left").mapInPandas(_drop(with_text), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeated 100-byte strings."""
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
