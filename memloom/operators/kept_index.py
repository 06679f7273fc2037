"""A keyword index that is kept, not recomputed: postings in segments, tombstones, and merges of segments.

Layout below a folder that all machines share:
  postings/seg=<k>/bucket=<b>   term, id, tf, dl, sorted by term; a term's bucket is a digest of it
  docs/seg=<k>                  id, dl of every document of the segment
  gone/seg=<k>                  ids whose entries in earlier segments are void (changed or deleted)
  manifest/version=<v>          one row: segments in use, their documents, live documents and terms

A batch of new, changed and deleted ids writes one segment and then the manifest's next version, a single file: readers see all
of a batch or nothing of it, and a batch that failed before is written over. The last segments are merged as soon as an earlier
one is no longer twice as large as all behind it, so each entry is rewritten a logarithmic number of times. A search reads only
the buckets of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .retrieval import WANTED_WORDS, _bm25_top

BUCKETS, SPLITS = 64, 4
#: Postings that a task sorts, about; the number of tasks follows from it.
TASK_POSTINGS = 1_000_000
#: Documents of earlier segments that later ones void, up to which they are sent to every task instead of dealing the postings by id.
BROADCAST_VOID = 1_500_000
MANIFEST = "segments array<long>, sizes array<long>, buckets int, n long, terms long, version int"


def words(text: Column) -> Column:
    """The lower-cased words of a text, as the keyword lane has them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+(?:[.-]\w+)*"), F.lit(0))


def manifest(spark: SparkSession, path: str) -> Row | None:
    """The last complete version."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.orderBy(F.desc("version")).first()


def _part(spark: SparkSession, path: str, name: str, columns: str, segments: list[int]) -> DataFrame:
    return spark.read.schema(columns).parquet(f"{path}/{name}").where(F.col("seg").isin(segments))


def _docs(spark, path, segments):
    return _part(spark, path, "docs", "id string, dl long, seg long", segments)


def _postings(spark, path, segments):
    return _part(spark, path, "postings", "term string, id string, tf long, dl long, seg long, bucket int", segments)


def _tasks(postings: int) -> int:
    return max(1, -(-postings // TASK_POSTINGS))


def _alive(entries: DataFrame, path: str, segments: list[int], n: int = 0) -> DataFrame:
    """Entries (about n) that no later segment voids."""
    spark = entries.sparkSession
    gone = _part(spark, path, "gone", "id string, seg long", segments).groupBy("id").agg(F.max("seg").alias("_gone"))
    void = _docs(spark, path, segments).join(gone, "id").where("_gone > seg").select("id", "seg")
    if void.limit(BROADCAST_VOID + 1).count() <= BROADCAST_VOID:
        return entries.join(F.broadcast(void), ["id", "seg"], "left_anti")
    dealt = entries.repartition(_tasks(n), "id", "seg")
    return dealt.join(void.repartition(_tasks(n), "id", "seg"), ["id", "seg"], "left_anti")


def _write_segment(path: str, seg: int, postings: DataFrame, docs: DataFrame, gone: DataFrame, n: int | None = None) -> None:
    """postings: bucket, term, id, tf, dl, about n of them (counted if not told). A bucket is dealt to SPLITS tasks and files, or more as the index grows, so that what a task sorts doesn't."""
    n = postings.count() if n is None else n
    tasks, buckets = _tasks(n), F.pmod(F.xxhash64("id"), F.lit(max(SPLITS, -(-4 * n // (TASK_POSTINGS * BUCKETS)))))
    dealt = postings.repartition(tasks, "bucket", buckets).sortWithinPartitions("bucket", "term", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/seg={seg}")
    docs.select("id", "dl").write.mode("overwrite").parquet(f"{path}/docs/seg={seg}")
    gone.select("id").write.mode("overwrite").parquet(f"{path}/gone/seg={seg}")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of a text's terms (ts) the distinct ones and how often each stands there (tfs)."""
    for batch in batches:
        ts = batch.column("ts")
        encoded = ts.flatten().dictionary_encode()
        size = max(len(encoded.dictionary), 1)
        row = np.repeat(np.arange(len(ts), dtype=np.int64), np.diff(ts.offsets.to_numpy()))
        pairs, times = np.unique(row * size + encoded.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(len(ts) + 1) * size), pa.int32())
        once = encoded.dictionary.take(pa.array(pairs % size)).cast(pa.string())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (once, pa.array(times, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dl"), *lists], names=["id", "dl", "terms", "tfs"])


def _publish(spark: SparkSession, path: str, version: int, segments: list[int], sizes: list[int], buckets: int) -> None:
    n, terms = _alive(_docs(spark, path, segments), path, segments).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    row = spark.createDataFrame([(segments, sizes, buckets, n, terms)], MANIFEST.rsplit(",", 1)[0])
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def apply_batch(path: str, changed: DataFrame, deleted: DataFrame | None = None, terms: Callable[[Column], Column] = words, buckets: int = BUCKETS) -> None:
    """Index a batch: `changed` (id, text) holds new and changed documents, `deleted` (id) those that go; then merge where it is due.

    Of several texts of an id the greatest counts, an id both changed and deleted goes, null ids are left out, null texts have no
    terms but count as documents. `buckets` holds for a new index; one index has one kind of terms.
    """
    spark = changed.sparkSession
    last = manifest(spark, path)
    seg, buckets = (last["version"] + 1, last["buckets"]) if last else (1, buckets)
    rows = changed.where("id IS NOT NULL").select("id", "text")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():  # else texts needn't be shuffled
        rows = rows.groupBy("id").agg(F.max("text").alias("text"))
    void = rows.select("id")
    if deleted is not None:
        rows = rows.join(deleted.select("id").distinct(), "id", "left_anti")
        void = void.unionByName(deleted.where("id IS NOT NULL").select("id")).distinct()
    split = rows.select("id", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("ts"))
    counted = split.select("id", F.size("ts").cast("long").alias("dl"), "ts").mapInArrow(_count_terms, "id string, dl long, terms array<string>, tfs array<long>")
    counted = written(counted, "counted")  # a text's terms are counted in its row
    n = counted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    postings = counted.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("id", "dl", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    _write_segment(path, seg, postings.withColumn("bucket", _bucket(F.col("term"), buckets)).select("bucket", "term", "id", "tf", "dl"), counted, void, n)
    segments, sizes = (list(last["segments"]), list(last["sizes"])) if last else ([], [])
    _publish(spark, path, seg, [*segments, seg], [*sizes, _docs(spark, path, [seg]).count()], buckets)
    _merge_due(spark, path)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _merge_due(spark: SparkSession, path: str) -> None:
    """Merge the longest run of last segments whose first is smaller than twice what follows it."""
    last = manifest(spark, path)
    sizes = list(last["sizes"])
    start = next((i for i in range(len(sizes) - 1) if sizes[i] < 2 * sum(sizes[i + 1 :])), None)
    if start is not None:
        merge(spark, path, start)


def merge(spark: SparkSession, path: str, start: int = 0) -> None:
    """Replace the segments from place `start` on by one, without the entries that are void; earlier segments keep their tombstones."""
    last = manifest(spark, path)
    kept, merged = list(last["segments"])[:start], list(last["segments"])[start:]
    if len(merged) < 2 and start:
        return
    seg = last["version"] + 1
    gone = _part(spark, path, "gone", "id string, seg long", merged).select("id").distinct() if kept else spark.createDataFrame([], "id string")
    n = _postings(spark, path, merged).count()
    postings = _alive(_postings(spark, path, merged), path, merged, n).select("bucket", "term", "id", "tf", "dl")
    _write_segment(path, seg, postings, _alive(_docs(spark, path, merged), path, merged), gone, n)
    _publish(spark, path, seg, [*kept, seg], [*list(last["sizes"])[:start], _docs(spark, path, [seg]).count()], last["buckets"])


def lookup(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """term, id, tf, dl: the live postings of the terms (term), from their buckets alone."""
    last = manifest(spark, path)
    if last is None:
        return spark.createDataFrame([], "term string, id string, tf long, dl long")
    segments = list(last["segments"])
    wanted = terms.select("term").distinct()
    read = sorted(r[0] for r in wanted.select(_bucket(F.col("term"), last["buckets"])).distinct().collect())  # at most the number of buckets
    few = [r["term"] for r in wanted.limit(WANTED_WORDS + 1).collect()]
    found = _postings(spark, path, segments).where(F.col("bucket").isin(read))
    found = found.where(F.col("term").isin(few)) if len(few) <= WANTED_WORDS else found.join(wanted, "term", "left_semi")
    return _alive(found, path, segments, found.count()).select("term", "id", "tf", "dl")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """K3 over the kept index of words: query_id, id, score, rank. queries: query_id, q; words under three characters match nothing."""
    tokens = queries.select("query_id", F.explode(T.query_tokens(F.col("q"))).alias("w")).where(F.length("w") >= 3)
    last = manifest(spark, path)
    n, terms = (last["n"], last["terms"]) if last else (0, 0)
    totals = spark.range(1).select(F.lit(n).alias("n"), F.lit(terms / n if n else 1.0).alias("avgdl"))
    tf = lookup(spark, path, tokens.select(F.col("w").alias("term"))).withColumnRenamed("term", "w")
    return _bm25_top(tf, totals, tokens, k, ())
