"""State by event time: streams over shuffled, late input against their batch twins; idle keys leave the state; a flag is consumed once."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import sessions as S
from memloom.streaming import ordered as O
from memloom.streaming import streams

SCHEMA = "session_id long, event_id long, kind string, ts timestamp"
START = 1_704_067_200


def rows(kinds, n=150, keys=4, seed=1):
    """Events of a few sessions within two days, some at the same second, and a null key and time."""
    r = random.Random(seed)
    return [(r.randrange(keys), i, r.choice(kinds), START + r.randrange(0, 172_800, 600) + r.choice([0, 1])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts"))


def stream(spark, tmp_path, data, files=3):
    """The events shuffled over files, a file a batch; then one of a far day, which moves the watermark past all, and one that is too late."""
    data = [*data, (None, 9_000, "start", START), (0, 9_001, "start", None)]
    random.Random(3).shuffle(data)
    late = (0, 9_002, "late", START - 10**6)
    for i in range(files):
        frame(spark, data[i::files]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "3 days")
    ends = [frame(spark, [(99, 9_999, "end", START + 40 * 86_400)]), frame(spark, [late, (98, 10_000, "end", START + 41 * 86_400)])]
    return read, ends


def run(spark, tmp_path, read, ends, operator):
    out = operator(read()).where("session_id < 90").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for end in [None, *ends]:
        if end is not None:
            end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = out.trigger(availableNow=True).start()
        query.awaitTermination(200)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())), query


CASES = {
    "scores": (["unproven", "other"], O.scores, lambda df: O.scores_in_batch(df)),
    "pending": (["claim", "proof", "other"], lambda e: O.pending(e, 3), lambda df: O.pending_in_batch(df, 3)),
    "recoveries": (["compaction", "start", "other"], O.recoveries, lambda df: O.recoveries_in_batch(df)),
    "rate": (["other"], lambda e: O.rate_limited(e, 2, 7200), None),
    "calls": (["other"], lambda e: O.recent_calls(e, 7200, 5), None),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_stream_equals_batch_and_state_empties(spark, tmp_path, case):
    kinds, operator, twin = CASES[case]
    data = rows(kinds)
    if case in ("rate", "calls"):  # seconds are distinct in a session, as the twins order or group by them
        data = list({(k, t): (k, i, kind, t) for k, i, kind, t in data}.values())
    df = frame(spark, data)
    if case == "rate":
        want = streams.accepted_in_batch(df.select(F.col("session_id").alias("key"), "ts"), 2, 7200).join(df.withColumnRenamed("session_id", "key"), ["key", "ts"]).select("key", "event_id", "ts", "accepted")
    elif case == "calls":
        want = S.recent_calls(df, 7200, 5).join(df, ["event_id", "session_id"]).select("session_id", "event_id", "ts", F.col("recent").cast("long"))
    else:
        want = twin(df)
    read, ends = stream(spark, tmp_path, data)
    got, query = run(spark, tmp_path, read, ends, operator)
    assert len(got) > 10 and got == sorted(map(tuple, want.collect()))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # only the two far events (waiting, timers) are left


def test_a_compaction_is_consumed_once(spark):
    data = [(1, 1, "compaction", START), (1, 2, "start", START + 60), (1, 3, "start", START + 120), (2, 4, "compaction", START), (2, 5, "start", START + 7200), (2, 6, "start", START + 7260), (3, 7, "compaction", START), (3, 8, "compaction", START + 30), (3, 9, "start", START + 90)]
    got = sorted((r.event_id, r.compacted.timestamp() - START) for r in O.recoveries_in_batch(frame(spark, data)).collect())
    assert got == [(2, 0.0), (9, 30.0)]
