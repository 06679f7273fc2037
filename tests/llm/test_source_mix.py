from collections import Counter

import pytest

from memloom.llm import source_mix as op

from .common import empty, frame, odd_texts, same_as_sql, words


def result(docs):
    return op.mix(docs, ["doc_id"]).drop("copies")


def test_against_sql(spark):
    texts = odd_texts() + [words(20 + i % 50, i) for i in range(300)]
    docs = frame(spark, texts, lambda i: [None, "hot", "hot", "b", "", "z"][i % 6])
    same_as_sql(result(docs), op.ORACLE_SQL["op7_mix_sources"], documents=docs)


@pytest.mark.parametrize("rows", [1, 7])
def test_small_ranges_give_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(op, "ROWS_A_RANGE", rows)
    docs = frame(spark, [words(5 + i % 9, i) for i in range(120)], lambda i: "hot" if i % 3 else f"s{i % 7}")
    same_as_sql(result(docs), op.ORACLE_SQL["op7_mix_sources"], documents=docs)


def test_targets_and_caps(spark):
    docs = frame(spark, [words(40, i) for i in range(400)], lambda i: f"s{i % 4}")
    rows = [r for r in result(docs).collect() if r.doc_id is not None]
    taken = Counter()
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.target] += r.taken
    for target, n in taken.items():
        assert abs(n - target * sum(1 for t in {(x.target, x.doc_id % 4) for x in rows} if t[0] == target)) <= 200
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in result(docs).collect() if r.doc_id is not None)


def test_empty_and_repeated_rows(spark):
    assert result(empty(spark)).count() == 0
    one = frame(spark, ["a b c"])
    assert result(one.unionAll(one)).count() == 6
    whole = op.repeated(one)
    assert whole.columns == one.columns and whole.count() == op.mix(one, ["doc_id"]).groupBy().sum("copies").first()[0]
