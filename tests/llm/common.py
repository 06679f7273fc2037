"""Small fixtures: words, documents with every odd case, comparisons with DuckDB."""

import random

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, fp string, ids string"


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_texts():
    """Null, empty, white space, one word, very long, repeated, mixed case, wide characters."""
    long = words(30_000, 99)
    return [None, "", " \t\n\r\x0b\x0c ", "one", "Two Words", long, long, words(300, 1), words(300, 1), words(300, 1) + " tail", "É ß 𝒳 🙂 naïve", "a" * 5000, "12 " * 3000, words(120, 5), words(120, 5).upper()]


def frame(spark, texts, source=lambda i: f"s{i % 3}"):
    """Documents with clashing extra columns; ids are given once, the last two rows have none."""
    rows = [(i, t, "en", source(i), len(t or ""), 0.5, 7, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, 10, None, None, None, None)] * 2
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def same_as_sql(df, sql, **tables):
    """Rows of a frame against DuckDB over the same tables."""
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(f"{name}_", t.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    key = lambda row: tuple((x is not None, x) for x in row)
    want = sorted((tuple(r) for r in con.execute(f"SELECT {columns} FROM ({sql})").fetchall()), key=key)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == want, [(a, b) for a, b in zip(got, want) if a != b][:3]
