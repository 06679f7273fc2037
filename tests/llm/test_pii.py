import hashlib
import re

from memloom.llm import pii as op

from .common import empty, frame, odd_texts, rows_of, same_as_sql, words

CASES = [
    "mail a.b+c@x-y.example.com, a@b or c@d.e_f@g.h now",
    "hosts 1.2.3.4 999.1.1.1 001.02.3.255 1.2.3.4.5.6.7.8 0000255.1.1.1 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 5500000000000004",
    "call +1 (555) 123-4567 or +12 34 or + 1 555 or +49(0)30.123456-78",
    "iban DE89370400440532013000 and DE89 3704 0044 0532 0130 01, FR1420041010050500013M02606",
    "ssn 078-05-1120 but 078-05-11205",
    "a" * 60_000 + "@b.c " + "1" * 60_000 + " " + "1 " * 30_000 + "+" * 1000,
    "é🙂x@y.zz tail 10.0.0.1",
]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    out = []
    for k, (kind, (pattern, ok)) in enumerate(checks.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_base_spans(spark):
    texts = odd_texts() + [c for c in CASES if len(c) < 1000]
    got = rows_of(op.find(frame(spark, texts)))
    for i, t in enumerate(texts):
        mine = [f"{s.kind}:{s.s}:{s.e}" for s in got[i].spans if s.kind in op.BASE_KINDS]
        assert mine == base(t), (i, t and t[:60])


def test_long_runs_neither_overflow_nor_crawl(spark):
    got = rows_of(op.find(frame(spark, [CASES[6]])))[0].spans
    assert [(s.kind, s.s) for s in got] == [("email", 0)]


def test_added_kinds_and_scores(spark):
    got = rows_of(op.find(frame(spark, CASES)))
    assert [CASES[4][s.s : s.e] for s in got[4].spans if s.kind == "iban"] == ["DE89370400440532013000", "FR1420041010050500013M02606"]
    assert [s.kind for s in got[5].spans] == ["ssn"]
    scores = [s.score for s in got[2].spans if s.kind == "card"]
    assert round(scores[0], 6) == 0.9 and round(scores[-1], 6) == 0.7  # the word card stands near the first only


def test_query_columns_against_sql(spark, tmp_path):
    docs = frame(spark, [t for t in odd_texts() + CASES[:4] + CASES[7:]] + [words(50, i) for i in range(20)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = op.op6_pii(spark, str(tmp_path))
    assert df.where("doc_id = 0").first().base_sha256 == hashlib.sha256(b"").hexdigest()
    same_as_sql(df, op.ORACLE_SQL["op6_pii"], documents=docs)


def test_redaction_keeps_the_rest(spark):
    docs = frame(spark, CASES[:3] + [None])
    got = rows_of(op.redact(docs))
    assert got[0].text.startswith("mail <EMAIL>, a@b or <EMAIL>") and "4111 1111 1111 1111" not in got[2].text and got[3].text is None
    assert op.redact(docs).columns == docs.columns and op.find(empty(spark)).count() == 0
