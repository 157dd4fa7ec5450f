import zlib

from palate.llm.pu_classifier import keep_good, pu_classifier

SCHEMA = "doc_id bigint, text string, lang string, source string, h string, features string"


def test_classifier(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 91}" for k in range(60)), "en", "s", "", "") for i in range(150)]
    bad = [(1000 + i, "BUY!! " * (20 + i % 9), "en", "s", "", "") for i in range(50)]
    df = spark.createDataFrame([*good, *bad, (5000, None, None, None, None, None), (None, "", None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad], "doc_id bigint, quality int")
    rows = pu_classifier(df, labels).collect()
    assert len(rows) == 202 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held_out and r.doc_id < 2000]
    assert sum(r.predicted == int(r.doc_id < 1000) for r in held) >= 0.95 * len(held)
    assert keep_good(df, labels).columns == df.columns
    assert pu_classifier(df.where("false"), labels).collect() == []
    assert {r.score for r in pu_classifier(df, labels.where("false")).collect()} == {0.5}
