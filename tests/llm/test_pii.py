import hashlib
import random

import brute

from palate.llm.pii import mask, report

SCHEMA = "doc_id bigint, text string, lang string, row string, t string"


def noise(seed, n):
    rng = random.Random(seed)
    bits = ["a@b.c", "a@b.c_d@e.f", "x@y", "@", ".", "..", "a.b@c-d.e.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (952) 555-4063", "+12", "+1.", "é", "𝄞", " ", "-", "\n", "+49 30 1234567890123",
            "7", "12", "%", "_", "99999999999999999999", "4524132264652876", "key=9"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_base_like_plain_patterns(spark):
    texts = [None, "", *noise(1, 400), "a" * 20000, "1" * 20000, "1." * 20000, "a@" + "b." * 20000, "+" * 5000 + "1" * 5000, "1 " * 9000, "x1@y.z " * 1500]
    df = spark.createDataFrame([(i, t, "", "r", "q") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    rows = {r.doc_id: r for r in report(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = brute.base_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:200]
        assert rows[i].n_email == sum(w.startswith("email") for w in want) and rows[i].n_phone == sum(w.startswith("phone") for w in want)
        assert set(want) <= set(rows[i].spans.split(","))


def test_patterns_find_other_identifiers(spark):
    texts = [f"Please write to me at mail address u{i}@x.org today or so" for i in range(12)]
    texts += ["we send it to mail address ZX-99812 now", "they paid 300 today", "see page 12 of it"]
    df = spark.createDataFrame([(i, t, "", "r", "q") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r.spans for r in report(df).collect()}
    at = texts[12].index("ZX")
    assert rows[12] == f"other:{at}:{at + 8}" and rows[13] == "" and rows[14] == ""


def test_mask_and_empty(spark):
    df = spark.createDataFrame([(1, "a é a@b.c x +1 (952) 555-4063, 1.2.3.4", "en", "r", None), (2, None, None, None, None), (2, None, None, None, None)], SCHEMA)
    out = sorted(map(str, map(tuple, mask(df).collect())))
    assert mask(df).columns == df.columns
    assert out[0] == "(1, 'a é <EMAIL> x <PHONE>, <IP>', 'en', 'r', None)" and out[1] == out[2]
    assert report(df.where("false")).collect() == [] and mask(df.where("false")).collect() == []
