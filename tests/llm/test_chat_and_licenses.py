import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from palate.llm.chat_repair import COSTS, STATES, chat_repair, forward, moves
from palate.llm.license_scan import KNOWN, SPELLINGS, full_texts, license_scan, normal


def least(roles):
    """The cheapest of all sequences of moves."""
    best = {"start": 0}
    ways = [("start", 0)]
    for role in roles:
        ways = [(to, cost + price) for state, cost in ways for price, _, to, _ in moves(state, role)]
    del best
    return min(c for _, c in ways)


def test_least_cost():
    for n in range(1, 5):
        for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
            assert min(forward(list(roles), "start")[0].values()) == least(roles)


def test_pieces_like_one_piece(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "x"]), f"t{t}", "e") for c in (1, 2, None) for t in range(400 if c == 1 else 7)]
    rows += [(5, 0, "user", None, ""), (5, 0, "user", None, "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")
    out = chat_repair(df).collect()
    kept, spent = defaultdict(list), defaultdict(int)
    role_of = {(c, t): r for c, t, r, _, _ in rows}
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.seq)):
        kept[r.conv_id].append(r)
    for conv, done in kept.items():
        roles = [r.role for r in done if r.part == 0]
        assert all(b in {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[a] for a, b in zip(["start", *roles], roles))
        texts = "".join(r.rendered for r in done)
        if conv != 5:
            turns = [t for c, t, *_ in rows if c == conv]
            assert [x for x in texts.split("\n") if x.startswith("t")] == [f"t{t}" for t in turns]
            spent = sum(COSTS["insert"] for r in done if r.action == "inserted")
            real = [r for r in done if r.action != "inserted"]
            for t, r in zip(turns, real):
                own = role_of[conv, t]
                spent += {"keep": 0, "insert": 0, "relabel": COSTS["relabel"], "merge": COSTS["merge"] + (0 if own == r.role else COSTS["relabel"])}[r.action]
            assert spent == min(forward([role_of[conv, t] for t in turns], "start")[0].values())
    assert chat_repair(df.where("false")).collect() == [] and STATES[0] == "start"


def test_licences(spark):
    rows = [
        (1, "ALL RIGHTS RESERVED", "x"),
        (2, "Text here.\nreleased under  the MIT licence\nmore", "x"),
        (3, "Copyright 2020 Me\nLicensed under the Apache License, Version 2.0", "x"),
        (4, None, None),
        (4, "", None),
        (5, "We say all rights reserved.", None),
    ]
    got = sorted(map(tuple, license_scan(spark.createDataFrame(rows, "doc_id bigint, text string, row string")).collect()), key=str)
    assert got == [
        (1, "Proprietary", 1, "Proprietary"),
        (2, None, 1, "MIT"),
        (3, "Apache-2.0", 1, "Apache-2.0"),
        (4, None, 0, ""),
        (4, None, 0, ""),
        (5, None, 0, ""),
    ]


def test_full_texts_and_wrapped_notices(spark):
    full = dict(reversed(full_texts()))
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0"} <= set(full)
    rows = [(f"full {n}", t) for n, t in full.items()]
    rows += [("mit", "The MIT License (MIT)\n\nCopyright (c) 2020 Me\n\n" + full["MIT"].replace("\n", " "))]
    rows += [("wrapped", "Text.\n\n  This work is licensed under the GNU General\n  Public Licence, version 3.\n \nMore."), ("own", "x\n\nMy own\nterms")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: tuple(r)[1:] for r in license_scan(df).collect()}
    assert all(got[f"full {n}"][0] == n for n in full) and got["mit"][0] == "MIT"
    assert got["wrapped"] == (None, 0, "GPL-3.0") and got["own"] == (None, 0, "")
    given = license_scan(df, texts=spark.createDataFrame([("Own", "my own terms")], "licence string, text string")).collect()
    assert [r.doc_id for r in given if r.licences] == ["own"]


def test_units_are_normalised_like_each_alone(spark):
    """Whole texts come from their lines, with literal searches for the spellings; each unit alone gives the same."""
    assert str(normal(F.col("text"))).count("regexp_replace") == 2

    def alone(text):
        out = re.sub(r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*$", "", re.sub(r"\r(?!\n)", "\n", text.lower()))
        for said, same in SPELLINGS:
            out = out.replace(said, same)
        return re.sub("[^a-z0-9à-ɏ]+", " ", out).strip(" ")

    mit = "Released under the\n MIT Licence."
    texts = [mit, f"a\n\n{mit}\n \t\n\nb", f"Copyright me\n{mit}", f"x\r\n\r\n(c) you\r\n{mit}\r\n\r\ny", f"\n\n{mit}", "All rights\rreserved.\nAll rights reserved"]
    texts += [f"a\n\n\f copyright z\n{mit}", "a\n--\nAll rights reserved", "ALL RİGHTS reserved", f"©\n{mit}\n©", "copyrights\nall rights reserved"]
    names = {alone(text): name for name, text in KNOWN}
    got = {r.doc_id: tuple(r)[1:] for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        lines = [names[alone(x)] for x in text.split("\n") if alone(x) in names]
        parts = [names[alone(p)] for p in re.split(r"\n[ \t\r]*\n\s*", text) if "\n" in p.strip(" ") and alone(p) in names]
        whole = names.get(alone(text))
        assert got[i] == (whole, len(lines), ",".join(sorted({*lines, *parts, *([whole] if whole else [])}))), (text, got[i])
