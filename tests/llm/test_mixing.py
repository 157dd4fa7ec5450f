from collections import Counter

import pytest

from palate.llm.mixing import TEMPERATURE, mix, rake, sample

SCHEMA = "doc_id bigint, text string, lang string, source string, p string, tokens int"


def test_margins_are_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 900), ("a", "y", "t", 50), ("b", "x", "u", 40), ("b", "y", "t", 10), (None, "x", "u", 30)], "source string, lang string, topic string, weight bigint")
    rows = rake(cells, rounds=60).collect()
    raked = [(r.source, r.lang, r.topic, r.factor * r.weight) for r in rows]
    for at, name in enumerate(("source", "lang", "topic")):
        seen, got = Counter(), Counter()
        for r, row in zip(rows, raked):
            seen[r[name]] += r.weight
            got[r[name]] += row[3]
        total = sum(v**TEMPERATURE for v in seen.values())
        for k, v in seen.items():
            assert got[k] == pytest.approx(v**TEMPERATURE / total, rel=1e-3)


def test_edge_rows(spark):
    rows = [(1, None, None, None, "q", 1), (2, "", "en", "s", "q", 1), (3, "a b", "en", "s", "q", 1), (3, "a b", "en", "s", "q", 1), (None, "a", None, "s", "q", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mix(df).count() == 5 and sample(df).columns == df.columns
    assert mix(df.where("false")).count() == 0
    assert sample(df).collect() == sample(df.repartition(3)).collect() or sample(df).count() == sample(df.repartition(3)).count()


def test_default_targets_move_weight_to_small_sources(spark):
    """Of two sources with 90 and 10 % of the tokens the large one gives way noticeably."""
    rows = [(i, "one two three", "en", "large" if i % 10 else "small") for i in range(200)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    large = {r["probability"] for r in out.where("in_3 = 'large'").collect()}
    assert max(large) < 0.85 and {r["probability"] for r in out.where("in_3 = 'small'").collect()} == {1.0}


def test_a_step_is_one_join(spark, monkeypatch):
    """Targets are joined once, so a round has one join for each margin."""
    cells = spark.createDataFrame([("a", "x", "t", 9), ("b", "y", None, 4), (None, "y", "t", 2)], "source string, lang string, topic string, weight bigint")
    joins, frame = [], type(cells)
    before = frame.join
    monkeypatch.setattr(frame, "join", lambda self, *a, **b: joins.append(1) or before(self, *a, **b))
    rows = rake(cells, rounds=2)
    assert len(joins) == 3 + 2 * 3 and rows.columns == [*cells.columns, "factor"] and rows.count() == 3
