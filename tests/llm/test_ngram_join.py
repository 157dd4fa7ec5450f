import random

import brute
import numpy as np
import pytest

from palate.llm.ngram_join import ngram_join, walk

SCHEMA = "doc_id bigint, text string, n int, digest string"


def family(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            at = rng.randrange(len(words))
            words[at] = rng.choice(["", "x", "y y", "Zz"])
        yield " ".join(words)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    out = [None, "", " \t\n ", "a b", "A B", "a b c d e", "a\x0bb c d  e", "é\x85x y", "é\x85x y", "a b c d e f"]
    passage = [word() for _ in range(40)]
    for size in (6, 15, 60, 300):
        base = [word() for _ in range(size)]
        for edits in (0, 1, 2, size // 40, size // 25, size // 15):
            out += family(rng, base, 12, edits)
        out += [" ".join(base[i:] + [word() for _ in range(i)]) for i in range(0, size, max(size // 12, 1))]
    for _ in range(60):
        out.append(" ".join([word() for _ in range(rng.randrange(1, 30))] + passage + [word() for _ in range(rng.randrange(1, 90))]))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in ngram_join(df).collect()]
    assert len(got) == len(rows) and set(got) == brute.ngram_join(rows)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ngram_join(df).collect() == []
    df = spark.createDataFrame([(3, "a b c", 1, ""), (3, "a b c", 1, ""), (1, "A b c", 1, ""), (None, None, None, None)], SCHEMA)
    assert sorted(map(str, map(tuple, ngram_join(df).collect()))) == ["(1, 1, 1)", "(3, 1, 1)", "(3, 1, 1)", "(None, 0, None)"]


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, long, 1, ""), (2, long + " end", 1, ""), (3, "z" * 3_000_000, 1, "")], SCHEMA)
    assert {tuple(r) for r in ngram_join(df).collect()} == {(1, 399_996, 1), (2, 399_997, 1), (3, 1, 3)}


def test_walk():
    rng = np.random.default_rng(3)
    probe = np.unique(rng.integers(0, 500, 300)).astype(np.uint64)
    paths = []
    for _ in range(200):
        path = np.unique(np.r_[rng.choice(probe, rng.integers(1, len(probe)), False), rng.integers(0, 900, rng.integers(0, 80)).astype(np.uint64)])
        paths.append(path.astype(np.uint64))
    for path, got in zip(paths, walk(probe, paths)):
        common = len(np.intersect1d(path, probe))
        similar = 100 * common >= 75 * (len(path) + len(probe) - common)
        assert got == common or (got == -1 and not similar)


def test_pairs_astride_the_size_switch(spark):
    rng = random.Random(5)
    rows = []
    for size in range(60, 121):
        for more in (1, 2, size // 8, size // 4, size // 3):
            base = [f"w{rng.randrange(10**9)}" for _ in range(size + 4)]
            rows += [" ".join(base), " ".join(base + [f"e{rng.randrange(10**9)}" for _ in range(more)])]
    rows = list(enumerate(rows))
    rows.append((len(rows), rows[0][1] + " " + rows[-1][1]))
    got = {tuple(r) for r in ngram_join(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)).collect()}
    # Pairs differ in all words, so only the two of one base can be linked.
    want, sets = set(), [brute.shingles(t) for _, t in rows]
    for i in range(0, len(rows) - 1, 2):
        both, either = len(sets[i] & sets[i + 1]), len(sets[i] | sets[i + 1])
        want |= {(i, len(sets[i]), i), (i + 1, len(sets[i + 1]), i if 100 * both >= 75 * either else i + 1)}
    assert got == want | {(len(rows) - 1, len(sets[-1]), len(rows) - 1)}


def test_families_of_small_sets(spark):
    """Members that different pivots closed, with links only between those: many families, each with words of its own."""
    rows = []
    for seed in range(300):
        rng = random.Random(seed)
        base = [f"f{seed}w{k}" for k in range(rng.randrange(10, 25))]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(1, 4)):
                at = rng.choice([rng.randrange(len(words)), 0, len(words) - 1])
                words[at : at + rng.randrange(2)] = [f"f{seed}x{rng.randrange(6)}"] if rng.random() < 0.6 else []
            rows.append((len(rows), " ".join(words)))
    got = {tuple(r) for r in ngram_join(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(8)).collect()}
    want = set()
    for at in range(0, len(rows), 40):
        want |= brute.ngram_join(rows[at : at + 40])
    assert got == want
