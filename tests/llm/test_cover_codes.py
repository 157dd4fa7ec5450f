import numpy as np
import pytest

from palate.llm import cover_codes as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, code int"


def plain(x, ids, labels):
    q = np.floor(256 * x.astype(float)).astype(np.int64).reshape(len(x), C.PARTS, -1)
    books = q[np.argsort(ids, kind="stable")[: C.ENTRIES]].transpose(1, 0, 2).copy()
    for turn in range(C.ROUNDS + 1):
        far = ((q.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(-1)
        near = far.argmin(2)
        for p in range(C.PARTS):
            for k in np.unique(near[p]) if turn < C.ROUNDS else []:
                mine = q[near[p] == k, p]
                books[p, k] = mine.sum(0) // len(mine)
    error = far.min(2).sum(0)
    total = {label: int(sum(e for e, other in zip(error, labels) if other == label)) for label in set(labels)}
    return {(int(i), bytes(near[:, n].tolist()).hex(), int(error[n]), total[labels[n]]) for n, i in enumerate(ids)}, C.books_digest(books)


@pytest.mark.parametrize("kind", ["normal", "family", "ties"])
def test_against_all_comparisons(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 32)) / 4
    if kind == "family":
        x[::3] = x[0] + rng.normal(size=(300, 32)) * 0.01
    if kind == "ties":
        x = np.round(x * 4) / 256 * 3
    x = x.astype(np.float32)
    ids, labels = rng.permutation(900) * 7, [None if i % 5 == 0 else i % 3 for i in range(900)]
    rows = [(int(i), v.tolist(), lab, "", 0) for i, v, lab in zip(ids, x, labels)]
    odd = [None, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32]
    rows += [(-1 - i, v, 0, "", 0) for i, v in enumerate(odd)]
    got = C.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want, digest = plain(x, ids, labels)
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in got} == want and len(got) == 900
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_trees_cover_and_separate():
    rng = np.random.default_rng(5)
    points = np.r_[rng.integers(-60, 60, (500, 3)), np.repeat(rng.integers(-9, 9, (100, 3)), 5, 0)]
    tree = C.build(points, 2)
    placed = points[tree["order"]]
    assert sorted(tree["order"]) == list(range(1000))
    for i in range(len(tree["start"])):
        start, n = tree["start"][i], tree["count"][i]
        mine = placed[start : start + n]
        assert (mine.sum(0) == tree["sums"][i]).all()
        assert np.isclose(np.sqrt(((mine - mine[0]) ** 2).sum(1).max()), tree["radius"][i])
        kids = np.arange(tree["first"][i], tree["first"][i] + tree["children"][i])
        assert not len(kids) or (tree["start"][kids[0]] == start and tree["count"][kids].sum() == n)
        if len(kids) > 1:
            centres = placed[tree["start"][kids]]
            gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(-1))[np.triu_indices(len(kids), 1)]
            assert gaps.min() > tree["radius"][kids].max()
        assert len(kids) or n <= C.LEAF or tree["radius"][i] == 0


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(6)
    far = rng.integers(-2000, 2000, (8, 4))
    points = (far[rng.integers(0, 8, 4000)] + rng.integers(-20, 20, (4000, 4))).astype(np.int64)
    tree = C.build(points, 1)
    done = C.Assigner(tree, points[tree["order"]], far[None])
    assert sum(len(place) for place, _ in done.single) < 400
    assert (done.labels() == ((points[tree["order"]][:, None] - far) ** 2).sum(-1).argmin(1)).all()


def test_few_odd_and_empty(spark):
    assert C.report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, [0.5] * 16, None, "", 0), (4, [1e30] * 16, 1, "", 0), (4, [1e30] * 16, 1, "", 0), (2, [1.0], 1, "", 0), (9, [], 1, "", 0)]
    got = C.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == [
        ("2", None, None), ("4", "00" * 16, 0), ("4", "00" * 16, 0), ("9", None, None), ("None", "02" * 16, 0)
    ]
    assert [r.code for r in C.report(spark.createDataFrame([(1, [1.0], 1, "", 0)], SCHEMA)).collect()] == [None]
