import brute
import numpy as np

from palate.llm.embed_dedup import LINK, TARGET, embed_dedup, fit

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string"


def test_recall_and_precision(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 16))
    near = np.repeat(base[:40], 12, 0) + rng.normal(size=(480, 16)) * 0.12
    x = np.r_[base, near, np.repeat(base[60:61], 300, 0)].astype(np.float32)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0]]
    rows += [(len(x) + i, v, 0, "") for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in embed_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(1)
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    if (have == want).all():
        label = brute.find_components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(link)) if a < b])
        assert all(got[i].component_id == label[i] and got[i].kept == (label[i] == i) for i in range(len(x)))
    assert all(got[len(x) + i].n_links == 0 and got[len(x) + i].kept for i in range(len(odd)))


def test_empty(spark):
    assert embed_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def recall(grid, x):
    cells = grid.walk(x)
    met = all_ = 0
    for i in range(len(x)):
        linked = x @ x[i] >= LINK
        linked[i] = False
        met += np.isin(cells[linked, 0], cells[i]).sum()
        all_ += linked.sum()
    return met / max(all_, 1)


def test_target_is_met_for_a_family_of_a_third():
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    # Spread in the family: cosines of 0.95 to 0.99 between its members.
    near = rng.normal(size=(1, 64)) * 1.0 + rng.normal(size=(1200, 64)) * rng.uniform(0.1, 0.22, (1200, 1))
    x = unit(rng.permutation(np.r_[rng.normal(size=(2400, 64)), near]))
    sample, others = x[:2400], x[2400:]
    got = recall(fit(sample, 2_000_000), sample), recall(fit(sample, 2_000_000), others)
    print(got)
    assert got[0] >= TARGET and got[1] >= 0.99


def test_a_sample_without_links_is_helped():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape) * 0.1
    y = (x + aside) / np.linalg.norm(x + aside, axis=1, keepdims=True)
    assert recall(fit(x, 200_000), np.r_[x[:700], y[:700]]) >= 0.99
