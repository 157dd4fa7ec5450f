"""Similarity kernel and list building against brute force, on data made to hurt."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palate.operators import evaluation as E
from palate.operators import pruned as P
from palate.operators import ranking as R
from palate.operators import similarity as S
from palate.operators.ranking import diversify, merge_moods, mood_quotas, spread
from palate.operators.taste import listening_patterns, mood_counts
from palate.plans import recommend
from palate.plans.incremental import ListStore, add_prints, fingerprints, refresh
from palate.plans.lifecycle import export_batches, retrain_decision
from palate.session import even_keys, new_path


def brute_top(queries, catalog, k, banned=()):
    out = set()
    for q, v in queries.items():
        scored = []
        for t, w in catalog.items():
            if (q, t) in banned:
                continue
            scale = np.linalg.norm(v) * np.linalg.norm(w)
            scored.append((-round(float(np.dot(v, w) / scale) if scale else 0.0, 9), t))
        for rank, (sim, t) in enumerate(sorted(scored)[:k], start=1):
            out.add((q, t, rank, -sim + 0.0))
    return out


@pytest.mark.parametrize("query_rows, catalog_rows", [(8192, 65536), (16, 25)])
def test_nearest_tracks_is_exact(spark, monkeypatch, query_rows, catalog_rows):
    """Also with many cells, repeated vectors (ties), a zero vector, and one query that owns a third."""
    monkeypatch.setattr(S, "QUERY_ROWS", query_rows)
    monkeypatch.setattr(S, "CATALOG_ROWS", catalog_rows)
    rng = np.random.default_rng(1)
    catalog = {int(t): rng.normal(size=6) for t in range(100, 220)}
    for t in range(150, 190):
        catalog[t] = catalog[150]
    catalog[219] = np.zeros(6)
    queries = {int(q): rng.normal(size=6) for q in range(40)}
    queries[5] = catalog[150]
    banned = {(5, t) for t in range(150, 190)} | {(q, 100 + q) for q in range(40)}
    as_frame = lambda d, name: spark.createDataFrame([(i, v.tolist()) for i, v in d.items()], f"{name} long, vec array<double>")
    found = S.nearest_tracks(
        as_frame(queries, "query_id"),
        as_frame(catalog, "track_id"),
        7,
        exclude=spark.createDataFrame(list(banned), "query_id long, track_id long"),
        n_queries=len(queries),
        n_catalog=len(catalog),
    )
    got = {(r["query_id"], r["track_id"], r["rank"], r["sim"] + 0.0) for r in found.collect()}
    assert got == brute_top(queries, catalog, 7, banned)
    packed = S.nearest_tracks(as_frame(queries, "query_id"), as_frame(catalog, "track_id"), 7, n_queries=40, n_catalog=120, packed=True)
    opened = {(r["query_id"], n["track_id"], n["rank"], n["sim"] + 0.0) for r in packed.collect() for n in r["near"]}
    assert opened == brute_top(queries, catalog, 7)


@pytest.mark.parametrize("spread_out", [0.02, 2.0])
def test_pruned_search_is_exact_and_says_what_it_visited(spark, spread_out):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8))
    catalog = {t: centres[t % 12] + rng.normal(size=8) * spread_out for t in range(600)}
    catalog |= {600: np.zeros(8), 601: catalog[5], 602: catalog[5]}
    queries = {q: centres[q % 12] + rng.normal(size=8) * spread_out for q in range(50)} | {50: np.zeros(8), 51: catalog[5]}
    banned = {(q, t) for q in range(0, 50, 7) for t in range(q % 12, 600, 12)} | {(51, 5), (51, 9999)}
    frame = lambda d, name: spark.createDataFrame([(i, v.tolist()) for i, v in d.items()], f"{name} long, vec array<double>")
    found, visited = P.nearest_pruned(
        frame(queries, "query_id"), frame(catalog, "track_id"), 9, S._cell_kernel(9), 50,
        spark.createDataFrame(list(banned), "query_id long, track_id long"), len(catalog), 40, 16,
    )
    got = {(r["query_id"], r["track_id"], r["rank"], r["sim"] + 0.0) for r in found.collect()}
    assert got == brute_top(queries, catalog, 9, banned)
    share = sum(r["compared"] for r in visited.collect()) / visited.first()["of_all"]
    assert share < 0.4 if spread_out < 1 else share <= 1.0


def test_listeners_without_seed_matches_fall_back_to_the_mean_vector(spark):
    """One listener owns everything near its tracks; its list comes from the mean vector."""
    near = [(t, [1.0, t / 1000, 0.0]) for t in range(8)]
    far = [(t, [0.0, 1.0, t / 1000]) for t in range(8, 20)]
    vectors = spark.createDataFrame(near + far, "track_id long, vec array<double>")
    tracks = spark.createDataFrame(
        [(t, f"title {t}", f"artist {t}", 50, 0.5, 0.5, 0.5) for t in range(20)],
        "track_id long, track_name string, artists string, popularity int, energy double, danceability double, valence double",
    )
    library = spark.createDataFrame(
        [(1, t) for t in range(8)] + [(2, t) for t in (8, 9, 10)] + [(3, 1)], "user_id long, track_id long"
    )
    inputs = recommend.Inputs(library, tracks, tracks.join(vectors, "track_id"), n_listeners=3, n_catalog=20)
    got = recommend.recommend(inputs, n=1).collect()
    assert {r["user_id"] for r in got} == {1, 2}
    lists = {r["user_id"]: r for r in got}
    assert lists[1]["source_track"] is None and lists[1]["track_id"] >= 8
    assert lists[2]["source_track"] == "title 10" and lists[2]["track_id"] == 11


def test_kernel_plan_has_no_cross_join(spark):
    q = spark.range(100).select(F.col("id").alias("query_id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    t = spark.range(100).select(F.col("id").alias("track_id"), F.array(F.rand(3), F.rand(4)).alias("vec"))
    plan = S.nearest_tracks(q, t, 3, n_queries=100, n_catalog=100)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def walk(rows, n):
    """The diversity walk, one row at a time."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    if len(rows) <= n:
        return [r[0] for r in rows]
    picked = []
    for r in rows:
        same_artist = sum(p[3].lower() == r[3].lower() for p in picked)
        if len(picked) < n and same_artist < 2 and all(p[2].lower() != r[2].lower() for p in picked):
            picked.append(r)
    spare = [r for r in rows if r not in picked]
    return [r[0] for r in picked + spare[: n - len(picked)]]


@pytest.mark.parametrize(
    "n, artists, titles, size",
    [(3, 2, 2, 30), (10, 3, 200, 600), (10, 200, 3, 600), (10, 12, 12, 400), (5, 1, 1, 50), (4, 50, 50, 3), (6, 4, 5, 6)],
)
def test_greedy_walk_is_exact_on_long_lists(spark, n, artists, titles, size):
    rng = np.random.default_rng(size + n)
    rows, lists = [], {}
    for user in range(4):
        mine = [
            (t, round(float(rng.integers(0, 200)) / 200, 3), f"Title {rng.integers(titles)}", f"Artist {rng.integers(artists)}")
            for t in range(size)
        ]
        lists[user] = mine
        rows += [(user, *r) for r in mine]
    df = spark.createDataFrame(rows, "user_id long, track_id long, sim double, track_name string, artists string")
    got: dict = {}
    for r in diversify(df, n, ["user_id"]).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["track_id"])
    assert got == {u: walk(mine, n) for u, mine in lists.items()}


@pytest.mark.parametrize("rows_per_batch", [7, 10_000])
def test_walk_over_many_partitions_and_batches(spark, rows_per_batch):
    """One listener holds most rows, spread over all partitions; a track comes from several seeds; some names are missing."""
    rng = np.random.default_rng(rows_per_batch)
    rows = []
    for user, size in ((1, 3000), (2, 40), (3, 8), (4, 3)):
        for _ in range(size):
            t = int(rng.integers(0, size // 2 + 2))
            title, artist = (f"T{t % 37}" if t % 11 else None), (f"A{t % 13}" if t % 7 else None)
            rows.append((user, t, round(1 - t / 4000 - float(rng.integers(0, 2)) / 5000, 6), title, artist, int(rng.integers(0, 9))))
    schema = "user_id long, track_id long, sim double, track_name string, artists string, seed_id long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        got: dict = {}
        for r in diversify(spark.createDataFrame(rows, schema).repartition(6), 8, ["user_id"]).orderBy("user_id", "rank").collect():
            got.setdefault(r["user_id"], []).append((r["track_id"], r["sim"], r["seed_id"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for user in (1, 2, 3, 4):
        best: dict = {}
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: (-r[2], r[1], r[5])):
            best.setdefault(r[1], r)
        # A missing name is like no other.
        mine = [(t, r[2], r[3] or f"no title {t}", r[4] or f"no artist {t}") for t, r in best.items()]
        assert got[user] == [(t, best[t][2], best[t][5]) for t in walk(mine, 8)]


def test_greedy_walk_golden(spark):
    rows = [(1, 1, 0.9, "t1", "A"), (1, 2, 0.8, "t2", "A"), (1, 3, 0.7, "t3", "A"), (1, 4, 0.6, "t3", "B"), (1, 5, 0.5, "t1", "C")]
    df = spark.createDataFrame(rows, "user_id long, track_id long, sim double, track_name string, artists string")
    assert [r["track_id"] for r in diversify(df, 3, ["user_id"]).orderBy("rank").collect()] == [1, 2, 4]


def test_mood_quota_golden(spark):
    rows = [(1, m, i * 100 + j, 1 - (i * 20 + j) / 100) for i, m in enumerate(["a", "b", "c"]) for j in range(20)]
    recs = spark.createDataFrame(rows, "user_id long, source_mood string, track_id long, sim double")
    shares = spark.createDataFrame([(1, "a", 45), (1, "b", 35), (1, "c", 20)], "user_id long, source_mood string, cnt long")
    kept = mood_quotas(recs, 10, shares).collect()
    assert sorted(r["track_id"] for r in kept) == [0, 1, 2, 3, 4, 100, 101, 102, 200, 201]
    assert sorted(r["rank"] for r in kept) == list(range(1, 11))
    few = recs.where("track_id % 100 < 3")
    assert mood_quotas(few, 10, shares).count() == 9


def test_merge_keeps_first_mood(spark):
    df = spark.createDataFrame([(1, 7, 1, "b"), (1, 7, 0, "a"), (1, 8, 1, "b")], "user_id long, track_id long, mood_order int, m string")
    assert sorted((r["track_id"], r["m"]) for r in merge_moods(df).collect()) == [(7, "a"), (8, "b")]


def test_patterns_golden(spark):
    def of(shares):
        df = spark.createDataFrame([(1, m, float(p)) for m, p in shares], "user_id long, mood string, pct double")
        return {r["type"]: r for r in listening_patterns(df).collect()}

    got = of([("Chill", 60), ("Focus", 15), ("Party", 25)])
    assert (got["Primary"]["percentage"], got["Secondary"]["percentage"]) == (60.0, 25.0)
    assert got["Primary"]["description"] == "You primarily listen to chill music (60.0%)"
    assert got["Diversity"]["description"] == "You have diverse music taste"
    assert set(of([("Chill", 85), ("Focus", 15)])) == {"Primary", "Diversity"}


def test_mood_share_counts_all_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "user_id long, mood string")
    assert {(r["user_id"], r["mood"]): r["pct"] for r in mood_counts(df).collect()} == {
        (1, "a"): pytest.approx(200 / 3), (1, "b"): pytest.approx(100 / 3), (2, "b"): 100.0
    }


def test_spread_is_reproducible_and_complete(spark):
    rng = np.random.default_rng(3)
    catalog = spark.createDataFrame([(t, rng.normal(size=4).tolist()) for t in range(60)], "track_id long, vec array<double>")
    rows = [(u, t, float(1 - t / 100), t + 1) for u in range(3) for t in range(40)]
    pool = spark.createDataFrame(rows, "user_id long, track_id long, sim double, rank int")
    one = [tuple(r) for r in spread(pool, catalog, 10, 0.3, seed=5).orderBy("user_id", "rank").collect()]
    two = [tuple(r) for r in spread(pool.repartition(5), catalog, 10, 0.3, seed=5).orderBy("user_id", "rank").collect()]
    assert one == two and len(one) == 30
    assert all(r[2] == 0 for r in one if r[1] == 1) and all(r[2] < R.MMR_POOL * 10 for r in one)
    assert len({(r[0], r[2]) for r in one}) == 30


@pytest.mark.parametrize("days, new, needed, text", [
    (3, 100, True, "Moderate growth (100 new tracks, 3 days)"), (2, 999, False, ""), (7, 0, True, "Weekly retraining due (last: 7 days ago)"),
    (0, 1000, True, "Significant dataset growth (1000 new tracks)"),
])
def test_retrain_decision(spark, days, new, needed, text):
    state = spark.sql(f"""SELECT {5000 + new}L AS dataset_size, 5000L AS last_size, timestamp'2024-01-01' AS last_trained,
        timestamp'2024-01-01' + interval {days} days + interval 3 hours AS now""")
    row = retrain_decision(state).first()
    assert (row["needed"], row["reason"]) == (needed, text)
    first = retrain_decision(state.withColumn("last_trained", F.lit(None).cast("timestamp"))).first()
    assert first["reason"] == "First time retraining"


def test_export_batches(spark):
    recs = spark.createDataFrame(
        [(1, i, i if i % 4 else None) for i in range(1, 281)] + [(2, 1, 5), (2, 2, None)], "user_id long, rank int, track_id long"
    )
    got = export_batches(recs).groupBy("user_id", "batch_no").count().collect()
    assert {(r["user_id"], r["batch_no"]): r["count"] for r in got} == {(1, 0): 100, (1, 1): 100, (1, 2): 10}


def test_only_changed_listeners_are_computed_again(spark):
    rng = np.random.default_rng(12)
    vectors = spark.createDataFrame([(t, rng.normal(size=4).tolist()) for t in range(60)], "track_id long, vec array<double>")
    tracks = vectors.select("track_id", F.lit("t").alias("track_name"), F.lit("a").alias("artists"), F.lit(50).alias("popularity"), *[F.lit(0.5).alias(c) for c in ("energy", "danceability", "valence")])
    rows = {(u, int(t)) for u in range(30) for t in rng.choice(60, 6, replace=False)}
    asked = []

    def lists_of(given):
        asked.append(sorted(r[0] for r in given.library.select("user_id").distinct().collect()))
        return recommend.profile_top(given, 5).select("user_id", "rank", "track_id", "sim")

    def run(store, rows, basis="one"):
        library = spark.createDataFrame(sorted(rows), "user_id long, track_id long").repartition(3)
        given = recommend.Inputs(library, tracks, tracks.join(vectors, "track_id"), n_listeners=30, n_catalog=60)
        refresh(store, given, lists_of, basis)
        return sorted(map(tuple, store.lists().select("user_id", "rank", "track_id", "sim").collect()))

    store = ListStore(spark, new_path(spark, "lists"))
    run(store, rows)
    spare = next(t for t in range(60) if (7, t) not in rows)
    changed = {r for r in rows if r[0] != 11} | {(7, spare), *[(31, t) for t in range(4)]}
    got = run(store, changed)
    assert asked[1:] == [[7, 31]] and store.last().recomputed == 3
    assert got == run(ListStore(spark, new_path(spark, "lists")), changed)
    assert run(store, changed) == got and asked[-1] == []
    assert run(store, changed, "two") == got and len(asked[-1]) == 30
    prints = lambda r: {tuple(x) for x in fingerprints(spark.createDataFrame(r, "user_id long, track_id long")).collect()}
    parts = [fingerprints(spark.createDataFrame(sorted(rows)[k::2], "user_id long, track_id long")) for k in (0, 1)]
    assert {tuple(x) for x in add_prints(*parts).collect()} == prints(sorted(rows, reverse=True))


def test_pruned_search_sends_a_row_per_slab_and_not_per_group(spark, monkeypatch):
    """Vectors without clusters visit every group: 40 groups in 5 slabs, some of them with pieces, are at most 5 rows per query and pass."""
    rng = np.random.default_rng(3)
    catalog = {t: rng.normal(size=8) for t in range(400)} | {t: np.ones(8) for t in range(400, 520)}
    queries = {q: rng.normal(size=8) for q in range(64)}
    monkeypatch.setattr(P, "SLAB_ROWS", 90)
    sent = []
    before = P._compare
    monkeypatch.setattr(P, "_compare", lambda visits, *rest: sent.append(visits.count()) or before(visits, *rest))
    frame = lambda d, name: spark.createDataFrame([(i, v.tolist()) for i, v in d.items()], f"{name} long, vec array<double>")
    banned = {(q, t) for q in range(64) for t in range(q, 520, 9)}
    owned = spark.createDataFrame(list(banned), "query_id long, track_id long")
    found, visited = P.nearest_pruned(frame(queries, "query_id"), frame(catalog, "track_id"), 7, S._cell_kernel(7), 13, owned, 520, 13, 20)
    assert {(r["query_id"], r["track_id"], r["rank"], r["sim"] + 0.0) for r in found.collect()} == brute_top(queries, catalog, 7, banned)
    assert all(n <= 64 * 8 for n in sent) and sum(r["visits"] for r in visited.collect()) > 2 * sum(sent)


@pytest.mark.parametrize("light_over", [1, 10**9])
def test_single_precision_only_rules_out(light_over, monkeypatch):
    """Scores that differ by less than single precision can tell, and hundreds of equal ones, rank as in double precision."""
    monkeypatch.setattr(S, "LIGHT_OVER", light_over)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    near = {t: base + rng.normal(size=16) * 1e-6 for t in range(300)} | {t: base for t in range(300, 700)} | {t: rng.normal(size=16) for t in range(700, 2000)}
    queries = {0: base, 1: rng.normal(size=16), 2: np.zeros(16)}
    table = lambda d, name, **more: pa.table({name: list(d), "vec": [v.tolist() for v in d.values()], **more})
    left = table(queries, "query_id", masked_id=pa.array([None] * 3, pa.int64()))
    got = S._cell_kernel(25)(left, table(near, "track_id")).to_pylist()
    assert {(r["query_id"], r["track_id"], r["rank"], r["sim"] + 0.0) for r in got} == brute_top(queries, near, 25)


def test_search_looks_through_products_tile_by_tile(monkeypatch):
    """No product of queries and tracks is larger than a tile needs, also where owned tracks are the best and scores rise to the end."""
    monkeypatch.setattr(S, "TILE", 1 << 10)
    monkeypatch.setattr(S, "TILE_QUERIES", 16)
    sizes = []
    before = S._maxima
    monkeypatch.setattr(S, "_maxima", lambda sims, k: sizes.append(sims.size if sims.dtype == np.float32 else 0) or before(sims, k))
    rng = np.random.default_rng(9)
    rising = {t: np.array([1.0, 40.0 / (t + 1), 0, 0]) for t in range(1500)}
    catalog = rising | {t: rng.normal(size=4) for t in range(1500, 3000)} | {t: np.ones(4) for t in range(3000, 3100)}
    queries = {q: rng.normal(size=4) for q in range(50)} | {50: np.array([1.0, 0, 0, 0]), 51: np.ones(4), 52: np.zeros(4)}
    banned = {(q, t) for q in queries for t in range(q % 7, 3100, 7)} | {(50, t) for t in range(1400, 1500)} | {(3, t) for t in catalog if t != 8}
    table = lambda ids, vecs, name, **more: pa.table({name: ids, "vec": pa.array(vecs, pa.list_(pa.float64())), **more})
    left = pa.concat_tables(
        [
            table(list(queries), [v.tolist() for v in queries.values()], "query_id", masked_id=pa.array([None] * len(queries), pa.int64())),
            table([q for q, _ in banned], [[]] * len(banned), "query_id", masked_id=pa.array([t for _, t in banned], pa.int64())),
        ]
    )
    got = S._cell_kernel(6)(left, table(list(catalog), [v.tolist() for v in catalog.values()], "track_id")).to_pylist()
    assert {(r["query_id"], r["track_id"], r["rank"], r["sim"] + 0.0) for r in got} == brute_top(queries, catalog, 6, banned)
    assert len(sizes) > 20 and max(sizes) <= 16 * 2 * S.LIGHT_OVER * 6


def test_long_lists_take_fewer_queries_to_a_cell():
    assert S.plan_grid(1_000_000, 60_000, 8, 60_000).query_groups * S.CELL_RESULTS >= 1_000_000 * 60_000


@pytest.mark.parametrize("n, artists", [(4, 50), (30, 5), (30, 200), (70, 7), (400, 3)])
def test_walk_over_heads_is_the_walk_over_whole_lists(spark, monkeypatch, n, artists):
    """Also where few artists leave most places to the order, where titles repeat, and where heads must grow; no head is the whole catalog
    unless it must be."""
    monkeypatch.setattr(recommend, "SPARE_ROWS", 2)
    rng = np.random.default_rng(n)
    rows = [(t, f"Title {t % 90}", f"Artist {t % artists if t % 5 else 0}", 50, 0.5, 0.5, 0.5, rng.normal(size=6).tolist()) for t in range(300)]
    features = "energy double, danceability double, valence double"
    catalog = spark.createDataFrame(rows, f"track_id long, track_name string, artists string, popularity int, {features}, vec array<double>")
    library = spark.createDataFrame([(u, int(t)) for u in range(6) for t in rng.choice(300, 3 + 20 * u, replace=False)], "user_id long, track_id long")
    inputs = recommend.Inputs(library, catalog.drop("vec"), catalog, n_listeners=6, n_catalog=300)
    whole = recommend.profile_top(inputs, 300).drop("rank").join(catalog.select("track_id", "track_name", "artists"), "track_id")
    depths = []
    search = recommend.nearest_tracks
    monkeypatch.setattr(recommend, "nearest_tracks", lambda q, c, k, **more: depths.append(k) or search(q, c, k, **more))
    got = recommend.diversified_profile_top(inputs, n)
    listed = lambda df: sorted((r["user_id"], r["rank"], r["track_id"], r["sim"]) for r in df.collect())
    assert listed(got) == listed(diversify(whole, n, ["user_id"]))
    assert depths[0] == min(n + max(2, n // 8), 300)


@pytest.mark.parametrize("most", [50, 65536])
def test_lowest_cosine_is_exact_without_all_lists(spark, monkeypatch, most):
    """In a catalog of several groups only what can be the best pair of all is compared after the first look."""
    monkeypatch.setattr(S, "CATALOG_ROWS", most)
    monkeypatch.setattr(S, "GROUP_ROWS", 20)
    rng = np.random.default_rng(9)
    vectors = {t: rng.normal(size=5) + 1 for t in range(300)}
    df = spark.createDataFrame([(t, v.tolist()) for t, v in vectors.items()], "track_id long, vec array<double>")
    unit = np.array([v / np.linalg.norm(v) for v in vectors.values()])
    got = E.embedding_metrics(df).first()
    assert got["min_similarity"] == pytest.approx((unit @ unit.T).min(), abs=1e-9) and got["max_similarity"] == 1.0
    opposite = df.select(F.col("track_id").alias("query_id"), F.transform("vec", lambda x: -x).alias("vec"))
    if most == 50:
        _, visited = P.nearest_pruned(opposite, df, 1, S._cell_kernel(1), 20, None, 300, 50, 64, overall=True)
        every = {r["pass"]: r["compared"] for r in P.nearest_pruned(opposite, df, 1, S._cell_kernel(1), 20, None, 300, 50, 64)[1].collect()}
        assert {r["pass"]: r["compared"] for r in visited.collect()}.get(2, 0) < every[2] / 2


def test_pools_spread_together_as_they_do_alone():
    """Pools of different lengths, one longer than a batch; each batch is one call, not each pool."""
    rng = np.random.default_rng(2)
    rows = [(u, t, round(float(rng.uniform(-1, 1)), 2), rng.normal(size=4).tolist()) for u, m in ((-3, 7), (4, 1), (5, 12), (9, 30)) for t in range(m)]
    batch = lambda some: pa.RecordBatch.from_pydict(dict(zip(("user_id", "track_id", "sim", "vec"), map(list, zip(*some)))))
    for seed in (None, 7):
        alone = [r for u in (-3, 4, 5, 9) for b in R._spreader(5, 0.3, seed)([batch([x for x in rows if x[0] == u])]) for r in b.to_pylist()]
        cut = [batch(rows[at : at + 9]) for at in range(0, len(rows), 9)]
        key = lambda r: (r["user_id"], r["rank"])
        together = list(R._spreader(5, 0.3, seed)(cut))
        assert sorted((r for b in together for r in b.to_pylist()), key=key) == sorted(alone, key=key)
        whole = list(R._spreader(5, 0.3, seed)([batch(rows)]))
        assert len(whole) == 2 and sum(b.num_rows for b in whole) == 16


def test_cells_are_dealt_evenly(spark):
    for n, parts in ((8, 8), (24, 8), (5, 5), (13, 4), (1, 1), (96, 12)):
        keys = [r["key"] for r in spark.range(1).select(F.explode(even_keys(spark, n, parts)).alias("key")).collect()]
        assert len(set(keys)) == len(keys) == n
        rows = spark.createDataFrame([(k,) for k in keys], "cell bigint").repartition(parts, "cell")
        held = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(held) == min(n, parts) and max(held) == -(-n // parts)
    # With more cells than slots, they fill every wave.
    assert S.plan_grid(900_000, 30_000, 12).cells == 24 and S.plan_grid(100_000, 30_000, 12).cells == 12


def test_candidates_lie_in_tasks_of_bounded_size(spark, monkeypatch):
    """Small rows in any number: adaptive execution would pack them into few tasks. The same lists as in tasks of its choice."""
    from palate import session
    from palate.operators.ranking import seed_candidates
    from palate.plans import recommend

    near = spark.range(40).select(F.col("id").alias("seed_id"), F.expr("transform(sequence(1, 12), i -> struct(i AS rank, (id * 7 + i) % 90 AS track_id, 1 / CAST(i AS double) AS sim)) AS near"))
    library = spark.range(4000).select((F.col("id") % 400).alias("user_id"), F.expr("(id * 13 + id div 400) % 40").alias("track_id"), F.lit(20).alias("in_catalog")).distinct()
    names = spark.range(90).selectExpr("id AS track_id", "concat('t', id % 31) AS track_name", "concat('a', id % 17) AS artists", "1 AS popularity")
    given = recommend.Inputs(library, names, names, n_listeners=400)

    def lists(rows):
        found = seed_candidates(library, near, library.where("track_id % 3 = 0"), 4, ["user_id"])
        return found, diversify(recommend._named(found, given, rows), 5, ["user_id"], rows)

    tables = []
    for most in (1 << 19, 40):
        monkeypatch.setattr(session, "TASK_ROWS", most, raising=False)
        tables.append(lists(library.count() * 4))
    (before, walked_before), (found, walked) = tables
    ordered = lambda df: sorted(map(tuple, df.collect()))
    assert ordered(found) == ordered(before) and ordered(walked) == ordered(walked_before)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 4 * 40 < found.count() / 8


def test_exports_of_packed_lists_need_no_shuffle(spark):
    """Lists that come as arrays give the same batches, skipped rows and counts as their rows, where they lie."""
    from palate.plans import lifecycle as L

    rows = [(u, r, None if (u + r) % 4 == 0 or (u % 5 == 0 and r > 2) else 100 * u + r) for u in range(20) for r in range(1, 2 + u % 9)]
    recs = spark.createDataFrame(rows, "user_id long, rank int, track_id long").withColumns({c: F.lit(None).cast("string") for c in ("track_name", "artists")})
    lists = recs.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "track_id"))).alias("near"))
    lists = spark.createDataFrame(lists.collect(), lists.schema).withColumns({c: F.lit(None).cast("string") for c in ("track_name", "artists")})
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for run in (lambda df: export_batches(df.drop("track_name", "artists"), 2), L.export_skipped, L.export_stats):
        packed, plain = run(lists), run(recs)
        assert packed.dtypes == plain.dtypes and key(packed) == key(plain) and packed.count()
        assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()


def test_long_lists_of_a_middling_catalog_come_from_one_cell(spark):
    """100,000 tracks are one group: no list is put together from several slabs, and long lists do not multiply the cells."""
    assert S.plan_grid(900_000, 102_564, 12, 150).catalog_groups == 1
    assert S.plan_grid(900_000, 102_564, 12, 150).cells <= 24
