"""Tables, matching, training and streams end to end on small frames."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from palate.functions.text import indel_ratio
from palate.operators import embedding as M
from palate.operators import resolve
from palate.operators.catalog import append_unique, attach_features, batches, cache_misses, insert_absent, search
from palate.operators.evaluation import embedding_metrics, overlap, suite_rollup, training_summary
from palate.operators.quality import volume_gate
from palate.plans import crosswalk, lifecycle
from palate.plans.recommend import prefer_energy
from palate.plans.snapshot import NothingPublished, Snapshots
from palate.schema import FEATURES, feature_schema
from palate.session import new_path, stage
from palate.sources import delivery, files
from palate.streaming import library as S


def test_missing_table_is_empty_with_schema(spark):
    df = files.read_features(spark, new_path(spark, "nowhere"))
    assert df.count() == 0 and df.columns == feature_schema().names


def test_versions_stay_readable(spark):
    table = files.VersionedTable(spark, new_path(spark, "versions"))
    first = table.publish(spark.range(3))
    second = table.publish(spark.range(5))
    assert table.current().count() == 5 and table.version(first).count() == 3
    assert {r["version"]: r["is_current"] for r in table.history().collect()} == {first: False, second: True}


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([(1, "100% Pure", "x", 5), (2, "100 Pure", "y_z", 9)], "track_id long, track_name string, artists string, popularity int")
    assert [r["track_id"] for r in search(df, "100%").collect()] == [1]
    assert [r["track_id"] for r in search(df, "Y_Z").collect()] == [2]


def test_growth_and_inserts(spark):
    have = spark.createDataFrame([(1, 10), (2, 20)], "track_id long, popularity int")
    new = spark.createDataFrame([(2, 99), (3, 1), (3, 7)], "track_id long, popularity int")
    assert sorted(tuple(r) for r in append_unique(have, new).collect()) == [(1, 10), (2, 20), (3, 7)]
    assert [r["track_id"] for r in insert_absent(have, new, ["track_id"], [F.desc("popularity")]).collect()] == [3]
    asked = spark.createDataFrame([(1,), (3,), (3,), (None,)], "track_id long")
    assert [r["track_id"] for r in cache_misses(asked, have).collect()] == [3]


def test_attach_features_uses_the_cache_even_if_nothing_is_missing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "track_id long, track_name string")
    full = (1, *[0.5 if c not in ("key", "mode") else 1 for c in FEATURES])
    holes = (2, *[None for _ in FEATURES])
    cache = spark.createDataFrame([full, full, holes], feature_schema())
    assert [r["track_id"] for r in attach_features(rows, cache).collect()] == [1]


def test_batches_are_dense(spark):
    got = batches(spark.range(0, 1005).select((F.col("id") * 7).alias("k")), "k", 40).orderBy("k").collect()
    assert [r["row_index"] for r in got] == list(range(1005)) and got[-1]["batch_no"] == 25


def test_gate_reasons(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    usable = spark.createDataFrame([(1, i) for i in range(3)] + [(2, 9)], "user_id long, track_id long")
    got = {r["user_id"]: (r["eligible"], r["reason"]) for r in volume_gate(users, usable).collect()}
    assert got[1] == (True, None) and not got[2][0] and got[2][1].startswith("Need") and got[3][1].startswith("No tracks")


def test_energy_preference(spark):
    tracks = spark.createDataFrame([(1, 0.8), (2, 0.7), (3, 0.4), (4, 0.1)], "track_id long, energy double")
    ids = lambda p, **k: sorted(r["track_id"] for r in prefer_energy(tracks.select("track_id"), tracks, p, **k).collect())
    assert ids("High Energy") == [1] and ids("Medium Energy") == [2, 3] and ids("Low Energy") == [4]
    assert ids("Low Energy", active=False) == ids("Mixed") == [1, 2, 3, 4]


def test_overlap_and_rollup(spark):
    recs = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "user_id long, track_id long")
    row = overlap(recs, spark.createDataFrame([(1, 2)], "a long, b long"), "user_id").first()
    assert (row["overlap_count"], row["total_unique"], row["status"]) == (1, 3, "high")
    rolled = suite_rollup(spark.createDataFrame([("x", True), ("x", False), ("y", True)], "suite string, passed boolean"))
    got = {r["suite"]: (r["passed"], r["failed"], r["verdict"]) for r in rolled.collect()}
    assert got == {"x": (1, 1, "fail"), "y": (1, 0, "pass"), "overall": (2, 1, "needs improvement")}


def test_training_summary(spark):
    history = spark.createDataFrame([(1, 3.0, 2.0), (2, 1.0, 1.5), (3, 1.0, 1.7)], "epoch int, val_loss double, val_mae double")
    row = training_summary(history).first()
    assert (row["best_epoch"], row["best_val_loss"], row["final_val_mae"], row["total_epochs"]) == (2, 1.0, 1.7, 3)


def test_embedding_metrics_match_all_pairs(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "track_id long, vec array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit @ unit.T
    row = embedding_metrics(df).first()
    for name, value in {"mean": sims.mean(), "std": sims.std(), "min": sims.min(), "max": sims.max()}.items():
        assert row[f"{name}_similarity"] == pytest.approx(value, abs=1e-8)


def best_match(wanted, foreign):
    """All pairs of two small catalogs, one artist and album each."""
    options = []
    for f in foreign:
        if wanted["isrc"] and wanted["isrc"] == f["isrc"]:
            options.append((1, -100.0, f["id"]))
        s, b = indel_ratio(wanted["norm"], f["norm"]), indel_ratio(wanted["norm"], f["norm"])
        meets = indel_ratio(wanted["artist"], f["artist"]) > 70
        for block, base in (("album", 2), ("artist", 6)):
            if wanted[block] != f[block]:
                continue
            if wanted["norm"] == f["norm"]:
                options.append((base, -100.0, f["id"]))
            elif s >= 80:
                options.append((base + 1, -s, f["id"]))
            elif s >= 60 and (block == "artist" or meets):
                options.append((base + 2, -s, f["id"]))
            elif b >= 60 and (block == "artist" or meets):
                options.append((base + 3, -b, f["id"]))
    return min(options) if options else None


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_resolution_matches_brute_force(spark, monkeypatch, block_rows):
    """One artist holds most titles, so small cells cut its block into many."""
    monkeypatch.setattr(resolve, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(9)
    words = ["love", "night", "river", "gold", "dance", "blue", "fire", "home"]

    def make(i):
        return {
            "id": int(i),
            "norm": " ".join(rng.choice(words, size=rng.integers(1, 4))) + ("x" * int(rng.integers(0, 3))),
            "artist": "hot act" if rng.random() < 0.7 else str(rng.choice(["hot acts", "other", "third"])),
            "album": str(rng.choice(["one", "two", "three"])),
            "isrc": f"Q{rng.integers(30)}" if rng.random() < 0.1 else None,
        }

    wanted, foreign = [make(i) for i in range(60)], [make(1000 + i) for i in range(60)]

    def frame(rows, key):
        return spark.createDataFrame(
            [(r["id"], r["norm"], r["artist"], r["album"], r["isrc"]) for r in rows],
            f"{key} long, title string, artists string, album string, isrc string",
        )

    got = {r["track_id"]: (r["priority"], -r["score"], r["foreign_id"]) for r in resolve.resolve_titles(frame(wanted, "track_id"), frame(foreign, "foreign_id")).collect()}
    expected = {w["id"]: best_match(w, foreign) for w in wanted}
    assert got == {k: pytest.approx(v) for k, v in expected.items() if v}


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    w = M.init_weights(embedding_dim=4, seed=1)
    x = rng.random((16, 12))
    fresh = lambda: {k: v.copy() for k, v in w.items()}
    grads, _ = M.gradients(fresh(), x, None)
    for name in ("W0", "b2", "gamma1", "W5"):
        at = tuple(rng.integers(0, n) for n in w[name].shape)
        loss = []
        for step in (1e-6, -1e-6):
            moved = fresh()
            moved[name][at] += step
            loss.append(M.gradients(moved, x, None)[1])
        assert grads[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-7)


def test_training_lowers_validation_error_and_publishes(spark):
    rng = np.random.default_rng(2)
    n = 1600
    rows = []
    for i in range(n):
        base = rng.random(2)
        rows.append((i, f"t{i}", "a", int(rng.integers(0, 100)), *[
            int(base[0] * 11) if c == "key" else int(base[1] > 0.5) if c == "mode" else float(base[j % 2]) for j, c in enumerate(FEATURES)
        ]))
    types = ", ".join(f"{c} {'int' if c in ('key', 'mode') else 'double'}" for c in FEATURES)
    tracks = spark.createDataFrame(rows, f"track_id long, track_name string, artists string, popularity int, {types}")
    store = Snapshots(spark, new_path(spark, "artifacts"))
    with pytest.raises(lifecycle.TooFewRows):
        lifecycle.train_and_publish(tracks.limit(10), store, epochs=1)
    trained = lifecycle.train_and_publish(tracks, store, epochs=6)
    losses = [r["loss"] for r in trained.history.orderBy("epoch").collect()]
    assert losses[-1] < losses[0]
    now = store.current()
    assert now.rows["embeddings"] == n and now["embeddings"].selectExpr("max(size(vec)) AS d").first()["d"] == 64
    assert set(M.weights_from(now["weights"])) == set(M.init_weights())
    assert trained.embedding_metrics.first()["max_similarity"] <= 1.0 + 1e-9
    checked = trained.held_out.collect()
    assert checked and all(r["query_id"] != r["track_id"] for r in checked)


def test_training_checks_weights_while_the_next_epoch_trains(spark, monkeypatch):
    rng = np.random.default_rng(8)
    frame = lambda n: stage(spark.createDataFrame([(rng.random(12).tolist(),) for _ in range(n)], "feat array<double>"), "rows")
    train, validation = frame(300), frame(40)
    local = train.repartition(4, "feat").mapInArrow(M._epoch_job(spark.sparkContext.broadcast(M.init_weights()), 1e-3, 1, 7), f"part int, {M.PARTIAL}")
    local = stage(local, "local")
    by_driver = M._weighted_average(local, 4)
    monkeypatch.setattr(M, "DIRECT_PARTS", 0)
    by_groups = M._weighted_average(local, 4)
    assert np.allclose(by_driver[0], by_groups[0]) and by_driver[1:] == pytest.approx(by_groups[1:])
    monkeypatch.undo()
    jobs = []
    for epochs in (2, 6):
        spark.sparkContext.setJobGroup(f"training {epochs}", "training")
        M.train_autoencoder(train, validation, epochs=epochs)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"training {epochs}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # An epoch trains in one job and is checked in two.
    assert jobs[1] - jobs[0] == 3 * 4
    monkeypatch.setattr(M, "SLOW_PATIENCE", 2)
    monkeypatch.setattr(M, "STOP_PATIENCE", 3)
    monkeypatch.setattr(M, "LEARNING_RATE", 0.05)
    model = M.train_autoencoder(train, validation, epochs=12)
    # Rates, the best weights and the end follow from the checked losses, as without running ahead.
    best, waited, slow, rate = np.inf, 0, 0, 0.05
    for at, (epoch, _, loss, _, used) in enumerate(model.history, 1):
        assert (epoch, used) == (at, rate)
        waited, slow = (0, 0) if loss < best else (waited + 1, slow + 1)
        best = min(best, loss)
        if slow >= 2:
            rate, slow = rate * M.SLOW_FACTOR, 0
        assert waited < 3 or at == len(model.history)
    shared = spark.sparkContext.broadcast(model.weights)
    row = validation.mapInArrow(M._validation_job(shared), "n bigint, squared double, absolute double").selectExpr("sum(squared) / sum(n) AS loss").first()
    assert row["loss"] == pytest.approx(best)
    assert waited == 3 or len(model.history) == 12


def test_snapshots_change_as_a_whole(spark):
    store = Snapshots(spark, new_path(spark, "snapshots"))
    tables = lambda v: {"a": spark.range(v), "b": spark.range(2 * v)}
    store.publish(tables(3), "one")
    # A writer that is lost before the pointer leaves tables that nobody reads.
    spark.range(99).write.parquet(store._data("a", "half"))
    assert (store.current().version, store.current().rows) == ("one", {"a": 3, "b": 6})
    store.publish(tables(5), "two")
    now = store.current()
    assert now.version == "two" and (now["a"].count(), now["b"].count()) == (5, 10)
    assert store.version("one")["b"].count() == 6
    with pytest.raises(NothingPublished):
        store.version("half")


def test_retraining_loop(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(lifecycle, "train_and_publish", lambda *a, **k: calls.append(1) or "trained")
    path = new_path(spark, "state")
    grown = lambda n: spark.createDataFrame([("2024-01-01", n // 2), ("2024-01-02", n - n // 2)], "day string, added long")
    at = lambda day: F.to_timestamp(F.lit(f"2024-01-{day:02} 12:00:00"))

    def turn(n, day):
        decision, done = lifecycle.retrain_if_due(spark.range(1), None, path, grown(n), 5000, at(day))
        return decision.first()["reason"], done

    assert turn(0, 1) == ("First time retraining", "trained")
    assert turn(500, 2) == ("", None)
    assert turn(500, 4) == ("Moderate growth (500 new tracks, 3 days)", "trained")
    assert turn(1499, 5) == ("", None)
    assert turn(1500, 5) == ("Significant dataset growth (1000 new tracks)", "trained")
    assert turn(1500, 12) == ("Weekly retraining due (last: 7 days ago)", "trained")
    assert len(calls) == 4 and files.read_json_state(spark, path).count() == 4


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    rows = [(i, i % 7, i % 5, f"2024-01-0{1 + i % 3} 00:00:00") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, track_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    landing, base = new_path(spark, "landing"), new_path(spark, "stream")
    events.repartition(3).write.parquet(landing)
    features = spark.createDataFrame([(0,), (1,), (2,)], "track_id long")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    S.ingest_stream(stream, f"{base}/lib", f"{base}/miss", features, f"{base}/cp").awaitTermination()
    expected = {(r["user_id"], r["track_id"]) for r in events.collect()}
    got = [(r["user_id"], r["track_id"]) for r in S.read_library(spark, f"{base}/lib").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {r["track_id"] for r in spark.read.parquet(f"{base}/miss").collect()} == {3, 4}
    assert {(r["user_id"], r["track_id"]) for r in S.usable_library(S.read_library(spark, f"{base}/lib"), features).collect()} == {
        k for k in expected if k[1] < 3
    }
    # Repeats and one new pair after a restart from the checkpoint: only the new pair is stored.
    more = events.where("event_id < 5").unionByName(spark.createDataFrame([(99, 77, 1, "2023-01-01 00:00:00")], "event_id long, user_id long, track_id long, ts string").withColumn("ts", F.to_timestamp("ts")))
    more.coalesce(1).write.mode("append").parquet(landing)
    again = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    S.ingest_stream(again, f"{base}/lib", f"{base}/miss", features, f"{base}/cp").awaitTermination()
    after = [(r["user_id"], r["track_id"]) for r in S.read_library(spark, f"{base}/lib").collect()]
    assert sorted(after) == sorted([*got, (77, 1)])
    last = events.where("event_id < 5")
    for _ in range(2):
        S.library_sink(f"{base}/lib2", f"{base}/miss2", features)(last, 0)
    assert S.read_library(spark, f"{base}/lib2").count() == 5


def test_late_rows_are_stored_and_counted(spark):
    landing, base = new_path(spark, "landing"), new_path(spark, "stream")
    days = ["2024-01-10", "2024-01-11", "2024-01-05", "2024-01-12", "2024-01-05"]
    for i, day in enumerate(days):
        one = spark.createDataFrame([(i, 1, i, f"{day} 08:00:00")], "event_id long, user_id long, track_id long, ts string")
        one.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(landing)
    schema = "event_id long, user_id long, track_id long, ts timestamp"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    features = spark.createDataFrame([(0,)], "track_id long")
    S.ingest_stream(source(), f"{base}/lib", f"{base}/miss", features, f"{base}/cp").awaitTermination()
    assert sorted(r["event_id"] for r in S.read_library(spark, f"{base}/lib").collect()) == [0, 1, 2, 3, 4]
    S.growth_stream(source(), f"{base}/daily", f"{base}/cp2").awaitTermination()
    got = {r["day"].strftime("%Y-%m-%d"): r["added"] for r in S.read_growth(spark, f"{base}/daily").collect()}
    assert got == {"2024-01-10": 1, "2024-01-11": 1, "2024-01-05": 2, "2024-01-12": 1}


def test_cascade_gives_one_row_per_track(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "track_id long")
    row = lambda i, v: (i, *[v if c not in ("key", "mode") else 1 for c in FEATURES])
    features = spark.createDataFrame([row(1, 0.5), row(1, 0.5), row(10, 0.25), row(11, 0.75)], feature_schema())
    crosswalk = spark.createDataFrame([(2, 11), (2, 10), (2, 9), (3, 12)], "track_id long, foreign_id long")
    got = {r["track_id"]: r for r in resolve.feature_cascade(wanted, features, crosswalk).collect()}
    assert len(got) == 3 and resolve.feature_cascade(wanted, features, crosswalk).count() == 3
    assert got[1]["source"] == "direct" and got[2]["source"] == "crosswalk" and got[3]["source"] is None
    assert got[2]["energy"] == 0.25


def test_delivery_is_whole_and_once(spark):
    folder = new_path(spark, "service")
    rows = [(u, r, u * 100 + r) for u in range(3) for r in range(1, 8)]
    recs = spark.createDataFrame(rows, "user_id long, rank int, track_id long")
    batched = lifecycle.export_batches(recs, 3)
    fails = F.udf(lambda x: 1 // 0 if x == 207 else x, "long")
    with pytest.raises(Exception, match="division"):
        delivery.deliver(batched.withColumn("track_id", fails("track_id")).repartition(4, "user_id"), folder, "one")
    assert not glob.glob(folder.removeprefix("file:") + "/delivered/**/*.json", recursive=True)
    for _ in range(2):
        delivery.deliver(batched, folder, "one")
    got = sorted((r.user_id, r.batch_no, r.track_ids) for r in delivery.delivered(spark, folder, "one").collect())
    assert got == [(u, b, [u * 100 + r for r in range(3 * b + 1, min(3 * b + 4, 8))]) for u in range(3) for b in range(3)]
    assert not glob.glob(folder.removeprefix("file:") + "/staged/*")


def test_skipped_rows_have_a_reason(spark):
    rows = [(1, r, r if r != 2 else None, "t", "a") for r in range(1, 6)] + [(2, 1, 5, None, "a"), (2, 2, None, "x", None)]
    recs = spark.createDataFrame(rows, "user_id long, rank int, track_id long, track_name string, artists string")
    got = {(r.user_id, r["rank"]): (r.track_name, r.artists, r.reason) for r in lifecycle.export_skipped(recs).collect()}
    assert got == {
        (1, 2): ("t", "a", lifecycle.NO_TRACK), (2, 1): ("Unknown", "a", lifecycle.SHORT_LIST), (2, 2): ("x", "Unknown", lifecycle.NO_TRACK)
    }


def test_crosswalk_remembers(spark, monkeypatch):
    row = lambda i, v: (i, *[v if c not in ("key", "mode") else 1 for c in FEATURES])
    typed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feature_schema().fields)
    features = spark.createDataFrame([row(1, 0.5)], typed)
    titles = "title string, artists string, album string, isrc string"
    foreign = spark.createDataFrame([(71, "blue night", "act", None, "Q1"), (72, "red day", "act", None, None), (73, "gone", "act", None, None)], f"foreign_id long, {titles}")
    theirs = spark.createDataFrame([row(71, 0.25), row(72, 0.75)], typed).withColumnRenamed("track_id", "foreign_id")
    rows = [(1, "own", "act", None, None), (2, "other title", "act", None, "Q1"), (3, "Red Day (Live)", "act", None, None), (4, "gone", "act", None, None), (5, "unlike", "nobody", None, None)]
    tracks = spark.createDataFrame(rows, f"track_id long, {titles}")
    walk, asked, real = crosswalk.Crosswalk(spark, new_path(spark, "crosswalk")), [], crosswalk.resolve_titles

    def counted(wanted, known):
        asked.append(sorted(r[0] for r in wanted.select("track_id").collect()))
        return real(wanted, known)

    monkeypatch.setattr(crosswalk, "resolve_titles", counted)
    chain = lambda batch: {(r.track_id, r.source, r.foreign_id, r.energy) for r in crosswalk.feature_chain(tracks, features, foreign, theirs, walk, batch).collect()}
    first = {(1, "direct", None, 0.5), (2, "resolved", 71, 0.25), (3, "resolved", 72, 0.75)}
    assert chain(0) == first and chain(0) == first  # a batch that is run again does not see itself
    assert chain(1) == {(i, "crosswalk" if s == "resolved" else s, f, e) for i, s, f, e in first}
    # Only what has no features so far is looked for again; the stored pairs stay.
    assert asked == [[2, 3, 4, 5], [2, 3, 4, 5], [4, 5]]
    assert {(r.track_id, r.foreign_id) for r in walk.pairs().collect()} == {(2, 71), (3, 72), (4, 73)}


def test_delivery_writes_few_files(spark, monkeypatch):
    """A task's batches share files, each a line."""
    folder = new_path(spark, "service")
    recs = spark.createDataFrame([(u, r, u * 100 + r) for u in range(200) for r in range(1, 5)], "user_id long, rank int, track_id long")
    delivery.deliver(lifecycle.export_batches(recs, 2).repartition(2, "user_id"), folder, "one")
    files_there = glob.glob(folder.removeprefix("file:") + "/delivered/**/*.json", recursive=True)
    assert len(files_there) < 100 and delivery.delivered(spark, folder, "one").count() == 400


def test_collected_library_rows_include_tracks_without_all_features(spark, tmp_path):
    """Track 37 lacks a feature; its library row is collected all the same, track 40 (divisible by five) is stored already."""
    from palate.registry import QUERIES

    at = lambda name: str(tmp_path / f"{name}.parquet")
    spark.sql("SELECT id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size, 1D AS p_retailprice FROM range(50)").write.parquet(at("part"))
    spark.sql(
        "SELECT 1L AS o_orderkey, 9L AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS o_orderdate, '5-LOW' AS o_orderpriority"
    ).write.parquet(at("orders"))
    spark.sql(
        "SELECT 1L AS l_orderkey, explode(array(36L, 37L, 40L)) AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, 1D AS l_quantity, 1D AS l_extendedprice, 0D AS l_discount,"
        " 0D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS l_shipdate"
    ).write.parquet(at("lineitem"))
    assert {tuple(r) for r in QUERIES["p1_collect_library_rows"](spark, str(tmp_path)).collect()} == {(9, 36), (9, 37)}


def test_embedding_metrics_compute_a_length_once_per_vector(spark, monkeypatch):
    from palate.operators import evaluation

    plans, search = [], evaluation.highest_cosine
    monkeypatch.setattr(evaluation, "highest_cosine", lambda q, c: plans.extend(x._jdf.queryExecution().optimizedPlan().toString() for x in (q, c)) or search(q, c))
    frame = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-3.0, 4.0])], "track_id long, vec array<double>")
    row = evaluation.embedding_metrics(frame).first()
    assert (row["min_similarity"], row["max_similarity"]) == (pytest.approx(0.0), 1.0)
    lines = [line for plan in plans for line in plan.splitlines() if "transform(" in line]
    assert lines and not any("aggregate(" in line for line in lines)


def test_owned_rows_need_no_first_addition(spark, tmp_path):
    from palate.sources import bindings as B

    day = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    orders = [(1, 7), (2, 7), (3, None), (None, 8), (4, 9), (4, 9)]
    values = ", ".join(f"({'NULL' if k is None else k}, {'NULL' if u is None else u}, 'O', 1.0D, {day}, 'p{i}')" for i, (k, u) in enumerate(orders))
    spark.sql(f"SELECT CAST(a AS bigint) o_orderkey, CAST(b AS bigint) o_custkey, c o_orderstatus, d o_totalprice, e o_orderdate, f o_orderpriority FROM VALUES {values} t(a, b, c, d, e, f)").write.parquet(f"{tmp_path}/orders.parquet")
    items = "(1, 5), (1, 5), (2, 5), (2, 6), (3, 5), (4, NULL), (NULL, 5)"
    spark.sql(f"SELECT CAST(a AS bigint) l_orderkey, CAST(b AS bigint) l_partkey FROM VALUES {items} t(a, b)").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = B.owned(spark, str(tmp_path))
    assert (spark.sparkContext.applicationId, str(tmp_path), "library") not in B._STORED
    expected = [(7, 5), (7, 6), (9, None), (None, 5)]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(rows.collect()) == order(expected)
    # Where the library is there already, it is read, with the same rows.
    assert order(B.library(spark, str(tmp_path)).select("user_id", "track_id").collect()) == order(B.owned(spark, str(tmp_path)).collect()) == order(expected)


def test_landed_rows_are_joined_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """However well the rows compress: adaptive execution would pack all of them into few tasks."""
    from palate import session
    from palate.sources import bindings as B

    n, most = 20_000, 500
    spark.sql(f"SELECT id AS l_orderkey, id % 7 AS l_partkey FROM range(0, {n}, 1, 4)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql(
        f"SELECT id AS o_orderkey, id % 50 AS o_custkey, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS o_orderdate, 'p' AS o_orderpriority FROM range({n})"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(session, "TASK_ROWS", most, raising=False)
    landed = B.landed_library(spark, str(tmp_path))
    sizes = [r["count"] for r in landed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * most
    assert landed.where("user_id <> batch_key % 50 OR track_id <> batch_key % 7").isEmpty()
    monkeypatch.setattr(session, "TASK_ROWS", n)
    small = B.landed_library(spark, str(tmp_path))
    assert small.count() == n
