"""Queries over title resolution, learned features and streams."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.functions.scaling import feature_vectors, fit_scalers
from palate.operators import catalog as C
from palate.operators import embedding as M
from palate.operators import evaluation as E
from palate.operators import quality as Q
from palate.operators.resolve import resolve_titles
from palate.operators.similarity import nearest_tracks
from palate.plans import ingest, lifecycle, recommend
from palate.plans.crosswalk import Crosswalk, feature_chain
from palate.plans.snapshot import Snapshots, inputs_from
from palate.registry.core import WEIGHT_SQL, cosine_sql, query, views
from palate.registry.summaries import TITLE_SQL, decorated_title, ratio_sql, title_sql
from palate.schema import BOUNDED, FEATURES, METADATA_COLS, UNBOUNDED, canonical
from palate.session import new_path, stage
from palate.sources import bindings as B
from palate.sources import files
from palate.streaming import library as S

# ---- title resolution


PLAIN = string.ascii_letters + string.digits
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in PLAIN)


def wanted_titles(spark, d) -> DataFrame:
    """Our tracks: decorated titles, credits with a second artist on every third, accented or full-width names on some, an ISRC on every eleventh."""
    key = F.col("p_partkey")
    brand = (
        F.when(key % 7 == 0, F.translate("p_brand", "an", "áñ"))
        .when(key % 7 == 1, F.translate("p_brand", PLAIN, WIDE))
        .when(key % 7 == 2, F.concat("p_brand", F.lit("ﬁ½")))
        .otherwise(F.col("p_brand"))
    )
    credits = F.when(key % 3 == 0, F.concat_ws(", ", brand, "p_type")).otherwise(brand)
    return B.table(spark, d, "part").select(
        key.alias("track_id"),
        decorated_title().alias("title"),
        credits.alias("artists"),
        F.when(key % 4 != 0, F.col("p_type")).alias("album"),
        F.when(key % 11 == 0, F.concat(F.lit("QZ"), key)).alias("isrc"),
    )


def foreign_titles(spark, d) -> DataFrame:
    """The other catalog: other ids, titles as they are, shortened, extended, respelled or unrelated."""
    key, name = F.col("p_partkey"), F.col("p_name")
    kind = key % 5
    title = (
        F.when(kind == 1, F.regexp_replace(name, ".$", ""))
        .when(kind == 2, F.concat(name, F.lit(" (Bonus Material)")))
        .when(kind == 3, F.replace(name, F.lit("e"), F.lit("aa")))
        .when(kind == 4, F.reverse(name))
        .otherwise(name)
    )
    return B.table(spark, d, "part").where(key % 2 == 0).select(
        (key + 1_000_000).alias("foreign_id"),
        title.alias("title"),
        F.when(key % 6 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("artists"),
        F.when(key % 8 == 0, F.col("p_type")).alias("album"),
        F.when(key % 22 == 0, F.concat(F.lit("QZ"), key)).alias("isrc"),
    )


_ARTIST = f"trim(regexp_replace(regexp_replace(lower(translate(strip_accents(replace(replace(a, 'ﬁ', 'fi'), '½', '12')), '{WIDE}', '{PLAIN}')), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
RESOLVE = {
    "w0": f"""SELECT p_partkey AS id, {TITLE_SQL} AS title, CASE WHEN p_partkey % 3 = 0 THEN brand || ', ' || p_type ELSE brand END AS artists,
        CASE WHEN p_partkey % 4 <> 0 THEN lower(p_type) END AS album, CASE WHEN p_partkey % 11 = 0 THEN 'QZ' || p_partkey END AS isrc
        FROM (SELECT *, CASE p_partkey % 7 WHEN 0 THEN translate(p_brand, 'an', 'áñ') WHEN 1 THEN translate(p_brand, '{PLAIN}', '{WIDE}') WHEN 2 THEN p_brand || 'ﬁ½' ELSE p_brand END AS brand FROM part)""",
    "f0": """SELECT p_partkey + 1000000 AS id, CASE p_partkey % 5 WHEN 1 THEN regexp_replace(p_name, '.$', '') WHEN 2 THEN p_name || ' (Bonus Material)'
        WHEN 3 THEN replace(p_name, 'e', 'aa') WHEN 4 THEN reverse(p_name) ELSE p_name END AS title,
        CASE WHEN p_partkey % 6 = 0 THEN p_type ELSE p_brand END AS artists,
        CASE WHEN p_partkey % 8 = 0 THEN lower(p_type) END AS album, CASE WHEN p_partkey % 22 = 0 THEN 'QZ' || p_partkey END AS isrc
        FROM part WHERE p_partkey % 2 = 0""",
    "w": f"SELECT id, {title_sql('title')} AS norm, {title_sql('title', True)} AS bare, list_transform(string_split(artists, ', '), lambda a: {_ARTIST}) AS names, album, isrc FROM w0",
    "f": f"SELECT id, {title_sql('title')} AS norm, {title_sql('title', True)} AS bare, list_transform(string_split(artists, ', '), lambda a: {_ARTIST}) AS names, album, isrc FROM f0",
    "norms": f"SELECT x, y, {ratio_sql('x', 'y')} AS score FROM (SELECT DISTINCT w.norm AS x FROM w), (SELECT DISTINCT f.norm AS y FROM f)",
    "bares": f"SELECT x, y, {ratio_sql('x', 'y')} AS score FROM (SELECT DISTINCT w.bare AS x FROM w), (SELECT DISTINCT f.bare AS y FROM f)",
    "wn": "SELECT DISTINCT id, unnest(names) AS name FROM w",
    "fn": "SELECT DISTINCT id, unnest(names) AS name FROM f",
    "acts": f"SELECT x, y, {ratio_sql('x', 'y')} > 70 AS meets FROM (SELECT DISTINCT name AS x FROM wn), (SELECT DISTINCT name AS y FROM fn)",
    "meet": "SELECT x, list(y) AS ys FROM acts WHERE meets GROUP BY x",
    "w_meet": "SELECT id, flatten(list(ys)) AS friends FROM wn JOIN meet ON name = x GROUP BY id",
    "by_album": """SELECT w.id AS wid, f.id AS fid, w.norm = f.norm AS same, n.score AS s, b.score AS sb, list_has_any(coalesce(m.friends, []), f.names) AS ok
        FROM w JOIN f ON w.album = f.album JOIN norms n ON n.x = w.norm AND n.y = f.norm JOIN bares b ON b.x = w.bare AND b.y = f.bare
        LEFT JOIN w_meet m ON m.id = w.id WHERE w.norm <> '' AND f.norm <> ''""",
    "by_artist": """SELECT DISTINCT w.id AS wid, f.id AS fid, w.norm = f.norm AS same, n.score AS s, b.score AS sb
        FROM wn JOIN fn USING (name) JOIN w ON w.id = wn.id JOIN f ON f.id = fn.id JOIN norms n ON n.x = w.norm AND n.y = f.norm
        JOIN bares b ON b.x = w.bare AND b.y = f.bare WHERE w.norm <> '' AND f.norm <> ''""",
    "options": """SELECT w.id AS wid, f.id AS fid, 1 AS p, 100.0::DOUBLE AS score FROM w JOIN f USING (isrc)
        UNION ALL SELECT wid, fid, CASE WHEN same THEN 2 WHEN s >= 80 THEN 3 WHEN s >= 60 AND ok THEN 4 WHEN sb >= 60 AND ok THEN 5 END,
            CASE WHEN same THEN 100.0 WHEN s >= 60 THEN s ELSE sb END FROM by_album
        UNION ALL SELECT wid, fid, CASE WHEN same THEN 6 WHEN s >= 80 THEN 7 WHEN s >= 60 THEN 8 WHEN sb >= 60 THEN 9 END,
            CASE WHEN same THEN 100.0 WHEN s >= 60 THEN s ELSE sb END FROM by_artist""",
}


@query(
    "j9_resolve_titles",
    views(extra=RESOLVE)
    + """SELECT wid AS track_id, fid AS foreign_id, p AS priority, round(score, 9) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY wid ORDER BY p, score DESC, fid) AS r FROM options WHERE p IS NOT NULL) WHERE r = 1""",
)
def j9(spark, d):
    return resolve_titles(wanted_titles(spark, d), foreign_titles(spark, d)).withColumn("score", F.round("score", 9))


# ---- features through other catalogs

# Which landed rows came before, and whose own features are known.
CHAIN = {
    "own": "SELECT * FROM complete WHERE track_id % 4 <> 0",
    "asked": "SELECT DISTINCT track_id FROM landed",
    "before": "SELECT DISTINCT track_id FROM landed WHERE batch_key % 2 = 0",
    "rest": "SELECT track_id FROM asked WHERE track_id NOT IN (SELECT track_id FROM own)",
    "w_all": RESOLVE["w0"],
    **RESOLVE,
    "w0": "SELECT * FROM w_all WHERE id IN (SELECT track_id FROM rest)",
    "pairs": """SELECT wid AS track_id, fid AS foreign_id FROM (
        SELECT *, row_number() OVER (PARTITION BY wid ORDER BY p, score DESC, fid) AS r FROM options WHERE p IS NOT NULL) WHERE r = 1""",
    "theirs": "SELECT track_id + 1000000 AS foreign_id FROM complete",
    "through": "SELECT track_id, foreign_id FROM pairs JOIN theirs USING (foreign_id)",
    "featured": "SELECT track_id FROM own UNION SELECT track_id FROM through",
}


def chain_inputs(spark, d) -> dict[str, DataFrame]:
    complete = Q.complete(B.tracks(spark, d)).select("track_id", *FEATURES)
    return {
        "features": complete.where(F.col("track_id") % 4 != 0),
        "foreign": foreign_titles(spark, d),
        "foreign_features": complete.withColumn("foreign_id", F.col("track_id") + 1_000_000).drop("track_id"),
        "crosswalk": Crosswalk(spark, new_path(spark, "crosswalk")),
    }


@query(
    "j11_second_batch",
    views("landed", "complete", extra=CHAIN)
    + """SELECT track_id, 'direct' AS source, CAST(NULL AS BIGINT) AS foreign_id FROM asked WHERE track_id IN (SELECT track_id FROM own)
         UNION ALL SELECT track_id, CASE WHEN track_id IN (SELECT track_id FROM before) THEN 'crosswalk' ELSE 'resolved' END, foreign_id FROM through""",
)
def j11_second(spark, d):
    """Every landed track, after half of the landed rows were a batch of their own: only new tracks are resolved."""
    landed, titles, given = B.landed_library(spark, d), wanted_titles(spark, d), chain_inputs(spark, d)
    batch = lambda rows: titles.join(rows.select("track_id").distinct(), "track_id", "left_semi")
    feature_chain(batch(landed.where(F.col("batch_key") % 2 == 0)), batch_id=0, **given)
    return feature_chain(batch(landed), batch_id=1, **given).select("track_id", "source", "foreign_id")


_COLLECTED: dict[tuple[str, str], ingest.Collected] = {}


def collected(spark, d) -> ingest.Collected:
    """The second of two batches of landed rows, collected once per application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _COLLECTED:
        _COLLECTED[key] = _collect_twice(spark, d)
    return _COLLECTED[key]


def _collect_twice(spark, d) -> ingest.Collected:
    users = B.users(spark, d).select("user_id", "display_name")
    items = B.landed_library(spark, d).withColumnRenamed("batch_key", "event_id").withColumn("source_priority", F.lit(0))
    items = items.join(users, "user_id").join(wanted_titles(spark, d), "track_id").withColumn("popularity", F.lit(None).cast("int"))
    items, given = stage(items, "items"), chain_inputs(spark, d)
    stored = users.limit(0).select("user_id", F.lit(None).cast("bigint").alias("track_id"))
    catalog = canonical(B.tracks(spark, d).where(F.col("track_id") % 6 == 0))
    one = ingest.collect(items.where(F.col("event_id") % 2 == 0), users=users.limit(0), library=stored, catalog=catalog, batch_id=0, **given)
    rows, people = stage(one.library_rows, "library_rows").select("user_id", "track_id"), stage(one.users, "users")
    return ingest.collect(items, users=people, library=rows, catalog=stage(one.catalog, "catalog"), batch_id=1, **given)


@query(
    "p1_collect_gated_rows",
    views("landed", "complete", extra=CHAIN)
    + """SELECT DISTINCT user_id, track_id FROM landed WHERE track_id IN (SELECT track_id FROM featured)
         EXCEPT SELECT user_id, track_id FROM landed WHERE batch_key % 2 = 0""",
)
def p1_gated(spark, d):
    return collected(spark, d).library_rows.select("user_id", "track_id")


@query(
    "p1_collect_users",
    "SELECT DISTINCT o_custkey AS user_id, c_name AS display_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey "
    "WHERE o_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0)",
)
def p1_users(spark, d):
    return collected(spark, d).users


@query(
    "p1_collect_grown_catalog",
    views("landed", "complete", extra=CHAIN)
    + """SELECT track_id FROM complete WHERE track_id % 6 = 0
         UNION SELECT track_id FROM featured WHERE track_id IN (SELECT track_id FROM asked)""",
)
def p1_grown(spark, d):
    return collected(spark, d).catalog.select("track_id")


# ---- learned features


@query(
    "a12_embedding_metrics",
    views(
        extra={
            "v": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
            "s": f"SELECT {cosine_sql('a.vec', 'b.vec')} AS sim FROM v a, v b",
            "n": "SELECT sqrt(list_inner_product(vec, vec)) AS n FROM v",
        }
    )
    + """SELECT round(avg(sim), 6) AS mean_similarity, round(stddev_pop(sim), 6) AS std_similarity, round(min(sim), 6) AS min_similarity,
            round(max(sim), 6) AS max_similarity, (SELECT round(avg(n), 6) FROM n) AS embedding_norm_mean, (SELECT round(stddev_pop(n), 6) FROM n) AS embedding_norm_std FROM s""",
)
def a12(spark, d):
    out = E.embedding_metrics(stage(B.embeddings(spark, d).select("track_id", "vec"), "vectors"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


def model_vectors(spark, d) -> DataFrame:
    tracks = Q.complete(B.tracks(spark, d))
    vectors = feature_vectors(tracks, stage(fit_scalers(tracks), "scalers"))
    return stage(vectors.withColumn("split", C.split_name(C.split_bucket("track_id"))), "vectors")


_TRAINED: dict[tuple[str, str], tuple[Snapshots, lifecycle.Trained]] = {}


def trained(spark, d) -> tuple[Snapshots, lifecycle.Trained]:
    """One training per application and folder; every query below reads what it published."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRAINED:
        store = Snapshots(spark, new_path(spark, "artifacts"))
        _TRAINED[key] = store, lifecycle.train_and_publish(B.tracks(spark, d), store, minimum=100)
    return _TRAINED[key]


@query("m2_train_autoencoder")
def m2(spark, d):
    store, _ = trained(spark, d)
    return store.current()["history"]


@query("m3_encode_catalog")
def m3(spark, d):
    store, _ = trained(spark, d)
    return store.current()["embeddings"].select("track_id", F.size("vec").alias("dim"), F.round(F.col("vec")[0], 6).alias("first"))


@query("m4_reconstruct")
def m4(spark, d):
    store, _ = trained(spark, d)
    snapshot = store.current()
    return E.reconstruction_metrics(M.reconstruct_tracks(model_vectors(spark, d), M.weights_from(snapshot["weights"])))


@query("m5_projection")
def m5(spark, d):
    projected, variance = M.pca(model_vectors(spark, d), 2)
    return projected.select(
        "track_id", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"), F.lit(round(sum(variance), 6)).alias("explained")
    )


@query("p6_train_and_publish")
def p6(spark, d):
    store, done = trained(spark, d)
    learned = done.embedding_metrics
    both = done.metrics.withColumn("learned", learned.select(F.struct(*learned.columns)).scalar())
    return both.select(*done.metrics.columns, "learned.*", F.lit(store.current().rows["embeddings"]).alias("rows"))


@query("p6_held_out_check")
def p6_held_out(spark, d):
    """Neighbours of the tracks that training has not seen, in the learned space."""
    return trained(spark, d)[1].held_out


@query("m6_encoded_neighbours")
def m6_encoded(spark, d):
    """Neighbours in the learned space instead of the given one."""
    encoded = trained(spark, d)[0].current()["embeddings"]
    return nearest_tracks(encoded.withColumnRenamed("track_id", "query_id"), encoded, 5)


# A net small enough for SQL: every weight is a formula of its place.
WIDTHS = [12, 5, 4, 3]


def formula_weights() -> M.Weights:
    out: M.Weights = {}
    for k, (a, b) in enumerate(zip(WIDTHS[:-1], WIDTHS[1:])):
        i, j = np.meshgrid(np.arange(a), np.arange(b), indexing="ij")
        out[f"W{k}"], out[f"b{k}"] = ((i * 7 + j * 3 + k) % 11 - 3) / 8.0, np.arange(b) / 16.0 + 0.25
        if k in M.NORMALISED:
            out[f"gamma{k}"], out[f"beta{k}"] = np.ones(b), np.zeros(b)
            out[f"mean{k}"], out[f"var{k}"] = np.zeros(b), np.full(b, 1.0 - M.BN_EPS)
    # The decoder's first layer, so that no layer of the encoder is the last one.
    out["W3"], out["b3"] = np.zeros((WIDTHS[-1], 12)), np.zeros(12)
    return out


def _layer_sql(x: str, k: int) -> str:
    a, b = WIDTHS[k], WIDTHS[k + 1]
    weight = f"(((i * 7 + j * 3 + {k}) % 11 - 3) / 8.0::DOUBLE)"
    return f"list_transform(range(0, {b}), lambda j: greatest(list_sum(list_transform(range(0, {a}), lambda i: {x}[i + 1] * {weight})) + j / 16.0::DOUBLE + 0.25::DOUBLE, 0::DOUBLE))"


_SCALED = (
    [f"({c} - (SELECT min({c}) FROM kept)) / (SELECT max({c}) - min({c}) FROM kept)" if c in BOUNDED
     else f"({c} - (SELECT avg({c}) FROM kept)) / (SELECT stddev_pop({c}) FROM kept)" if c in UNBOUNDED
     else f"{c} / 11.0::DOUBLE" if c == "key" else f"{c}::DOUBLE" for c in FEATURES]
    + ["popularity / 100.0::DOUBLE"]
)
ENCODED = {
    # The snapshot embeds two thirds of the complete tracks; the others are encoded when a library holds them.
    "kept": "SELECT * FROM complete WHERE track_id % 3 <> 0",
    "f0": f"SELECT track_id, [{', '.join(_SCALED)}] AS x FROM complete",
    "f1": f"SELECT track_id, {_layer_sql('x', 0)} AS x FROM f0",
    "f2": f"SELECT track_id, {_layer_sql('x', 1)} AS x FROM f1",
    "net": f"SELECT track_id, {_layer_sql('x', 2)} AS vec FROM f2",
    "emb": f"SELECT c.*, vec, {WEIGHT_SQL} AS w FROM complete c JOIN net USING (track_id)",
    "profile": f"""SELECT user_id, list(v ORDER BY pos) AS vec FROM (
        SELECT user_id, pos, sum(w * vec[pos]) / sum(w) AS v FROM owned JOIN emb USING (track_id), (SELECT unnest(range(1, {WIDTHS[-1] + 1})) AS pos)
        GROUP BY user_id, pos HAVING count(*) >= 3) GROUP BY user_id""",
    "ranked": f"""SELECT user_id, track_id, sim, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, track_id) AS rank FROM (
        SELECT p.user_id, e.track_id, round({cosine_sql('p.vec', 'e.vec')}, 9) AS sim FROM profile p, emb e WHERE e.track_id % 3 <> 0) s
        WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.user_id = s.user_id AND o.track_id = s.track_id)""",
}


def formula_snapshot(spark, d) -> Snapshots:
    store = Snapshots(spark, new_path(spark, "formula"))
    kept = Q.complete(B.tracks(spark, d)).where(F.col("track_id") % 3 != 0)
    weights, scalers = formula_weights(), stage(fit_scalers(kept), "scalers")
    store.publish(
        {
            "embeddings": M.encode_tracks(feature_vectors(kept, scalers), weights), "scalers": scalers,
            "weights": M.weights_frame(spark, weights), "metadata": kept.select(*METADATA_COLS),
        }
    )
    return store


@query(
    "s9_snapshot_encoded",
    views("owned", "complete", extra={k: ENCODED[k] for k in ("kept", "f0", "f1", "f2", "net")})
    + "SELECT track_id, round(vec[1], 6) AS x, round(vec[2], 6) AS y, round(vec[3], 6) AS z FROM net WHERE track_id % 3 <> 0 OR track_id IN (SELECT track_id FROM owned)",
)
def s9_encoded(spark, d):
    """The snapshot's vectors, and those of library tracks that it lacks."""
    inputs = inputs_from(formula_snapshot(spark, d).current(), B.owned(spark, d), B.tracks(spark, d))
    return inputs.embedded.select("track_id", *[F.round(F.col("vec")[i], 6).alias(c) for i, c in enumerate("xyz")])


@query(
    "s9_snapshot_profile_top",
    views("owned", "complete", extra=ENCODED) + "SELECT user_id, rank::INTEGER AS rank, track_id, round(sim, 7) AS sim FROM ranked WHERE rank <= 10",
)
def s9_profile_top(spark, d):
    """The ten nearest unseen tracks of the snapshot for every listener, whose own tracks may lie outside of it."""
    library = B.owned(spark, d)
    inputs = inputs_from(formula_snapshot(spark, d).current(), library, B.tracks(spark, d), n_listeners=B.table(spark, d, "customer").count())
    return recommend.profile_top(inputs, 10).select("user_id", "rank", "track_id", F.round("sim", 7).alias("sim"))


# ---- streams


def landed_events(spark, d) -> str:
    """The play events as several landed files, as a stream would find them."""
    path = new_path(spark, "landing")
    B.table(spark, d, "events").repartitionByRange(4, "event_id").write.parquet(path)
    return path


ADDITIONS = {"added": "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS track_id, ts FROM events"}


@query("t1_stream_ingest", views(extra=ADDITIONS) + "SELECT DISTINCT user_id, track_id FROM added")
def t1(spark, d):
    base = new_path(spark, "stream")
    features = Q.complete(B.tracks(spark, d)).select("track_id", *FEATURES)
    stream = S.ingest_stream(
        S.event_additions(spark, landed_events(spark, d)), f"{base}/library", f"{base}/misses", features, f"{base}/checkpoint"
    )
    stream.awaitTermination()
    return S.read_library(spark, f"{base}/library").select("user_id", "track_id")


@query(
    "t1_stream_cache_misses",
    views("complete", extra=ADDITIONS) + "SELECT DISTINCT track_id FROM added WHERE track_id NOT IN (SELECT track_id FROM complete)",
)
def t1_misses(spark, d):
    base = new_path(spark, "stream")
    features = Q.complete(B.tracks(spark, d)).select("track_id", *FEATURES)
    stream = S.ingest_stream(
        S.event_additions(spark, landed_events(spark, d)), f"{base}/library", f"{base}/misses", features, f"{base}/checkpoint"
    )
    stream.awaitTermination()
    return spark.read.schema("track_id bigint").parquet(f"{base}/misses").select("track_id").distinct()


GROWN_FROM, TRAINED_AT, ASKED_AT = 5000, "2024-01-01T06:00:00", "2024-01-05T09:00:00"


@query(
    "p7_growth_decision",
    f"""SELECT dataset_size, new_tracks, 4::BIGINT AS days_since, CASE WHEN new_tracks >= 1000 THEN format('Significant dataset growth ({{}} new tracks)', new_tracks)
            WHEN new_tracks >= 100 THEN format('Moderate growth ({{}} new tracks, 4 days)', new_tracks) ELSE '' END AS reason
        FROM (SELECT {GROWN_FROM} + count(*) AS dataset_size, count(*) AS new_tracks FROM events)""",
)
def p7_growth(spark, d):
    """The retraining decision from the stream's daily counts and the stored history of trainings."""
    base = new_path(spark, "growth")
    S.growth_stream(S.event_additions(spark, landed_events(spark, d)), f"{base}/daily", f"{base}/checkpoint").awaitTermination()
    at = lambda text: F.to_timestamp(F.lit(text))
    files.append_state(spark, f"{base}/history", spark.range(1).select(F.lit(GROWN_FROM).alias("dataset_size")), at=at(TRAINED_AT))
    files.append_state(spark, f"{base}/history", spark.range(1).select(F.lit(1).alias("dataset_size")), "failed", at=at(ASKED_AT))
    state = lifecycle.retraining_state(spark, f"{base}/history", S.read_growth(spark, f"{base}/daily"), GROWN_FROM, at(ASKED_AT))
    return lifecycle.retrain_decision(state).select("dataset_size", "new_tracks", F.col("days_since").cast("long").alias("days_since"), "reason")


@query(
    "t2_stream_growth",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS added FROM events GROUP BY 1",
)
def t2(spark, d):
    base = new_path(spark, "growth")
    stream = S.growth_stream(S.event_additions(spark, landed_events(spark, d)), f"{base}/daily", f"{base}/checkpoint")
    stream.awaitTermination()
    return S.read_growth(spark, f"{base}/daily").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "added")
