"""Registry of named queries, each with the SQL that another engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


FEATURE_LIST = (
    "acousticness, danceability, energy, instrumentalness, key, liveness, loudness, mode, speechiness, tempo, valence"
)
ALL_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_LIST.split(", "))


def _modular(mult: int, plus: int) -> str:
    return f"((p_partkey * {mult} + {plus}) % 1000) / CAST(1000 AS DOUBLE)"


MOOD_SQL = """CASE
    WHEN energy > 0.7 AND danceability > 0.6 THEN 'High Energy'
    WHEN energy < 0.4 AND acousticness > 0.4 AND valence > 0.5 THEN 'Chill'
    WHEN energy < 0.5 AND instrumentalness > 0.3 AND danceability < 0.5 THEN 'Focus'
    WHEN valence < 0.3 AND acousticness > 0.3 THEN 'Emotional'
    WHEN energy > 0.6 AND valence > 0.6 AND danceability > 0.7 THEN 'Party'
    ELSE 'Medium Energy' END"""

WEIGHT_SQL = """(CASE WHEN popularity IS NULL THEN 1.0::DOUBLE
        ELSE least(greatest(popularity / 50.0::DOUBLE, 0.5::DOUBLE), 2.0::DOUBLE) END
    * CASE WHEN energy > 0.7 THEN 1.5::DOUBLE WHEN energy < 0.3 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN danceability > 0.7 THEN 1.3::DOUBLE WHEN danceability < 0.3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN valence > 0.7 THEN 1.2::DOUBLE WHEN valence < 0.3 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)"""


def cosine_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0.0::DOUBLE ELSE "
        f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END"
    )


# Each entry: the tables it builds on, and its body.
VIEWS: dict[str, tuple[list[str], str]] = {
    "tracks": (
        [],
        f"""SELECT p_partkey AS track_id, p_name AS track_name, p_brand AS artists, 2 * p_size AS popularity,
            CASE WHEN p_partkey % 37 <> 0 THEN {_modular(7919, 13)} END AS acousticness,
            {_modular(104729, 50)} AS danceability, {_modular(1299709, 87)} AS energy,
            {_modular(32452843, 124)} AS instrumentalness,
            CAST((p_partkey * 31 + 5) % 12 AS INTEGER) AS key,
            {_modular(49979687, 161)} AS liveness,
            ((p_partkey * 104729 + 7) % 6000) / CAST(100 AS DOUBLE) - 60 AS loudness,
            CAST((p_partkey * 17 + 3) % 2 AS INTEGER) AS mode,
            {_modular(67867967, 198)} AS speechiness,
            CASE WHEN p_partkey % 41 <> 0
                 THEN ((p_partkey * 15485863 + 11) % 14000) / CAST(100 AS DOUBLE) + 60 END AS tempo,
            {_modular(86028121, 235)} AS valence
        FROM part""",
    ),
    "complete": (["tracks"], f"SELECT * FROM tracks WHERE {ALL_PRESENT}"),
    "users": ([], "SELECT c_custkey AS user_id, c_name AS display_name, c_mktsegment AS cohort FROM customer"),
    "landed": (
        [],
        """SELECT o_custkey AS user_id, l_partkey AS track_id, o_orderdate AS added_at,
            o_orderpriority AS playlist_name, o_orderkey AS batch_key
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "library": (
        ["landed"],
        """SELECT user_id, track_id, added_at, playlist_name FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, track_id ORDER BY added_at, batch_key) AS rn FROM landed)
        WHERE rn = 1""",
    ),
    "owned": (["landed"], "SELECT DISTINCT user_id, track_id FROM landed"),
    "emb": (
        ["complete"],
        f"""SELECT c.*, CAST(embedding AS DOUBLE[]) AS vec, label, {WEIGHT_SQL} AS w
        FROM complete c JOIN embeddings ON track_id = vec_id""",
    ),
    "moody": (
        ["library", "tracks"],
        f"SELECT l.user_id, l.added_at, t.*, {MOOD_SQL} AS mood FROM library l JOIN tracks t USING (track_id)",
    ),
    "mood_counts": (
        ["moody"],
        """SELECT user_id, mood, cnt, cnt / CAST(sum(cnt) OVER (PARTITION BY user_id) AS DOUBLE) * 100 AS pct
        FROM (SELECT user_id, mood, count(*) AS cnt FROM moody GROUP BY 1, 2)""",
    ),
    "rich": (["library", "tracks"], "SELECT l.user_id, l.added_at, l.playlist_name, t.* FROM library l JOIN tracks t USING (track_id)"),
    "profile": (
        ["owned", "emb"],
        """SELECT user_id, list(v ORDER BY pos) AS vec FROM (
            SELECT user_id, pos, sum(w * vec[pos]) / sum(w) AS v
            FROM owned JOIN emb USING (track_id), (SELECT unnest(range(1, 65)) AS pos)
            GROUP BY user_id, pos HAVING count(*) >= 3) GROUP BY user_id""",
    ),
    "profile_ranked": (
        ["profile", "emb", "owned"],
        f"""SELECT user_id, track_id, sim, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, track_id) AS rank
        FROM (SELECT p.user_id, e.track_id, round({cosine_sql('p.vec', 'e.vec')}, 9) AS sim
              FROM profile p, emb e) s
        WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.user_id = s.user_id AND o.track_id = s.track_id)""",
    ),
    "seed_ranked": (
        ["emb"],
        f"""SELECT seed_id, track_id, sim, row_number() OVER (PARTITION BY seed_id ORDER BY sim DESC, track_id) AS rk
        FROM (SELECT q.track_id AS seed_id, c.track_id, round({cosine_sql('q.vec', 'c.vec')}, 9) AS sim FROM emb q, emb c)""",
    ),
    "usable": (
        ["owned", "emb"],
        f"""SELECT user_id, track_id, mood FROM (
            SELECT user_id, track_id, {MOOD_SQL} AS mood, count(*) OVER (PARTITION BY user_id) AS n
            FROM owned JOIN emb USING (track_id)) WHERE n >= 3""",
    ),
}


def views(*names: str, extra: dict[str, str] | None = None) -> str:
    """A WITH clause of the named views and all they build on; `extra` adds further ones in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in ordered] + [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
