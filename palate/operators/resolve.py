"""Matching titles and artists of one catalog to another, stage by stage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.functions.indel import indel_ratios, letter_overlap
from palate.functions.text import ARTIST_ALIASES, artist_list, normalize_artist, normalize_title
from palate.operators.ranking import keep_first
from palate.schema import FEATURES
from palate.session import fill_slots, stage, task_slots

# Score that settles a match, score that needs an artist match too, and that artist score.
THRESHOLD, SOFT_THRESHOLD, ARTIST_THRESHOLD = 80.0, 60.0, 70.0
# Priorities of a match, best first.
ISRC, ALBUM_EXACT, ALBUM_FUZZY, ALBUM_SOFT, ALBUM_SOFT_BARE = 1, 2, 3, 4, 5
ARTIST_EXACT, ARTIST_FUZZY, ARTIST_SOFT, ARTIST_SOFT_BARE = 6, 7, 8, 9
BLOCK_ROWS = 512


def artist_names(artists: Column) -> Column:
    """Every credited artist, normalised, plus the known other spellings, without repeats."""
    entries = [F.lit(x) for name, other in ARTIST_ALIASES.items() for x in (name, other[0])]
    spellings = lambda raw: F.array_compact(F.array(raw, F.create_map(*entries)[raw]))
    every = F.flatten(F.transform(artist_list(F.lower(artists)), spellings))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, normalize_artist), lambda a: a != "")))


def artist_tokens(df: DataFrame, key: str) -> DataFrame:
    """(key, artist): one row per name of each credited artist."""
    return df.select(key, F.explode(artist_names(F.col("artists"))).alias("artist"))


def with_titles(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "norm": normalize_title(F.col("title")),
            "bare": normalize_title(F.col("title"), strip_parentheses=True),
            "artist_names": artist_names(F.col("artists")),
        }
    )


def _possible(lefts: list[str], rights: list[str], level: float) -> tuple[np.ndarray, np.ndarray]:
    """The highest ratio that shared letters allow each pair, and whether it reaches `level`."""
    size = np.add.outer([len(t) for t in lefts], [len(t) for t in rights])
    most = np.where(size > 0, 200.0 * letter_overlap(lefts, rights) / np.maximum(size, 1), 100.0)
    return most, most >= level


def _artists_meet(mine: list[list[str]], theirs: list[list[str]]) -> np.ndarray:
    """Whether any artist of a wanted title resembles any artist of a foreign one; each pair of names is compared once."""

    def incidence(lists):
        names, at = np.unique(np.array([a for x in lists for a in x], object), return_inverse=True) if any(lists) else (np.array([], object), [])
        held = np.zeros((len(lists), len(names)), np.float32)
        held[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), at] = 1
        return names.tolist(), held

    (x_names, x_held), (y_names, y_held) = incidence(mine), incidence(theirs)
    near = np.zeros((len(x_names), len(y_names)), np.float32)
    if x_names and y_names:
        i, j = np.nonzero(_possible(x_names, y_names, ARTIST_THRESHOLD)[1])
        near[i, j] = indel_ratios(x_names, y_names, i, j) > ARTIST_THRESHOLD
    return (x_held @ near) @ y_held.T > 0


def _score_kernel(album: bool):
    """Best foreign title of every wanted title in one bounded cell of a block.

    No q-gram need be shared at these thresholds (a ratio of 60 allows 0.4 edits per letter of both titles), so candidates
    are bounded by shared letters instead, for all pairs by one matrix product; that includes the bound by length.
    """
    fuzzy, soft, soft_bare = (
        (ALBUM_FUZZY, ALBUM_SOFT, ALBUM_SOFT_BARE) if album else (ARTIST_FUZZY, ARTIST_SOFT, ARTIST_SOFT_BARE)
    )

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["block", "wanted_id", "priority", "score", "foreign_id"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64()]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        mine = {c: left.column(c).to_pylist() for c in ("norm", "bare")}
        theirs = {c: right.column(c).to_pylist() for c in ("norm", "bare")}
        foreign = right.column("foreign_id").to_numpy()
        most, likely = _possible(mine["norm"], theirs["norm"], SOFT_THRESHOLD)
        _, bare_likely = _possible(mine["bare"], theirs["bare"], SOFT_THRESHOLD)
        # The most promising title of each wanted one comes first: it often settles what others must exceed.
        first = most.argmax(1)
        score = indel_ratios(mine["norm"], theirs["norm"], np.arange(len(first)), first)
        floor = np.where(score >= THRESHOLD, score, 0.0)
        if album:
            meets = _artists_meet(left.column("artist_names").to_pylist(), right.column("artist_names").to_pylist())
            likely &= meets | (most >= THRESHOLD)
            bare_likely &= meets
        likely &= most >= floor[:, None]
        bare_likely &= (floor < THRESHOLD)[:, None]
        i, j = np.nonzero(likely | bare_likely)
        score = np.zeros(len(i))
        tried = likely[i, j]
        score[tried] = indel_ratios(mine["norm"], theirs["norm"], i[tried], j[tried])
        level = np.where(score >= THRESHOLD, fuzzy, np.where(score >= SOFT_THRESHOLD, soft, soft_bare))
        again = (score < SOFT_THRESHOLD) & bare_likely[i, j]
        score[again] = indel_ratios(mine["bare"], theirs["bare"], i[again], j[again])
        good = score >= SOFT_THRESHOLD
        if album:
            good &= (level == fuzzy) | meets[i, j]
        i, j, level, score = i[good], j[good], level[good], score[good]
        order = np.lexsort((foreign[j], -score, level, i))
        best = order[np.append(True, np.diff(i[order]) > 0)[: len(order)]]
        rows = left.select(["block", "wanted_id"]).take(pa.array(i[best]))
        values = [*rows.columns, level[best], score[best], foreign[j[best]]]
        return pa.table({n: pa.chunked_array(v).cast(k) if isinstance(v, pa.ChunkedArray) else pa.array(v, k) for n, k, v in zip(names, kinds, values)})

    return kernel


def _block_cells(wanted: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut both sides of every block into groups of bounded size and pair the groups by an equi-join key.

    A block that holds a third of all titles becomes many cells; a small block is one cell.
    """
    n_w = wanted.groupBy("block").agg(F.count(F.lit(1)).alias("n_w"))
    n_f = foreign.groupBy("block").agg(F.count(F.lit(1)).alias("n_f"))
    groups = n_w.join(n_f, "block").select(
        "block",
        F.ceil(F.col("n_w") / BLOCK_ROWS).cast("int").alias("w_groups"),
        F.ceil(F.col("n_f") / BLOCK_ROWS).cast("int").alias("f_groups"),
    )
    group = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        wanted.join(groups, "block")
        .withColumn("w_group", group("wanted_id", "w_groups"))
        .withColumn("f_group", every("f_groups"))
        .drop("w_groups", "f_groups")
    )
    right = (
        foreign.join(groups, "block")
        .withColumn("f_group", group("foreign_id", "f_groups"))
        .withColumn("w_group", every("w_groups"))
        .drop("w_groups", "f_groups")
    )
    return left, right


def best_in_block(wanted: DataFrame, foreign: DataFrame, album: bool) -> DataFrame:
    """wanted(block, wanted_id, norm, bare, artist_names), foreign(block, foreign_id, ...): the best fuzzy
    match per wanted title. Cells report only their best, pairs are never written out."""
    left, right = _block_cells(wanted, foreign)
    keys = ["block", "w_group", "f_group"]
    parts = 4 * task_slots(wanted.sparkSession)
    found = (
        left.repartition(parts, *keys)
        .groupBy(*keys)
        .cogroup(right.repartition(parts, *keys).groupBy(*keys))
        .applyInArrow(_score_kernel(album), "block string, wanted_id bigint, priority int, score double, foreign_id bigint")
    )
    return keep_first(found, ["block", "wanted_id"], [F.col("priority"), F.desc("score"), F.col("foreign_id")])


def _distinct_titles(df: DataFrame, id_col: str, out: str) -> DataFrame:
    """One row per distinct (block, titles, artists): repeats share the smallest id."""
    return df.groupBy("block", "norm", "bare", "artist_names").agg(F.min(id_col).alias(out))


def _by_block(df: DataFrame, key: str, is_album: bool) -> DataFrame:
    block = F.lower(F.nullif("album", F.lit(""))) if is_album else F.explode("artist_names")
    return df.select(block.alias("block"), key, "norm", "bare", "artist_names").where(F.col("block").isNotNull())


def resolve_titles(wanted: DataFrame, foreign: DataFrame) -> DataFrame:
    """wanted(track_id, title, artists, album, isrc) against foreign(foreign_id, ...same).

    Stages: shared ISRC; album (exact title, then fuzzy); artist (exact, then fuzzy). A later stage sees
    only tracks that no earlier one settled. A title that normalises to nothing matches by ISRC only.
    Result: track_id, foreign_id, priority, score.
    """
    # Normalising is heavy per row: a table of few files is spread first.
    wanted = stage(with_titles(fill_slots(wanted)), "wanted")
    foreign = stage(with_titles(fill_slots(foreign)), "foreign")

    def result(df, priority):
        return df.select("track_id", "foreign_id", F.lit(priority).alias("priority"), F.lit(100.0).alias("score"))

    codes = foreign.where("isrc IS NOT NULL").groupBy("isrc").agg(F.min("foreign_id").alias("foreign_id"))
    settled = result(wanted.where("isrc IS NOT NULL").join(codes, "isrc"), ISRC)
    titled, known = wanted.where("norm <> ''"), foreign.where("norm <> ''")

    for is_album, exact in ((True, ALBUM_EXACT), (False, ARTIST_EXACT)):
        offered = _by_block(known, "foreign_id", is_album)
        first = offered.groupBy("block", "norm").agg(F.min("foreign_id").alias("foreign_id"))
        todo = _by_block(titled.join(settled, "track_id", "left_anti"), "track_id", is_album)
        same = todo.join(first, ["block", "norm"]).groupBy("track_id").agg(F.min("foreign_id").alias("foreign_id"))
        rest = todo.join(same, "track_id", "left_anti")
        asked = _distinct_titles(rest, "track_id", "wanted_id")
        fuzzy = best_in_block(asked, _distinct_titles(offered, "foreign_id", "foreign_id"), is_album)
        same_title = ["block", "norm", "bare", "artist_names"]
        hits = rest.join(asked, same_title).select("track_id", "block", "wanted_id").join(fuzzy, ["block", "wanted_id"])
        chosen = keep_first(hits, ["track_id"], [F.col("priority"), F.desc("score"), F.col("foreign_id")])
        found = result(same, exact).unionByName(chosen.select(*settled.columns))
        settled = stage(settled.unionByName(found), "resolved")
    return settled


def feature_cascade(rows: DataFrame, features: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Features by own id, else by a known foreign id; `source` says which, NULL if neither.

    One row per row of `rows`: of repeated feature rows the smallest counts, of several foreign ids the smallest
    that has features.
    """
    packed = features.groupBy("track_id").agg(F.min(F.struct(*FEATURES)).alias("f"))
    direct = packed.select("track_id", F.col("f").alias("direct"))
    known = packed.select(F.col("track_id").alias("foreign_id"), "f")
    via = crosswalk.select("track_id", "foreign_id").join(known, "foreign_id")
    via = via.groupBy("track_id").agg(F.min(F.struct("foreign_id", "f")).alias("first")).select("track_id", F.col("first.f").alias("via"))
    joined = rows.join(direct, "track_id", "left").join(via, "track_id", "left")
    source = F.when(F.col("direct").isNotNull(), "direct").when(F.col("via").isNotNull(), "crosswalk")
    best = F.coalesce("direct", "via")
    return joined.select("track_id", source.alias("source"), *[best[c].alias(c) for c in FEATURES])
