"""Lists that are computed anew only for listeners whose library changed.

A library's fingerprint is its number of tracks and two sums of hashes: no order matters, and fingerprints of parts add up, so
the print of a grown library is the stored one plus that of what was added. A run writes the lists and prints of changed listeners only
and is then named by a pointer row; readers take each listener's newest run, so the work and the writing of a run grow with the changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palate.plans.recommend import Inputs
from palate.session import stage
from palate.sources.files import read_parquet

#: A prime below 2^31: four billion tracks can be added up without overflow.
MODULUS = (1 << 31) - 1
PRINT = ["n_tracks", "print_a", "print_b"]


def fingerprints(library: DataFrame) -> DataFrame:
    """(user_id, n_tracks, print_a, print_b) of a library with one row per (listener, track)."""
    hashed = lambda seed: F.sum(F.pmod(F.xxhash64("track_id", F.lit(seed)), F.lit(MODULUS)))
    return library.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_tracks"), hashed(1).alias("print_a"), hashed(2).alias("print_b"))


def add_prints(one: DataFrame, other: DataFrame) -> DataFrame:
    """Fingerprints of two libraries that share no row, taken together."""
    return one.unionByName(other).groupBy("user_id").agg(*[F.sum(c).alias(c) for c in PRINT])


@dataclass
class ListStore:
    spark: SparkSession
    path: str

    RUNS = T.StructType().add("run", "long").add("basis", "string").add("recomputed", "long")
    PRINTS = T.StructType().add("user_id", "long").add("n_tracks", "long").add("print_a", "long").add("print_b", "long").add("run", "long")

    def runs(self) -> DataFrame:
        return read_parquet(self.spark, f"{self.path}/runs", self.RUNS)

    def last(self):
        """The newest finished run, or nothing."""
        return self.runs().orderBy(F.desc("run")).first()

    def prints(self, upto: int | None) -> DataFrame:
        """Each listener's newest print among finished runs, with its run; n_tracks 0 stands for a listener who left."""
        rows = read_parquet(self.spark, f"{self.path}/prints", self.PRINTS)
        finished = rows.join(self.runs().select("run"), "run", "left_semi").where(F.col("run") <= (-1 if upto is None else upto))
        newest = finished.groupBy("user_id").agg(F.max("run").alias("run"))
        return finished.join(newest, ["user_id", "run"])

    def lists(self) -> DataFrame:
        """The current list of every listener."""
        row = self.last()
        rows = self.spark.read.option("basePath", f"{self.path}/lists").parquet(f"{self.path}/lists")
        return rows.join(self.prints(row.run if row else None).select("user_id", "run"), ["user_id", "run"], "left_semi").drop("run")

    def add(self, run: int, basis: str, prints: DataFrame, lists: DataFrame) -> None:
        """Both tables first, the pointer last; a run that was lost in between is written over."""
        prints.write.mode("overwrite").parquet(f"{self.path}/prints/run={run}")
        lists.write.mode("overwrite").parquet(f"{self.path}/lists/run={run}")
        pointer = prints.agg(F.lit(run).cast("bigint").alias("run"), F.lit(basis).alias("basis"), F.count(F.lit(1)).alias("recomputed"))
        pointer.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")


def refresh(store: ListStore, inputs: Inputs, lists_of: Callable[[Inputs], DataFrame], basis: str) -> ListStore:
    """One run: the lists of new and changed listeners; those who left lose theirs.

    ``basis`` names what lists depend on beside the library, the catalog's version for instance: another one than that of the
    run before makes all listeners changed.
    """
    last = store.last()
    run = last.run + 1 if last else 0
    now = stage(fingerprints(inputs.library.select("user_id", "track_id")), "prints")
    stored = store.prints(last.run if last and last.basis == basis else None)
    before = stored.select("user_id", *[F.col(c).alias(f"old_{c}") for c in PRINT])
    joined = now.join(before, "user_id", "full_outer")
    differs = ~(F.struct(*PRINT).eqNullSafe(F.struct(*[F.col(f"old_{c}").alias(c) for c in PRINT])))
    gone = F.col("n_tracks").isNull() & (F.col("old_n_tracks") > 0)
    changed = joined.where((F.col("n_tracks").isNotNull() & differs) | gone)
    changed = stage(changed.select("user_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in PRINT]), "changed")
    library = inputs.library.join(changed.where("n_tracks > 0").select("user_id"), "user_id", "left_semi")
    store.add(run, basis, changed, lists_of(replace(inputs, library=stage(library, "changed_library"))))
    return store
