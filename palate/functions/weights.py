"""How much one library track counts in its listener's taste vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Popularity scale with its clamp, then factor above 0.7 and factor below 0.3.
POPULARITY_SCALE = 50.0
POPULARITY_CLAMP = (0.5, 2.0)
HIGH, LOW = 0.7, 0.3
FACTORS = {
    "energy": (1.5, 0.8),
    "danceability": (1.3, 0.9),
    "valence": (1.2, 1.1),
}


def track_weight() -> Column:
    popularity = F.col("popularity").cast("double") / F.lit(POPULARITY_SCALE)
    lowest, highest = (F.lit(x) for x in POPULARITY_CLAMP)
    weight = F.when(F.col("popularity").isNull(), F.lit(1.0)).otherwise(
        F.least(F.greatest(popularity, lowest), highest)
    )
    for feature, (above, below) in FACTORS.items():
        value = F.col(feature)
        weight = weight * F.when(value > HIGH, above).when(value < LOW, below).otherwise(1.0)
    return weight
