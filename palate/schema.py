"""Column contracts shared by every table of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The audio features and their order, and how each one is scaled.
FEATURES = [
    "acousticness",
    "danceability",
    "energy",
    "instrumentalness",
    "key",
    "liveness",
    "loudness",
    "mode",
    "speechiness",
    "tempo",
    "valence",
]
BOUNDED = [
    "acousticness",
    "danceability",
    "energy",
    "instrumentalness",
    "liveness",
    "speechiness",
    "valence",
]
UNBOUNDED = ["loudness", "tempo"]
MOOD_FEATURES = ["energy", "danceability", "valence", "acousticness", "instrumentalness"]
LIBRARY_FEATURES = ["acousticness", "danceability", "energy", "key", "mode"]

INTEGER_FEATURES = ["key", "mode"]
METADATA_COLS = ["track_id", "track_name", "artists", "popularity"]
CATALOG_COLS = METADATA_COLS + FEATURES
MODEL_INPUTS = FEATURES + ["popularity_norm"]

# Display-style and store-style names that mean the same column.
COLUMN_ALIASES = {
    "Track ID": "track_id",
    "Track Name": "track_name",
    "Album Name": "album_name",
    "Artist(s)": "artists",
    "Playlist Name": "playlist_name",
    "Owner ID": "user_id",
    "Popularity": "popularity",
    "key_value": "key",
    "mode_value": "mode",
}


class MissingColumns(ValueError):
    """A frame lacks columns that a job needs; `columns` names them."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        super().__init__("missing audio features: " + ", ".join(columns))


def feature_type(name: str) -> T.DataType:
    return T.IntegerType() if name in INTEGER_FEATURES else T.DoubleType()


def catalog_schema(id_type: T.DataType | None = None) -> T.StructType:
    fields = [
        T.StructField("track_id", id_type or T.LongType()),
        T.StructField("track_name", T.StringType()),
        T.StructField("artists", T.StringType()),
        T.StructField("popularity", T.IntegerType()),
    ]
    return T.StructType(fields + [T.StructField(c, feature_type(c)) for c in FEATURES])


def feature_schema(id_type: T.DataType | None = None) -> T.StructType:
    fields = [T.StructField("track_id", id_type or T.LongType())]
    return T.StructType(fields + [T.StructField(c, feature_type(c)) for c in FEATURES])


def standardize_columns(df: DataFrame) -> DataFrame:
    """Rename any known spelling of a column to the one used here."""
    return df.withColumnsRenamed({old: new for old, new in COLUMN_ALIASES.items() if old in df.columns})


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(missing)
    return df


def missing_to_null(col: Column, dtype: T.DataType) -> Column:
    """NaN and the empty string both mean "no value"; later code sees only NULL."""
    if isinstance(dtype, T.StringType):
        return F.nullif(col, F.lit(""))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def nulls_at_source(df: DataFrame) -> DataFrame:
    return df.select(*[missing_to_null(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; text that is not a number becomes NULL."""
    casts = {c: F.col(c).try_cast("double") for c in columns if c in df.columns}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in casts.items()})


def canonical(df: DataFrame) -> DataFrame:
    """The 15 catalog columns in their order and types."""
    types = {f.name: f.dataType for f in catalog_schema().fields if f.name != "track_id"}
    return df.select(
        *[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in CATALOG_COLS]
    )
