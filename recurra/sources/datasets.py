"""Families of data sets by name, and a whole stream from the options of a run."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose
from .concepts import read_concepts
from .generators import CATALOGUE, concepts

# Real data sets with known concepts and without, generated ones that tell behaviours apart by features, and
# by performance only.
REAL = ("AQSex", "AQTemp", "Arabic", "cmc", "UCI-Wine", "qg")
UNKNOWN = (
    "Airlines", "Arrowtown", "AWS", "Beijing", "covtype", "Elec", "gassensor", "INSECTS-abn", "INSECTS-irbn", "INSECTS-oocn", "KDDCup",
    "Luxembourg", "NOAA", "outdoor", "ozone", "Poker", "PowerSupply", "Rangiora", "rialto", "Sensor", "Spam", "SpamAssassin",
)
BY_FEATURES = ("RTREESAMPLE", "HPLANESAMPLE")
BY_PERFORMANCE = ("STAGGER", "RTREEMedSAMPLE", "RBFMed")


def expand(names: list[str], real: tuple[str, ...] = REAL) -> list[tuple[str, str]]:
    """(name, kind) of data sets, each once in order of name; all_exp, real and synthetic stand for families.

    Names of the catalogue are Synthetic, those of `real` and the real ones without known concepts Real; any other raises
    ValueError.
    """
    few = (*BY_FEATURES, *BY_PERFORMANCE)
    families = {"real": [(n, "Real") for n in real], "synthetic": [(n, "Synthetic") for n in sorted({*few, *CATALOGUE})]}
    families["all_exp"] = [*families["real"], *((n, "Synthetic") for n in few)]
    out = set()
    for name in names:
        if name in families:
            out.update(families[name])
        elif name in CATALOGUE or name in (*real, *UNKNOWN):
            out.add((name, "Synthetic" if name in CATALOGUE else "Real"))
        else:
            raise ValueError(f"unknown data set {name!r}")
    return sorted(out)


@dataclass
class StreamOptions:
    """What a run says about its stream."""

    name: str
    seed: int = 1
    rows: int = 500
    repeats: int = 3
    path: str | None = None
    difficulty: int | None = None
    nrows: int = 75_000
    concept_max: int = 0
    proportion: float = 1.0
    dropoff: float = 1.0
    forward: int = 1
    pattern_noise: float = 0.0
    drift_width: int = 0
    label_noise: float = 0.0


class Stream:
    """A composed stream: its rows, segments and classes; `left` and `has_more` tell how much of it is still to come."""

    def __init__(self, rows: DataFrame, pieces: DataFrame, length: int):
        self.rows, self.pieces, self.length, self.at = rows, pieces, length, 0

    def next(self, n: int) -> DataFrame:
        """The next n rows at most."""
        start, self.at = self.at, min(self.length, self.at + n)
        return self.rows.where((F.col("example") >= start) & (F.col("example") < self.at))

    def left(self) -> int:
        return self.length - self.at

    def has_more(self) -> bool:
        return self.at < self.length

    def restart(self) -> None:
        self.at = 0


def stream(spark: SparkSession, o: StreamOptions) -> Stream:
    """Concepts of a data set, shuffled, laid out by a recurrence pattern, with gradual drift and label noise.

    Rows are (stream_id, example, segment, concept, x, y); concept is that of the segment, also near a gradual drift.
    """
    if o.path is None:
        made = concepts(spark, o.name, o.seed, o.rows, o.difficulty or 0)
    else:
        made = read_concepts(spark, o.path, nrows=o.nrows)
    made = compose.shuffled(made.withColumn("key", F.col("position")).drop("position"), o.seed, "key").drop("key")
    lengths = {r["concept"]: r["count"] for r in made.groupBy("concept").count().collect()}
    names = sorted(lengths)[: o.concept_max or None]
    order = [names[i] for i in compose.recurrence_pattern(len(names), o.repeats, o.seed, o.dropoff, o.forward, o.pattern_noise)]
    pieces = compose.segments(spark, lengths, order, o.proportion, o.concept_max).withColumn("stream_id", F.lit(0).cast("long"))
    length = pieces.agg(F.max("end")).first()[0] + 1
    places = spark.range(length).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("example"))
    located = compose.locate(places, pieces)
    if o.drift_width:
        located = compose.gradual(located, pieces, o.drift_width, o.seed)
        drawn = located.withColumns({"concept": F.col("source_concept"), "own": F.col("concept")}).drop("source_concept")
    else:
        drawn = located.withColumn("own", F.col("concept"))
    rows = compose.compose(made, drawn).join(drawn.select("stream_id", "example", "own"), ["stream_id", "example"])
    rows = rows.withColumn("concept", F.col("own")).drop("own")
    if o.label_noise:
        rows = compose.label_noise(rows, [r["y"] for r in compose.classes(made).collect()], o.label_noise, o.seed)
    return Stream(rows, pieces, length)


def read_stream_options(text: str) -> StreamOptions:
    """Options from a JSON object; keys that say nothing about a stream are left out."""
    known = StreamOptions.__dataclass_fields__
    return StreamOptions(**{k: v for k, v in json.loads(text).items() if k in known})
