"""A Python data source for named concept streams: spark.read.format("concepts").option("name", "STAGGERS")."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ConceptSource(DataSource):
    """Options: name (STAGGER or SEA), rows per concept, seed. Each concept is a partition, made where it is read."""

    @classmethod
    def name(cls) -> str:
        return "concepts"

    def schema(self) -> str:
        return "concept string, position long, x array<double>, y int"

    def reader(self, schema):
        return ConceptReader(self.options)


class Part(InputPartition):
    def __init__(self, concept: int):
        self.concept = concept


class ConceptReader(DataSourceReader):
    def __init__(self, options):
        self.kind = options.get("name", "STAGGER")
        self.rows, self.seed = int(options.get("rows", "1000")), int(options.get("seed", "1"))
        if self.kind not in ("STAGGER", "STAGGERS", "SEA"):
            raise ValueError(f"unknown data set {self.kind!r}")

    def partitions(self):
        return [Part(c) for c in range(4 if self.kind == "SEA" else 3)]

    def read(self, part):
        import numpy as np

        rng = np.random.default_rng([self.seed, part.concept])
        c = part.concept
        for i in range(self.rows):
            if self.kind == "SEA":
                x = (rng.random(3) * 10).tolist()
                y = int(x[0] + x[1] <= (8.0, 9.0, 7.0, 9.5)[c])
            else:
                a, b, s = rng.integers(0, 3, 3).tolist()
                x = [float(a), float(b), float(s)]
                y = int(((a == 0) and (b == 0), (b == 1) or (s == 0), a in (1, 2))[c])
            yield f"{self.kind}_{c}", i, x, y


def register(spark) -> None:
    spark.dataSource.register(ConceptSource)
