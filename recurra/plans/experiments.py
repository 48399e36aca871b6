"""Experiment grids and tables over many runs; here orders stand for runs: nation, priority and clerk's seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import query
from .tables import table

CLASSIFIERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def option_grid(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """Every combination of the option lists, one row each with its hash as run_id. Lists are parameters, not data."""
    grid = None
    for name, values in options.items():
        own = spark.createDataFrame([(v,) for v in values], [name])
        grid = own if grid is None else grid.crossJoin(own)
    return grid.withColumn("run_id", F.xxhash64(*options))


def missing_runs(grid: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Requested combinations without a finished run."""
    return grid.join(finished, keys, "left_anti")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """(data, classifier, seed, score): mean order price by nation, priority and a seed."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("data"), F.col("o_orderpriority").alias("classifier"), (F.col("o_orderkey") % 3).alias("seed")).agg(F.avg("o_totalprice").alias("score"))


def bounded(rows: DataFrame, lower: str, upper: str, names: list[str], keys: list[str]) -> DataFrame:
    """Scores relative to a lower and an upper classifier of the same keys.

    1 where that is not a number or infinite: equal bounds, or a bound that did not run. Classifiers without a score for
    the keys have no row.
    """
    wide = rows.groupBy(*keys).pivot("classifier", names).agg(F.first("score"))
    lo, hi = F.col(f"`{lower}`"), F.col(f"`{upper}`")

    def relative(n: str):
        own = F.col(f"`{n}`")
        return F.when(own.isNotNull(), F.when(hi != lo, (own - lo) / (hi - lo)).otherwise(1.0)).alias(n)

    out = wide.select(*keys, *[relative(n) for n in names])
    return out.unpivot(keys, [F.col(f"`{n}`") for n in names], "classifier", "bounded").where("bounded is not null")


def average_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean rank of each classifier over the keys, the largest score first; ties share their mean rank."""
    g = Window.partitionBy(*keys)
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "score"))
    r = rows.withColumn("rank", F.rank().over(g.orderBy(F.desc("score"))) + (same - 1) / 2)
    return r.groupBy("classifier").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def summary_table(rows: DataFrame, row: str, column: str, cell: str, columns: list[str]) -> DataFrame:
    """One row per value of `row`, one column per value of `column`, in that order; cells are texts, empty where missing."""
    wide = rows.groupBy(row).pivot(column, columns).agg(F.first(cell))
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]).orderBy(row)


def transposed(rows: DataFrame, row: str, columns: list[str], values: list) -> DataFrame:
    """Rows become columns: (name, one column for each of `values` of `row`). Tables of results are small."""
    long = rows.unpivot([row], [F.col(f"`{c}`") for c in columns], "name", "cell")
    return long.groupBy("name").pivot(row, values).agg(F.first("cell"))


def latex_table(table: DataFrame, caption: str, bold: list[str] | None = None) -> str:
    """A results table as LaTeX: one line per row, `bold` columns set bold. It is as long as the table, which is small."""

    def text(v) -> str:
        out = "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
        for c in "&%$#_{}":
            out = out.replace(c, f"\\{c}")
        return out

    def line(cells: list[str]) -> str:
        return " & ".join(f"\\textbf{{{x}}}" if c in (bold or []) else x for c, x in zip(table.columns, cells, strict=True)) + r" \\"

    body = [line([text(v) for v in r]) for r in table.collect()]
    head = [r"\begin{table}", rf"\caption{{{text(caption)}}}", rf"\begin{{tabular}}{{l{'r' * (len(table.columns) - 1)}}}", r"\toprule"]
    return "\n".join([*head, " & ".join(map(text, table.columns)) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def critical_difference(k: int, n: int) -> float:
    """Nemenyi's critical difference at 0.05 of mean ranks of k classifiers over n data sets."""
    # Studentised range over the root of two, for 2 to 10 classifiers.
    q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}
    return q[k] * (k * (k + 1) / (6 * n)) ** 0.5


def deltas(base: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Inner join of results to base results on the keys, with value_base and the change."""
    b = base.select(*keys, F.col(value).alias(f"{value}_base"))
    return other.join(b, keys).withColumn(f"c_{value}", F.col(value) - F.col(f"{value}_base"))


RUNS_SQL = "runs AS (SELECT c_nationkey AS data, o_orderpriority AS classifier, o_orderkey % 3 AS seed, avg(o_totalprice) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"


@query(
    f"""WITH {RUNS_SQL}, b AS (SELECT data, seed, max(score) FILTER (classifier = '5-LOW') AS lo, max(score) FILTER (classifier = '1-URGENT') AS hi FROM runs GROUP BY 1, 2),
    z AS (SELECT data, seed, classifier, CASE WHEN hi <> lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS v FROM runs JOIN b USING (data, seed))
    SELECT classifier, round(avg(v), 5) AS mean_bounded, round(stddev_samp(v), 5) AS stdev_bounded, count(*) AS n FROM z WHERE v IS NOT NULL GROUP BY 1""",
    log=False,
)
def pivot_bounded_scores(spark, d):
    b = bounded(runs(spark, d), "5-LOW", "1-URGENT", CLASSIFIERS, ["data", "seed"])
    return b.groupBy("classifier").agg(F.round(F.avg("bounded"), 5).alias("mean_bounded"), F.round(F.stddev_samp("bounded"), 5).alias("stdev_bounded"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {RUNS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY data, seed ORDER BY score DESC) + (count(*) OVER (PARTITION BY data, seed, score) - 1) / 2.0 AS rank FROM runs)
    SELECT classifier, avg(rank) AS mean_rank, count(*) AS n FROM r GROUP BY 1""",
    log=False,
)
def avg_ranks(spark, d):
    return average_ranks(runs(spark, d), ["data", "seed"])


@query(
    f"""WITH {RUNS_SQL}, base AS (SELECT data, seed, score FROM runs WHERE classifier = '5-LOW'),
    j AS (SELECT r.classifier, r.score, r.score - b.score AS c FROM runs r JOIN base b USING (data, seed) WHERE r.classifier <> '5-LOW')
    SELECT classifier, avg(score) AS mean_score, avg(c) AS mean_change, count(*) AS n FROM j GROUP BY 1""",
    log=False,
)
def experiment_delta_join(spark, d):
    r = runs(spark, d)
    j = deltas(r.where("classifier = '5-LOW'"), r.where("classifier <> '5-LOW'"), ["data", "seed"], "score")
    return j.groupBy("classifier").agg(F.avg("score").alias("mean_score"), F.avg("c_score").alias("mean_change"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH g AS (SELECT p.c AS classifier, CAST(n.range AS BIGINT) AS data, CAST(s.range AS BIGINT) AS seed FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE']) AS c) p, range(25) n, range(4) s)
    SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = g.classifier AND c_nationkey = g.data AND o_orderkey % 4 = g.seed)""",
    log=False,
)
def option_grid_anti_join(spark, d):
    grid = option_grid(spark, {"classifier": [*CLASSIFIERS, "6-NONE"], "data": list(range(25)), "seed": list(range(4))})
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    done = o.select(F.col("o_orderpriority").alias("classifier"), F.col("c_nationkey").alias("data"), (F.col("o_orderkey") % 4).alias("seed"))
    return missing_runs(grid, done, ["classifier", "data", "seed"]).select("classifier", "data", "seed")


@query(
    f"""WITH {RUNS_SQL} SELECT data, printf('%.2f(%.2f)', avg(score), stddev_pop(score)) AS cell FROM runs GROUP BY 1""",
    log=False,
)
def summary_cells(spark, d):
    return runs(spark, d).groupBy("data").agg(F.format_string("%.2f(%.2f)", F.avg("score"), F.stddev_pop("score")).alias("cell"))
