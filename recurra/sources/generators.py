"""Stream generators as column expressions over a range of row numbers; every draw is a hash of seed and row."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, name: str, example: Column | str = "example") -> Column:
    """Uniform in [0, 1): 48 bits of an MD5, so other engines can repeat it."""
    row = F.col(example) if isinstance(example, str) else example
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), row.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def normal(seed: int, name: str, example: Column | str = "example") -> Column:
    """Standard normal by Box and Muller."""
    u = F.greatest(uniform(seed, name + "a", example), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, name + "b", example))


def _rows(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "example") if partitions else spark.range(n).withColumnRenamed("id", "example")


def stagger(spark: SparkSession, n: int, function: int, seed: int) -> DataFrame:
    """Size, colour and shape in 0..2; one of three rules."""
    x = [F.floor(uniform(seed, c) * 3) for c in ("size", "color", "shape")]
    rows = _rows(spark, n).select("example", *[c.alias(k) for c, k in zip(x, ("size", "color", "shape"), strict=True)])
    rules = [
        (F.col("size") == 0) & (F.col("color") == 0),
        (F.col("color") == 1) | (F.col("shape") == 0),
        (F.col("size") == 1) | (F.col("size") == 2),
    ]
    y = rules[function % 3].cast("int")
    return rows.select("example", F.array(*[F.col(k).cast("double") for k in ("size", "color", "shape")]).alias("x"), y.alias("y"))


#: Thresholds of the four concepts.
SEA_THRESHOLDS = (8.0, 9.0, 7.0, 9.5)


def sea(spark: SparkSession, n: int, function: int, seed: int) -> DataFrame:
    """Three numbers in [0, 10); label 1 where the first two add up to at most the concept's threshold."""
    rows = _rows(spark, n).select("example", *[(uniform(seed, f"x{i}") * 10).alias(f"x{i}") for i in range(3)])
    y = (F.col("x0") + F.col("x1") <= SEA_THRESHOLDS[function % 4]).cast("int")
    return rows.select("example", F.array("x0", "x1", "x2").alias("x"), y.alias("y"))


def agrawal(spark: SparkSession, n: int, function: int, seed: int) -> DataFrame:
    """Nine loan attributes; ten rules on age, salary, education and loan."""
    u = lambda k: uniform(seed, k)
    rows = _rows(spark, n).select("example", (20000 + 130000 * u("salary")).alias("salary"), F.floor(20 + 61 * u("age")).cast("double").alias("age"), F.floor(5 * u("elevel")).cast("double").alias("elevel"), F.floor(20 * u("car")).cast("double").alias("car"), F.floor(9 * u("zip")).cast("double").alias("zipcode"), F.floor(1 + 30 * u("hyears")).cast("double").alias("hyears"), (500000 * u("loan")).alias("loan"), u("com").alias("uc"), u("hv").alias("uh"))
    rows = rows.withColumn("commission", F.when(F.col("salary") >= 75000, 0.0).otherwise(10000 + 65000 * F.col("uc")))
    rows = rows.withColumn("hvalue", (9 - F.col("zipcode")) * 100000 * (0.5 + F.col("uh")))
    age, salary, level, loan = F.col("age"), F.col("salary"), F.col("elevel"), F.col("loan")
    young, old = age < 40, age >= 60
    by_age = lambda a, b, c: F.when(young, a).when(~old, b).otherwise(c)
    between = lambda c, lo, hi: (c >= lo) & (c <= hi)
    total = salary + F.col("commission")
    equity = F.when(F.col("hyears") >= 20, F.col("hvalue") * (F.col("hyears") - 20) / 10).otherwise(0.0)
    rules = [
        young | old,
        by_age(between(salary, 50000, 100000), between(salary, 75000, 125000), between(salary, 25000, 75000)),
        by_age(level <= 1, between(level, 1, 3), level >= 2),
        by_age(F.when(level <= 1, between(salary, 25000, 75000)).otherwise(between(salary, 50000, 100000)), F.when(between(level, 1, 3), between(salary, 50000, 100000)).otherwise(between(salary, 75000, 125000)), F.when(level >= 2, between(salary, 50000, 100000)).otherwise(between(salary, 25000, 75000))),
        by_age(F.when(between(salary, 50000, 100000), between(loan, 100000, 300000)).otherwise(between(loan, 200000, 400000)), F.when(between(salary, 75000, 125000), between(loan, 200000, 400000)).otherwise(between(loan, 300000, 500000)), F.when(between(salary, 25000, 75000), between(loan, 300000, 500000)).otherwise(between(loan, 100000, 300000))),
        by_age(between(total, 50000, 100000), between(total, 75000, 125000), between(total, 25000, 75000)),
        2 * total / 3 - loan / 5 - 20000 > 0,
        2 * total / 3 - 5000 * level - 20000 > 0,
        2 * total / 3 - 5000 * level - loan / 5 - 10000 > 0,
        2 * total / 3 - 5000 * level + equity / 5 - 10000 > 0,
    ]
    names = ["salary", "commission", "age", "elevel", "car", "zipcode", "hvalue", "hyears", "loan"]
    y = 1 - F.coalesce(rules[function % 10], F.lit(False)).cast("int")
    return rows.select("example", F.array(*names).alias("x"), y.alias("y"))


#: What may set a sampled feature apart from uniform noise.
TRAITS = ("distribution", "autocorrelation", "frequency")


def sinh_arcsinh_density(x: Column, skew: float, tail: float) -> Column:
    """Density of the sinh-arcsinh normal distribution; the standard normal for skew 0 and tail 1."""
    at = F.asinh(x) * tail - skew
    bell = F.exp(-(F.sinh(at) ** 2) / 2) / math.sqrt(2 * math.pi)
    return bell * tail * F.cosh(at) / F.sqrt(1 + x * x)


def sampler_traits(seed: int, name: str) -> dict[str, float | list]:
    """The parameters of a sampled feature, drawn from its seed and name; they can be written as JSON."""
    rng = random.Random(f"{seed}:{name}")
    return {
        "mean": rng.random(), "stdev": max(rng.random(), 1e-3), "skew": rng.uniform(-1, 1), "tail": rng.uniform(0.75, 1.75),
        "echo": [rng.uniform(0, 0.4) for _ in range(3)], "waves": [(rng.random(), rng.uniform(0, 2)) for _ in range(3)],
    }


def sampler(seed: int, name: str, strength: float = 1.0, traits: tuple[str, ...] = TRAITS) -> Column:
    """A feature in (0, 1): the logistic of its traits' sum, blended with uniform noise by `strength`.

    distribution: sinh-arcsinh normal draws, without it draws are uniform and count only through their echo;
    autocorrelation: an echo of the three draws before; frequency: a tenth of three waves.
    """
    t = sampler_traits(seed, name)

    def draw(back: int) -> Column:
        row = F.col("example") - back
        if "distribution" not in traits:
            return uniform(seed, name + "d", row)
        x = F.sinh((F.asinh(normal(seed, name, row)) + t["skew"]) / t["tail"])
        return (t["mean"] / t["stdev"] + x) * t["stdev"]

    total = F.lit(0.0)
    if "distribution" in traits:
        total = total + draw(0)
    if "autocorrelation" in traits:
        for back, share in enumerate(t["echo"], 1):
            total = total + draw(back) * share
    if "frequency" in traits:
        for pace, height in t["waves"]:
            total = total + 0.1 * height * F.sin((F.col("example") + 1) * (pace / (2 * math.pi)))
    return strength / (1 + F.exp(-total)) + uniform(seed, name + "u") * (1 - strength)


def hyperplane(spark: SparkSession, n: int, seed: int, features: int = 8, strength: float = 0.0, noise: float = 0.05, drift: float = 0.0, traits: tuple[str, ...] = TRAITS) -> DataFrame:
    """Label 1 where the weighted sum reaches half the weights; labels flip with chance `noise`.

    drift: how much each weight moves per row, in a fixed direction of its own.
    """
    rng = random.Random(seed)
    w = [rng.random() for _ in range(features)]
    way = [rng.choice((-1, 1)) for _ in range(features)]
    cols = [sampler(seed, f"h{i}", strength, traits) if strength else uniform(seed, f"h{i}") for i in range(features)]
    rows = _rows(spark, n).select("example", F.array(*cols).alias("x"))
    weights = F.array(*[F.lit(a) + F.col("example") * float(drift * d) for a, d in zip(w, way, strict=True)])
    dot = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    half = F.aggregate(weights, F.lit(0.0), lambda s, v: s + v) / 2
    y = (dot >= half).cast("int")
    return rows.select("example", "x", F.when(uniform(seed, "flip") < noise, 1 - y).otherwise(y).alias("y"))


def random_rule(rng: random.Random, features: int, depth: int, classes: int, least: int | None = None) -> tuple:
    """A random decision tree over [0, 1) features: ('leaf', class) or (feature, threshold, left, right).

    From level `least` on (the depth by default) a node is a leaf by a chance of 0.15.
    """
    least = depth if least is None else least

    def grow(level: int, lo: list[float], hi: list[float]) -> tuple:
        if level == depth or level >= max(least, 1) and rng.random() < 0.15:
            return ("leaf", lo, hi)
        # The split keeps both sides between 40 and 60 percent of the box: at most 0.2 of its mass apart.
        j = rng.randrange(features)
        t = lo[j] + (hi[j] - lo[j]) * rng.uniform(0.4, 0.6)
        return (j, t, grow(level + 1, lo, [*hi[:j], t, *hi[j + 1 :]]), grow(level + 1, [*lo[:j], t, *lo[j + 1 :]], hi))

    tree = grow(0, [0.0] * features, [1.0] * features)
    leaves: list[tuple[float, int]] = []

    def collect(node) -> None:
        if node[0] == "leaf":
            leaves.append((math.prod(b - a for a, b in zip(node[1], node[2], strict=True)), len(leaves)))
        else:
            collect(node[2])
            collect(node[3])

    collect(tree)
    # Greedy balance: the heaviest leaf goes to the lightest class.
    load, owner = [0.0] * classes, {}
    for mass, i in sorted(leaves, key=lambda x: (-x[0], x[1])):
        c = load.index(min(load))
        owner[i] = c
        load[c] += mass
    count = iter(range(len(leaves)))

    def label(node):
        return ("leaf", owner[next(count)]) if node[0] == "leaf" else (node[0], node[1], label(node[2]), label(node[3]))

    return label(tree)


def rule_column(tree: tuple, x: str = "x") -> Column:
    """A decision tree as one CASE expression: below the threshold left, else right."""
    if tree[0] == "leaf":
        return F.lit(tree[1])
    j, t, left, right = tree
    return F.when(F.col(x)[j] < t, rule_column(left, x)).otherwise(rule_column(right, x))


def random_tree(spark: SparkSession, n: int, seed: int, features: int = 10, depth: int = 4, classes: int = 2, strength: float = 0.4, nominal: int = 0, values: int = 5, least: int | None = None, traits: tuple[str, ...] = TRAITS) -> DataFrame:
    """Sampled features, and `nominal` one-hot categories, labelled by a random tree over the numeric ones."""
    tree = random_rule(random.Random(seed), features, depth, classes, least)
    cols = [sampler(seed, f"t{i}", strength, traits) if strength else uniform(seed, f"t{i}") for i in range(features)]
    for c in range(nominal):
        pick = F.floor(uniform(seed, f"c{c}") * values)
        cols += [(pick == v).cast("double") for v in range(values)]
    rows = _rows(spark, n).select("example", F.array(*cols).alias("x"))
    return rows.select("example", "x", rule_column(tree).cast("int").alias("y"))


def rbf(spark: SparkSession, n: int, seed: int, features: int = 10, centroids: int = 50, classes: int = 2) -> DataFrame:
    """Points around random centroids, each with its weight, spread and class."""
    rng = random.Random(seed)
    cs = [([rng.random() for _ in range(features)], rng.randrange(classes), rng.random(), rng.random()) for _ in range(centroids)]
    total, at, edges = sum(c[3] for c in cs), 0.0, []
    for c in cs:
        at += c[3] / total
        edges.append(at)
    u = uniform(seed, "centroid")
    pick = F.lit(centroids - 1)
    for i in range(centroids - 2, -1, -1):
        pick = F.when(u < edges[i], i).otherwise(pick)
    rows = _rows(spark, n).select("example", pick.alias("c"), F.array(*[normal(seed, f"d{i}") for i in range(features)]).alias("d"), normal(seed, "len").alias("len"))
    centre = F.element_at(F.array(*[F.array(*[F.lit(v) for v in c[0]]) for c in cs]), F.col("c") + 1)
    label = F.element_at(F.array(*[F.lit(c[1]) for c in cs]), F.col("c") + 1)
    spread = F.element_at(F.array(*[F.lit(c[2]) for c in cs]), F.col("c") + 1)
    norm = F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, v: s + v * v))
    x = F.zip_with(centre, F.transform("d", lambda v: v / norm * F.col("len") * spread), lambda a, b: a + b)
    return rows.select("example", x.alias("x"), label.cast("int").alias("y"))


def wind(spark: SparkSession, n: int, concept: int, seed: int, sensors: int = 16, emitters: int = 3, lag: int = 10) -> DataFrame:
    """Pollution at sensors on a circle from emitters that pulse every 1 + 4 * concept ticks; the label is the level at the
    centre, `lag` ticks after the sensors' readings, in steps of 50 up to 20.

    A closed form of advected, diluted puffs: what arrives is a sum over puffs of the emission, thinned by age.
    """
    rng = random.Random(seed * 31 + concept)
    angle, speed = rng.uniform(0, 2 * math.pi), rng.uniform(2, 6)
    vx, vy = speed * math.cos(angle), speed * math.sin(angle)
    sources = [(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(200, 900)) for _ in range(emitters)]
    period = 1 + 4 * concept
    places = [(0.0, 0.0)] + [(20 * math.cos(2 * math.pi * k / sensors), 20 * math.sin(2 * math.pi * k / sensors)) for k in range(sensors)]

    def level(px: float, py: float, t: Column) -> Column:
        total = F.lit(0.0)
        for k, (sx, sy, power) in enumerate(sources):
            # Puffs that have been on their way for `age` ticks are nearest to the place at `best`.
            best = ((px - sx) * vx + (py - sy) * vy) / (speed * speed)
            for shift in (-1, 0, 1):
                age = max(0.0, best) + shift
                if age < 0:
                    continue
                d2 = (sx + vx * age - px) ** 2 + (sy + vy * age - py) ** 2
                width = 4 + age
                share = power * math.exp(-d2 / (2 * width * width)) / (1 + age / 10)
                emitted = F.pmod(t - int(age) + k, F.lit(period)) == 0
                jitter = 0.5 + uniform(seed, f"w{k}{shift}")
                total = total + F.when(emitted, share * jitter).otherwise(0.0)
        return total

    rows = _rows(spark, n)
    x = F.array(*[level(px, py, F.col("example")) for px, py in places[1:]])
    y = F.least(F.floor(level(0.0, 0.0, F.col("example") + lag) / 50), F.lit(20)).cast("int")
    return rows.select("example", x.alias("x"), y.alias("y"))


def _tree(depth: int, least: int, strength: float = 0.0, traits: tuple[str, ...] = TRAITS):
    return lambda s, n, c, seed, d: random_tree(s, n, seed, depth=depth, least=least, strength=strength, traits=traits)


#: Named data sets: how to make a concept's rows (session, rows, concept, seed, difficulty), and the number of concepts.
CATALOGUE = {
    "STAGGER": (lambda s, n, c, seed, d: stagger(s, n, seed, seed), 10),
    "STAGGERS": (lambda s, n, c, seed, d: stagger(s, n, c, seed), 3),
    "SEA": (lambda s, n, c, seed, d: sea(s, n, seed, seed), 10),
    "ARGWAL": (lambda s, n, c, seed, d: agrawal(s, n, seed, seed), 10),
    "WINDSIM": (lambda s, n, c, seed, d: wind(s, n, c, seed), 4),
    "HPLANE": (lambda s, n, c, seed, d: hyperplane(s, n, seed), 10),
    "HPLANESAMPLE": (lambda s, n, c, seed, d: hyperplane(s, n, seed, strength=1.0), 10),
    "RBF": (lambda s, n, c, seed, d: rbf(s, n, seed), 10),
    "RBFEasy": (lambda s, n, c, seed, d: rbf(s, n, seed, centroids=15, classes=4), 10),
    "RBFMed": (lambda s, n, c, seed, d: rbf(s, n, seed, centroids=25, classes=4), 10),
    "RTREE": (_tree(5, 3), 10),
    "RTREEEasy": (_tree(1, 0), 10),
    "RTREEEasySAMPLE": (_tree(2, 0, 0.1), 10),
    "RTREEMedSAMPLE": (_tree(2, 0, 0.2), 10),
    "RTREESAMPLE_HARD": (_tree(5, 3, 0.4), 10),
    "RTREESAMPLE_Diff": (lambda s, n, c, seed, d: random_tree(s, n, seed, depth=(d or 0) + 2, least=d or 0, strength=0.4), 10),
    "RTREESAMPLE": (_tree(5, 3, 1.0), 10),
}
# Trees over features with some traits only: D for distribution, A for autocorrelation, F for frequency.
for _letters in ("F", "A", "D", "AF", "DA", "DF", "DAF"):
    CATALOGUE[f"SynEasy{_letters}"] = (_tree(2, 0, 1.0, tuple(t for t in TRAITS if t[0].upper() in _letters)), 10)
# The pair names how draws differ inside and between concepts; both are recorded, and the draws are those of RTREESAMPLE.
for _inside in "UND":
    for _between in "UNDB":
        CATALOGUE[f"RTREESAMPLE-{_inside}{_between}"] = (_tree(5, 3, 1.0), 10)


def concepts(spark: SparkSession, name: str, seed: int, rows: int, difficulty: int = 0) -> DataFrame:
    """(concept, position, x, y) of all concepts of a named data set."""
    if name not in CATALOGUE:
        raise ValueError(f"unknown data set {name!r}; one of {sorted(CATALOGUE)}")
    make, n = CATALOGUE[name]
    out = None
    for c in range(n):
        part = make(spark, rows, c, seed + c, difficulty).select(F.lit(f"{name}_{c}").alias("concept"), F.col("example").alias("position"), "x", "y")
        out = part if out is None else out.unionByName(part)
    return out
