"""Deterministic sampling and splitting: order by md5 of seed and id, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import materialise, remove, scratch
from .metrics import global_rank


def hash_key(seed: int, key: str = "vec_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def random_sample(df: DataFrame, n: int, seed: int, key: str = "vec_id") -> DataFrame:
    """``n`` rows without replacement, all when there are fewer."""
    return df.orderBy(hash_key(seed, key), key).limit(n)


def remaining(df: DataFrame, taken: DataFrame, key: str = "vec_id") -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")


def validation_size(n: int, fraction: float, cap: int | None = None) -> int:
    size = max(1, min(n - 1, int(n * fraction + 0.5)))
    return min(size, cap) if cap else size


def split(df: DataFrame, fraction: float = 0.2, seed: int = 42, cap: int | None = None, key: str = "vec_id") -> DataFrame:
    """``df`` with ``split``: train or validation."""
    n = df.count()
    ranked = global_rank(df.withColumn("__h", hash_key(seed, key)), [F.col("__h"), F.col(key)], "__r").drop("__h")
    return ranked.withColumn("split", F.when(F.col("__r") < n - validation_size(n, fraction, cap), "train").otherwise("validation")).drop("__r")


def split_positions(df: DataFrame, train: float = 0.6, validation: float = 0.2, key: str = "vec_id") -> DataFrame:
    """``df`` with ``split`` by position: train, validation, test; sizes are rounded down."""
    n = df.count()
    a, b = int(n * train), int(n * validation)
    ranked = global_rank(df, [F.col(key)], "__r")
    return ranked.withColumn("split", F.when(F.col("__r") < a, "train").when(F.col("__r") < a + b, "validation").otherwise("test")).drop("__r")


def grid_cells(coords: DataFrame, grid: int = 50) -> DataFrame:
    """(vec_id, x, y, gx, gy) from (vec_id, x, y)."""
    box = coords.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    both = coords.join(F.broadcast(box))  # one row
    cell = lambda c: F.least(F.lit(grid - 1), F.round((F.col(c) - F.col(f"{c}0")) / F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(1e-6)) * (grid - 1)).cast("int"))
    return both.select("vec_id", "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))


def grid_pick(cells: DataFrame, seed: int) -> DataFrame:
    """One row of each occupied cell, the first by hash."""
    w = Window.partitionBy("gx", "gy").orderBy(hash_key(seed), "vec_id")
    return cells.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def grid_sample(coords: DataFrame, n: int, seed: int, grid: int = 50) -> DataFrame:
    """``n`` ids: cells in hash order give one row each; if cells run out, the rest by hash."""
    picked = random_sample(grid_pick(grid_cells(coords, grid), seed).select("vec_id"), n, seed)
    short = n - picked.count()
    if short <= 0:
        return picked
    return picked.unionByName(random_sample(remaining(coords.select("vec_id"), picked), short, seed))


def pca_coordinates(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x, y): the two leading principal directions; only the D x D moments reach the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = df.select("vec_id", array_to_vector(V.as_double(F.col(column))).alias("f"))
    model = PCA(k=2, inputCol="f", outputCol="p").fit(vec)
    out = model.transform(vec).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def weighted_pick(df: DataFrame, weight: str, draw: float, key: str = "vec_id") -> DataFrame:
    """The row where the running sum of ``weight`` in order of ``key`` reaches ``draw`` times the total."""
    parts = global_rank(df, [F.col(key)], "__r").withColumn("__p", F.expr("__r div 100000"))
    sums = parts.groupBy("__p").agg(F.sum(weight).alias("s"))
    sums = sums.select("__p", (F.sum("s").over(Window.orderBy("__p")) - F.col("s")).alias("base"), F.sum("s").over(Window.partitionBy()).alias("total"))
    run = F.col("base") + F.sum(weight).over(Window.partitionBy("__p").orderBy(key))
    return parts.join(F.broadcast(sums), "__p").withColumn("__run", run).where(F.col("__run") >= draw * F.col("total")).orderBy(key).limit(1).drop("__r", "__p", "base", "total", "__run")


def race(seed: int, step: int, weight: Column, key: str = "vec_id") -> Column:
    """Exponential race: the row with the smallest value is drawn with a probability in proportion to ``weight``; infinite where that is 0."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), F.col(key)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def kmeanspp_sample(df: DataFrame, n: int, seed: int, column: str = "embedding") -> DataFrame:
    """``n`` ids far apart: each next one is drawn by squared distance from those before. One scan with one minimum a pick, without a sort."""
    rows, path = df.select("vec_id", V.as_double(F.col(column)).alias("v")), None
    total = rows.count()
    if n >= total:
        return rows.select("vec_id").orderBy("vec_id")
    first = random_sample(rows, 1, seed).first()
    picked, gap = [first], None
    for step in range(1, n):
        last = F.lit([float(x) for x in picked[-1]["v"]])
        d = V.squared_distance(F.col("v"), last)
        if step % 32 == 0:  # keep the expression short
            old, path = path, scratch(df.sparkSession, "gaps")
            rows, gap = materialise(rows.withColumn("g", gap), "gaps", path), F.col("g")
            if old:
                remove(df.sparkSession, old)
        gap = d if gap is None else F.least(gap, d)
        drawn = rows.where(~F.col("vec_id").isin([p["vec_id"] for p in picked])).select(F.struct("vec_id", "v").alias("row"), F.struct(race(seed, step, gap), "vec_id").alias("at"))
        picked.append(drawn.agg(F.min_by("row", "at").alias("row")).first()["row"])
    if path:
        remove(df.sparkSession, path)
    return df.sparkSession.createDataFrame(sorted((p["vec_id"],) for p in picked), "vec_id long")


STRATEGIES = {"random": "random", "kmeans": "kmeans", "kmeans++": "kmeans", "k-means": "kmeans", "tsne": "grid", "tsne-grid": "grid", "tsne_grid": "grid", "grid": "grid"}


def sampler(name: str):
    """(df, n, seed) -> ids, by strategy name."""
    kind = STRATEGIES.get(name.lower())
    if kind is None:
        raise ValueError(f"no sampling strategy {name}")
    return {"random": lambda df, n, seed: random_sample(df.select("vec_id"), n, seed), "kmeans": kmeanspp_sample, "grid": lambda df, n, seed: grid_sample(pca_coordinates(df), n, seed)}[kind]


def sizes(kind: str, available: int, values=(), start: int = 0, top: int = 0, n: int = 0, percent: float = 0.0) -> list[int]:
    """Sample sizes of a schedule: fixed, doubling, single or percent."""
    if kind == "fixed":
        return [s for s in values if s <= available]
    if kind == "doubling":
        out, now = [], start
        while 0 < now <= min(available, top):
            out.append(now)
            now *= 2
        return out
    if kind == "single":
        return [min(n, available)]
    if kind == "percent":
        return [min(max(int(available * percent / 100 + 0.5), 1), available)]
    raise ValueError(f"no schedule {kind}")
