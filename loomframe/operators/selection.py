"""Online data selection: histories, similarity interpolation, cluster allocation, bandit weights, budgets."""

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as A
from .batch import running_total


@dataclass
class SelectionConfig:
    strategy: str = "random"
    budget: float = 0.1  # a count from 1 on, a share below
    every_epochs: int = 1
    every_steps: int = 0
    seed: int = 0
    options: dict = field(default_factory=dict)

    def rows(self, size: int) -> int:
        return min(int(self.budget), size) if self.budget >= 1 else max(1, int(self.budget * size))

    def due(self, epoch: int | None = None, step: int | None = None) -> bool:
        """Whether an epoch or a step triggers a round; intervals up to 0 never do."""
        for at, every in ((epoch, self.every_epochs), (step, self.every_steps)):
            if at is not None and every > 0 and at % every == 0:
                return True
        return False


def key_order(seed: int, *cols: str) -> list[Column]:
    """A keyed shuffle that does not depend on partitions."""
    return [F.xxhash64(F.lit(seed), *cols), *[F.col(c) for c in cols]]


#: The greatest number of rows that one task may gather for an ordered limit.
FEW = 10_000


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows by an order that tells all rows apart.

    A few come from a bounded limit; a number that grows with the data from positions of a range-partitioned sort, so that no task gathers it.
    """
    if n <= FEW:
        return df.orderBy(*order).limit(max(n, 0))
    from .batch import number_rows

    return number_rows(df, list(order), name="_place").where(F.col("_place") < n).drop("_place")


def random_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    return first_rows(df, n, *key_order(seed, key))


def weighted_rows(df: DataFrame, n: int, key: str, weight: str, seed: int = 0) -> DataFrame:
    """Without replacement, by exponential keys -ln(u) / w; rows of weight 0 are never taken."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    return df.where(F.col(weight) > 0).withColumn("_k", -F.log(u) / F.col(weight)).transform(lambda d: first_rows(d, n, "_k", key)).drop("_k")


# ---- histories of (idx, step, reward)


def decayed(history: DataFrame, now: int, rate: float, most_age: int, value: str = "value") -> DataFrame:
    """idx, weighted: exponentially decayed mean of the last most_age steps, summed map-side first."""
    age = F.lit(now) - F.col("step")
    w = F.exp(-rate * age)
    return history.where(age <= most_age).groupBy("idx").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("weighted"), F.max("step").alias("last_step"))


def group_variance(rewards: DataFrame, normalise: bool = True) -> DataFrame:
    """idx, step, mean and population variance (four times it, at most 1, if normalised)."""
    v = F.var_pop("reward")
    return rewards.groupBy("idx", "step").agg(F.avg("reward").alias("mean"), (F.least(4 * v, F.lit(1.0)) if normalise else v).alias("value"))


def pruned(history: DataFrame, now: int, most_age: int) -> DataFrame:
    return history.where(F.lit(now) - F.col("step") <= most_age)


def most_recent(table: DataFrame, n: int, by: str = "last_step", key: str = "idx") -> DataFrame:
    return table.orderBy(F.desc(by), key).limit(n)


def observed_or(items: DataFrame, observed: DataFrame, value: str, default: float = 0.5) -> DataFrame:
    return items.join(observed, "idx", "left").withColumn(value, F.coalesce(value, F.lit(default)))


# ---- similarity


def unit(v) -> Column:
    v = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(A.total(F.transform(v, lambda x: x * x)))
    return F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12)))


def dot(a, b) -> Column:
    return A.total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


#: Rows of items that a task of nearest references holds, and tasks that the pairs are dealt to at most for that.
HELD, CELLS = 1 << 16, 48


def nearest_references(items: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """idx, ref, sim, value, rank: the k most similar references by cosine; ties by id.  items(idx, vec) against refs(ref, vec, value).

    Of equal vectors only the first k references can be chosen, and equal items share what they choose, so each vector is compared once.
    All pairs of distinct vectors are met, in a grid of slices of items and of references: a task holds its slice of items, streams its
    references through it and keeps k for each item, and the k of the slices of references are merged by item.
    """
    import numpy as np
    import pyarrow as pa

    first = F.row_number().over(Window.partitionBy("vec").orderBy("ref"))
    some = refs.select("ref", "vec", F.col("value").cast("double").alias("value")).withColumn("_k", first).where(F.col("_k") <= k)
    one = items.groupBy("vec").agg(F.min("idx").alias("_one"))
    n = one.count()
    slices = max(1, -(-n // HELD))
    parts = max(1, min(CELLS // slices, -(-n // 1024)))
    kinds = dict(items.dtypes)["idx"], dict(refs.dtypes)["ref"]

    def dealt(df: DataFrame, key: str, own: int, others: int, role: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit("cell"), key), F.lit(own)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.withColumn("_mine", mine).withColumn("_other", other).select(
            *[(F.col("_mine" if role == r else "_other")).alias(c) for r, c in ((0, "_i"), (1, "_r"))], F.lit(role).alias("_role"),
            *[F.col(key) if c == key else F.lit(None).cast(t).alias(c) for c, t in (("_one", kinds[0]), ("ref", kinds[1]))], "vec", F.col("value") if role else F.lit(None).cast("double").alias("value"))

    rows = dealt(one, "_one", slices, parts, 0).unionByName(dealt(some, "ref", parts, slices, 1))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x.cast("double"))).repartition(slices * parts, "_i", "_r").sortWithinPartitions("_i", "_r", "_role")

    def units(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(batches):
        held = ids = best = None

        def chosen():
            if best is not None and len(ids):
                r, j = np.nonzero(best.some)
                at = [pa.array(x) for x in (ids[r], best.ref[r, j], best.sim[r, j], best.value[r, j])]
                yield pa.RecordBatch.from_arrays(at, names=["_one", "ref", "sim", "value"])

        cell = None
        for batch in batches:
            i, r, role = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (role[1:] != role[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(i)]) if len(i) else []:
                if cell != (i[s], r[s]):
                    yield from chosen()
                    cell, held, ids, best = (i[s], r[s]), [], [], None
                part = batch.slice(s, e - s)
                x = units(part.column(5))
                if role[s] == 0:
                    held.append(x)
                    ids.append(part.column(3).to_numpy(zero_copy_only=False))
                    continue
                if not len(held):
                    continue
                if best is None:
                    held, ids = np.vstack(held), np.concatenate(ids)
                    best = _Nearest(held, k)
                best.meet(x, part.column(4).to_numpy(zero_copy_only=False), part.column(6).to_numpy(zero_copy_only=False))
        yield from chosen()

    d = rows.mapInArrow(run, f"_one {kinds[0]}, ref {kinds[1]}, sim double, value double")
    rank = F.row_number().over(Window.partitionBy("_one").orderBy(F.desc("sim"), "ref"))
    d = d.withColumn("rank", rank).where(F.col("rank") <= k)
    same = items.select("idx", "vec").join(one, "vec").select("idx", "_one")
    return same.join(d, "_one").select("idx", "ref", "sim", "value", "rank")


class _Nearest:
    """The k nearest of all references met so far, for each of a slice of items; ties by id.

    Products of single precision rule out what cannot be among them, with a margin for their error; the rest is compared in double precision.
    """

    def __init__(self, x, k: int):
        import numpy as np

        n = len(x)
        self.x, self.small, self.k = x, x.astype(np.float32), k
        self.margin = np.float32(1e-6 * (x.shape[1] + 8))
        self.sim, self.ref, self.value, self.some = np.full((n, k), -np.inf), None, np.full((n, k), np.nan), np.zeros((n, k), bool)

    def meet(self, m, refs, values):
        import numpy as np

        if self.ref is None:
            self.ref = np.zeros(self.sim.shape, refs.dtype)
        for b in range(0, len(m), 2048):
            y = m[b : b + 2048]
            small = np.ascontiguousarray(y.astype(np.float32).T)
            for a in range(0, len(self.x), 2048):
                got = self.small[a : a + 2048] @ small
                low = self.sim[a : a + 2048, -1].astype(np.float32) - self.margin
                # items that lack k yet begin from the k greatest of this block
                new = ~self.some[a : a + 2048, -1]
                if new.any() and got.shape[1] > self.k:
                    part = np.partition(np.nan_to_num(got[new], nan=-np.inf), got.shape[1] - self.k, axis=1)
                    low[new] = part[:, got.shape[1] - self.k] - 2 * self.margin
                rows, cols = np.nonzero(~(got < low[:, None]))
                # whole items at a time, about 2^18 pairs
                ends = np.flatnonzero(np.diff(rows, append=-1)) + 1
                s = 0
                while s < len(rows):
                    e = int(ends[min(np.searchsorted(ends, s + (1 << 18)), len(ends) - 1)])
                    self._merge(rows[s:e] + a, y, cols[s:e], refs[b : b + 2048], values[b : b + 2048])
                    s = e

    def _merge(self, rows, y, cols, refs, values):
        import numpy as np

        sim = np.einsum("ij,ij->i", self.x[rows], y[cols])
        mine = np.unique(rows)
        old_r, old_j = np.nonzero(self.some[mine])
        old_r = mine[old_r]
        r = np.concatenate([old_r, rows])
        sim = np.concatenate([self.sim[old_r, old_j], sim])
        ref = np.concatenate([self.ref[old_r, old_j], refs[cols]])
        value = np.concatenate([self.value[old_r, old_j], values[cols]])
        by = ref if ref.dtype != object else np.unique(ref, return_inverse=True)[1]
        order = np.lexsort((by, np.where(np.isnan(sim), np.inf, -sim), r))
        r = r[order]
        start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        place = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
        keep = place < self.k
        r, j, order = r[keep], place[keep], order[keep]
        self.sim[r, j], self.ref[r, j], self.value[r, j], self.some[r, j] = np.where(np.isnan(sim[order]), -np.inf, sim[order]), ref[order], value[order], True


def interpolated(neighbours: DataFrame, temperature: float = 0.05) -> DataFrame:
    """idx, predicted: softmax(sim / temperature) weighted mean of the neighbours' values."""
    top = F.max("sim").over(Window.partitionBy("idx"))
    w = F.exp((F.col("sim") - F.col("_t")) / temperature)
    return neighbours.withColumn("_t", top).groupBy("idx").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("predicted"))


def knn_density(items: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """idx, cluster, density: 1 / (mean cosine distance to the k nearest of the cluster + 1e-8); exact.

    A cluster is cut into blocks by hash.  Every block meets all rows of the cluster in a task of its own, which holds the block and
    streams the rows through it; the k nearest of each block are merged by row.
    """
    import numpy as np
    import pyarrow as pa

    sizes = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    d = items.select("idx", "cluster", "vec").join(sizes, "cluster")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    here = d.select("idx", "vec", F.xxhash64("cluster", F.pmod(F.xxhash64("idx"), blocks).cast("int")).alias("_g"), F.lit(0).alias("_role"), "cluster")
    asks = d.select("idx", "vec", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.xxhash64("cluster", i))).alias("_g"), F.lit(1).alias("_role"), "cluster")
    rows = here.unionByName(asks).select("_g", "_role", "idx", "cluster", F.transform("vec", lambda x: x.cast("double")).alias("vec")).repartition("_g").sortWithinPartitions("_g", "_role")

    def units(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(batches):
        g, base, ids = None, None, None
        for batch in batches:
            at, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (role[1:] != role[:-1])) + 1, [len(at)]]) if len(at) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(s, e - s)
                if at[s] != g:
                    g, base, ids = at[s], None, None
                x, mine = units(part.column(4)), part.column(2).to_numpy()
                if role[s] == 0:
                    base, ids = (x, mine) if base is None else (np.vstack([base, x]), np.concatenate([ids, mine]))
                    continue
                for i in range(0, len(x) if base is not None else 0, 1024):
                    sim = x[i : i + 1024] @ base.T
                    sim[mine[i : i + 1024, None] == ids] = -np.inf
                    top = -np.sort(-sim, axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([part.column(2).slice(i, len(top)), part.column(3).slice(i, len(top)), pa.array([t[t > -np.inf].tolist() for t in top], pa.list_(pa.float64()))], names=["idx", "cluster", "sims"])

    kinds = dict(items.dtypes)
    near = rows.mapInArrow(run, f"idx {kinds['idx']}, cluster {kinds['cluster']}, sims array<double>")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("sims")), asc=False), 1, k)
    near = near.groupBy("idx", "cluster").agg(best.alias("sims")).where(F.size("sims") > 0)
    return near.select("idx", "cluster", (1.0 / (A.total(F.transform("sims", lambda x: 1 - x)) / F.size("sims") + 1e-8)).alias("density"))


def medoids(items: DataFrame, n: int) -> DataFrame:
    """The n rows of each cluster with the greatest mean similarity to the rest of it; ties by id.

    The mean is a dot product with the sum of the cluster's unit vectors, so no pairs are made.
    """
    u = items.select("idx", "cluster", unit("vec").alias("u"))
    long = u.select("cluster", F.posexplode("u").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
    sums = long.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda z: z["x"]).alias("s"))
    sums = sums.join(u.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")), "cluster").where("_n > 1")
    m = u.join(sums, "cluster").select("cluster", "idx", ((dot("u", "s") - dot("u", "u")) / (F.col("_n") - 1)).alias("mean_sim"))
    # the n best of every slice before the best of all, so that a large cluster is not one task
    slice_ = Window.partitionBy("cluster", F.pmod(F.xxhash64("idx"), F.lit(256))).orderBy(F.desc("mean_sim"), "idx")
    m = m.withColumn("rank", F.row_number().over(slice_)).where(F.col("rank") <= n)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("mean_sim"), "idx"))
    return m.withColumn("rank", rank).where(F.col("rank") <= n)


def centroids(items: DataFrame) -> DataFrame:
    """cluster, centroid, size: per-dimension means, by exploded positions with map-side combine."""
    long = items.select("cluster", F.posexplode("vec").alias("d", "x")).groupBy("cluster", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    c = long.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("centroid"))
    return c.join(size, "cluster")


def nearest_to_centroid(items: DataFrame, cents: DataFrame, n: int) -> DataFrame:
    """The n rows of each cluster nearest to its centroid."""
    d = items.join(cents.select("cluster", "centroid"), "cluster")
    d = d.withColumn("distance", F.sqrt(A.total(F.zip_with("vec", "centroid", lambda x, c: (x.cast("double") - c) * (x.cast("double") - c)))))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "idx"))
    return d.withColumn("rank", rank).where(F.col("rank") <= n).select("cluster", "idx", "distance", "rank")


def transferability(cents: DataFrame, most: float = 0.9) -> DataFrame:
    """cluster, transfer: mean centroid cosine, pairs above `most` left out (count of kept pairs below); one row a cluster."""
    u = cents.select("cluster", unit("centroid").alias("u"))
    o = u.select(F.col("cluster").alias("other"), F.col("u").alias("w"))
    s = u.join(o, F.col("cluster") != F.col("other")).select("cluster", dot("u", "w").alias("sim"))
    return s.groupBy("cluster").agg(F.coalesce(F.sum(F.when(F.col("sim") <= most, F.col("sim"))) / F.nullif(F.count_if(F.col("sim") <= most), F.lit(0)), F.lit(0.0)).alias("transfer"))


def kmeans_clusters(items: DataFrame, k: int, seed: int = 0, rounds: int = 20) -> DataFrame:
    """idx, cluster by spherical k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = items.select("idx", array_to_vector(F.transform(unit("vec"), lambda x: x)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(d)
    return model.transform(d).select("idx", F.col("prediction").alias("cluster"))


def _greedy_cover(vectors, score, n: int, radius: float, subset: str):
    """Row positions by falling score, each choice suppressing its neighbours within the cosine radius; then the best of the rest."""
    import numpy as np

    order = np.lexsort((np.arange(len(score)), -score))
    open_, chosen = np.ones(len(score), bool), []
    for i in order:
        if len(chosen) == n:
            break
        if open_[i]:
            chosen.append(int(i))
            open_ &= (vectors @ vectors[i]) < 1 - radius
    for i in order:
        if len(chosen) >= n:
            break
        if int(i) not in chosen:
            chosen.append(int(i))
    return chosen


def diverse_rows(items: DataFrame, n: int, radius: float = 0.15, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """cluster, idx, rank: greedy picks by minmax(density)^alpha * clip(cosine to centroid)^beta with suppression.

    items(idx, vec, cluster, density); a cluster is one task, its size is bounded by clustering.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("idx").reset_index(drop=True)
        v = np.array(pdf["vec"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        c = v.mean(0)
        c /= max(np.linalg.norm(c), 1e-12)
        d = pdf["density"].to_numpy(float)
        span = d.max() - d.min()
        scaled = (d - d.min()) / span if span > 0 else np.ones_like(d)
        chosen = _greedy_cover(v, scaled**alpha * np.clip(v @ c, 0, 1) ** beta, n, radius, "")
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "idx": pdf["idx"].to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    t = dict(items.dtypes)
    return items.select("idx", "vec", "cluster", "density").groupBy("cluster").applyInPandas(run, f"cluster {t['cluster']}, idx {t['idx']}, rank int")


def mmd_rows(items: DataFrame, n: int, gamma: float = 1.0, rows: int = 2_000) -> DataFrame:
    """cluster, idx, rank: greedy subset that follows the cluster's distribution under an RBF kernel.

    The kernel matrix is made of at most about `rows` rows of a cluster, drawn by hash, as the operator is defined.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("idx").reset_index(drop=True)
        v = np.array(pdf["vec"].tolist(), float)
        sq = (v * v).sum(1)
        k = np.exp(-gamma * np.maximum(sq[:, None] + sq - 2 * v @ v.T, 0))
        mean, picked, total = k.mean(1), [], np.zeros(len(v))
        for i in range(min(n, len(v))):
            gain = mean - (total + k.diagonal() / 2) / (i + 1)
            gain[picked] = -np.inf
            j = int(np.argmax(gain))
            picked.append(j)
            total += k[j]
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "idx": pdf["idx"].to_numpy()[picked], "rank": range(1, len(picked) + 1)})

    t = dict(items.dtypes)
    sizes = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    share = F.pmod(F.xxhash64(F.lit("mmd"), "idx"), F.lit(1 << 30)) < F.lit(float(rows << 30)) / F.col("_n")
    drawn = items.select("idx", "vec", "cluster").join(sizes, "cluster").where(share).drop("_n")
    return drawn.groupBy("cluster").applyInPandas(run, f"cluster {t['cluster']}, idx {t['idx']}, rank int")


def frozen_weights(df: DataFrame, value: str, floor: float = 0.05) -> DataFrame:
    """Adds weight: the value, at least a share of the greatest one; draw with advantages.resampled."""
    top = df.agg(F.greatest(F.max(value), F.lit(1e-12)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("weight", F.greatest(F.coalesce(F.col(value), F.lit(0.0)), floor * F.col("_top"))).drop("_top")


# ---- gates, scores, regressions


def sigmoid_gate(score: Column, floor: float, threshold: float, temperature: float) -> Column:
    z = A.clipped((score - threshold) / temperature, -50, 50)
    return floor + (1 - floor) / (1 + F.exp(-z))


def robust_z(df: DataFrame, value: str, eps: float = 1e-6) -> DataFrame:
    """Adds z: distance from the median over 1.4826 times the median deviation; 0 for fewer than two values, null and NaN."""
    v = F.when(F.isnan(value), None).otherwise(F.col(value).cast("double"))
    d = df.withColumn("_v", v)
    med = d.agg(F.median("_v").alias("_med"), F.count("_v").alias("_n"))
    d = d.crossJoin(F.broadcast(med))
    mad = d.agg(F.median(F.abs(F.col("_v") - F.col("_med"))).alias("_mad"))
    d = d.crossJoin(F.broadcast(mad))
    z = (F.col("_v") - F.col("_med")) / (1.4826 * F.col("_mad") + eps)
    return d.withColumn("z", F.when(F.col("_n") < 2, 0.0).otherwise(F.coalesce(z, F.lit(0.0)))).drop("_v", "_med", "_n", "_mad")


def filled_by_cluster(df: DataFrame, value: str, default: float = 0.0) -> DataFrame:
    v = F.when(F.isnan(value), None).otherwise(F.col(value))
    means = df.groupBy("cluster").agg(F.avg(v).alias("_m"))
    return df.join(means, "cluster", "left").withColumn(value, F.coalesce(v, "_m", F.lit(default))).drop("_m")


def utility(variance: Column, mean: Column, alpha: float = 0.5, low: float = 0.0, high: float = 1.0) -> Column:
    """Variance tilted towards hard items, nothing outside the live zone of means."""
    return F.when((mean < low) | (mean > high), 0.0).otherwise(variance * (1 + alpha * (0.5 - mean)))


def image_grounding(with_image: Column, without: Column) -> Column:
    return with_image / F.greatest(without, F.lit(1e-6))


def gram(df: DataFrame, vec: str, target: str, weight: str):
    """(X'WX, X'Wy, rows) with an intercept column, from partial sums of each partition."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        a = b = None
        n = 0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if not len(x):
                continue
            x = np.column_stack([x, np.ones(len(x))])
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            a = (0 if a is None else a) + x.T @ (x * w[:, None])
            b = (0 if b is None else b) + x.T @ (w * y)
            n += len(x)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.ravel().tolist()]), pa.array([b.tolist()]), pa.array([n])], names=["a", "b", "n"])

    parts = df.select(vec, F.col(target).cast("double"), F.col(weight).cast("double")).mapInArrow(run, "a array<double>, b array<double>, n long")

    def summed(batches):
        a = b = None
        n = 0
        for batch in batches:
            for x, y, k in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                a, b, n = (x, y, k) if a is None else (np.add(a, x), np.add(b, y), n + k)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([list(a)]), pa.array([list(b)]), pa.array([n])], names=["a", "b", "n"])

    # a row a partition, summed by 16 tasks before the driver sums those
    parts = parts.repartition(16).mapInArrow(summed, "a array<double>, b array<double>, n long").collect()
    a = b = n = 0
    for p in sorted(parts, key=lambda p: (p["n"], p["b"])):
        a, b, n = a + np.array(p["a"]), b + np.array(p["b"]), n + p["n"]
    d = len(b) if n else 0
    return (a.reshape(d, d), b, n) if n else (np.zeros((0, 0)), np.zeros(0), 0)


def ridge(df: DataFrame, vec: str, target: str, weight: str, alpha: float = 1.0):
    """(coefficients with the intercept last, inverse of the regularised Gram matrix)."""
    import numpy as np

    a, b, n = gram(df, vec, target, weight)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    a = a + alpha * np.eye(len(b))
    return np.linalg.solve(a, b), np.linalg.inv(a)


def ridge_predict(items: DataFrame, beta, inverse, alpha: float = 1.0) -> DataFrame:
    """idx, predicted, sigma = sqrt(alpha x'A^-1 x)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist(), float).reshape(batch.num_rows, len(beta) - 1)
            x = np.column_stack([x, np.ones(len(x))])
            s = np.sqrt(np.maximum(alpha * np.einsum("ni,ij,nj->n", x, inverse, x), 0))
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(x @ beta), pa.array(s)], names=["idx", "predicted", "sigma"])

    return items.select("idx", "vec").mapInArrow(run, f"idx {dict(items.dtypes)['idx']}, predicted double, sigma double")


def calibration(df: DataFrame, predicted: str, observed: str) -> DataFrame:
    """One row slope, intercept of least squares; slope 0 for a variance of the predictions up to 1e-12."""
    g = df.agg(F.covar_pop(predicted, observed).alias("c"), F.var_pop(predicted).alias("v"), F.avg(predicted).alias("mx"), F.avg(observed).alias("my"))
    slope = F.when(F.col("v") <= 1e-12, 0.0).otherwise(F.col("c") / F.col("v"))
    return g.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def diagnostics(df: DataFrame, predicted: str, observed: str) -> DataFrame:
    """One row: R2, MAE, Spearman (average ranks), the leave-one-out cluster mean's MAE, coverage."""
    # average ranks from counts of distinct values, so that only distinct values are ordered
    d = df
    for c in (predicted, observed):
        per = running_total(df.groupBy(c).agg(F.count(F.lit(1)).alias("_c")), [c], "_c", "_upto")
        d = d.join(per.select(c, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(f"_rank_{c}")), c)
    k = df.groupBy("cluster").agg(F.sum(observed).alias("_s"), F.count(observed).alias("_n"))
    d = d.join(k, "cluster").withColumn("_loo", (F.col("_s") - F.col(observed)) / F.nullif(F.col("_n") - 1, F.lit(0)))
    res = F.sum(F.pow(F.col(observed) - F.col(predicted), F.lit(2)))
    return d.agg(
        (1 - res / F.nullif(F.var_pop(observed) * F.count(observed), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(F.col(observed) - F.col(predicted))).alias("mae"),
        F.corr(f"_rank_{predicted}", f"_rank_{observed}").alias("spearman"),
        F.avg(F.abs(F.col(observed) - F.col("_loo"))).alias("loo_cluster_mae"),
        F.count("_loo").alias("covered"),
    )


# ---- allocation


def proportional(clusters: DataFrame, value: str, budget: int) -> DataFrame:
    """Adds take: min(max(1, round(value / sum * budget)), size), rounding half to even; one row a cluster."""
    total = clusters.agg(F.sum(value).alias("_all"))
    share = F.bround(F.col(value) / F.col("_all") * budget).cast("long")
    return clusters.crossJoin(F.broadcast(total)).withColumn("take", F.least(F.greatest(share, F.lit(1)), F.col("size"))).drop("_all")


def softmax_share(clusters: DataFrame, score: str, budget: int, temperature: float = 1.0) -> DataFrame:
    top = clusters.agg(F.max(score).alias("_top"))
    d = clusters.crossJoin(F.broadcast(top)).withColumn("_e", F.exp((F.col(score) - F.col("_top")) / temperature)).drop("_top")
    return proportional(d, "_e", budget).drop("_e")


def adjusted(clusters: DataFrame, budget: int, score: str) -> DataFrame:
    """take moved to meet the budget: excess off the lowest scores first, room on the highest, by running sums over clusters."""
    sums = clusters.agg((F.sum("take") - budget).alias("_over"))
    d = clusters.crossJoin(F.broadcast(sums))
    low = Window.orderBy(F.asc(score), "cluster").rowsBetween(Window.unboundedPreceding, -1)
    high = Window.orderBy(F.desc(score), "cluster").rowsBetween(Window.unboundedPreceding, -1)
    off = F.least(F.greatest(F.col("_over") - F.coalesce(F.sum("take").over(low), F.lit(0)), F.lit(0)), F.col("take"))
    room = F.col("size") - F.col("take")
    on = F.least(F.greatest(-F.col("_over") - F.coalesce(F.sum(room).over(high), F.lit(0)), F.lit(0)), room)
    return d.withColumn("take", F.col("take") - off + on).drop("_over")


def top_clusters(clusters: DataFrame, value: str, budget: int) -> DataFrame:
    """take: whole clusters by falling value until the budget is full, the last in part."""
    before = F.coalesce(F.sum("size").over(Window.orderBy(F.desc(value), "cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return clusters.withColumn("take", F.least(F.greatest(F.lit(budget) - before, F.lit(0)), F.col("size")))


def fill(items: DataFrame, allocation: DataFrame, order: str) -> DataFrame:
    """The first `take` rows of each cluster by falling order; ties by idx."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(order), "idx"))
    return items.join(allocation.select("cluster", "take"), "cluster").withColumn("rank", rank).where("rank <= take")


def top_unseen(items: DataFrame, seen: DataFrame, score: str, n: int) -> DataFrame:
    return items.join(seen.select("idx"), "idx", "left_anti").orderBy(F.desc(score), "idx").limit(n)


def top_with_budget(items: DataFrame, seen: DataFrame, weight: str, target: int, new_left: int) -> DataFrame:
    """The stable top by weight with at most new_left unseen rows; seen rows fill the rest."""
    s = seen.select("idx", F.lit(1).alias("_seen"))
    d = items.join(s, "idx", "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")
    top = d.where("is_new").orderBy(F.desc(weight), "idx").limit(new_left).unionByName(d.where("not is_new").orderBy(F.desc(weight), "idx").limit(target))
    return top.orderBy(F.desc(weight), "idx").limit(target)


# ---- Beta bandit


def correct_counts(rewards: DataFrame, groups: int, threshold: float = 0.5, key: str = "idx", reward: str = "reward") -> DataFrame:
    """idx, correct: rewards of a row above the threshold, at most the size of its group."""
    return rewards.groupBy(F.col(key).alias("idx")).agg(F.least(F.count_if(F.col(reward) > threshold), F.lit(groups)).cast("int").alias("correct"))


def updated_posteriors(state: DataFrame, counts: DataFrame, groups: int, lam1: float, lam2: float) -> DataFrame:
    """state(idx, a, b) after counts(idx, correct): decayed by lam1 where the group is mixed, by lam2 elsewhere and for rows not drawn."""
    d = state.join(counts, "idx", "left")
    mixed = (F.col("correct") > 0) & (F.col("correct") < groups)
    lam = F.when(mixed, lam1).otherwise(lam2)
    return d.select("idx", (lam * F.col("a") + F.coalesce("correct", F.lit(0))).alias("a"), (lam * F.col("b") + F.coalesce(F.lit(groups) - F.col("correct"), F.lit(0))).alias("b"))


def replaced_posteriors(state: DataFrame, counts: DataFrame, groups: int) -> DataFrame:
    d = state.join(counts, "idx", "left")
    hit = F.col("correct").isNotNull()
    return d.select("idx", F.when(hit, F.col("correct").cast("double")).otherwise(F.col("a")).alias("a"), F.when(hit, (F.lit(groups) - F.col("correct")).cast("double")).otherwise(F.col("b")).alias("b"))


def recency_posteriors(state: DataFrame, now: int, groups: int, tau: float, k: float) -> DataFrame:
    """a, b from the last value and step: k / (1 + age / tau) times it."""
    c = k / (1 + (F.lit(now) - F.col("last_step")) / tau)
    return state.select("idx", (c * F.col("last_value")).alias("a"), (c * (groups - F.col("last_value"))).alias("b"))


def learnability(p: Column, form: int = 1) -> Column:
    if form == 1:
        return p * (1 - p)
    if form == 2:
        return p * (1 - p) * (1 - p)
    raise ValueError("form is 1 or 2")


def direct_weights(state: DataFrame, form: int = 1) -> DataFrame:
    a, b = F.col("a") + 1, F.col("b") + 1
    return state.withColumn("weight", learnability(a / (a + b), form))


def _beta_cdf(a, b, x):
    """Regularised incomplete beta function of arrays, by its continued fraction, all entries in step."""
    import numpy as np
    from math import lgamma

    a, b, x = (np.asarray(v, float) for v in (a, b, x))
    gamma = np.vectorize(lgamma, otypes=[float])
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 1e-300, 1 - 1e-16)
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(y), 1 / tiny(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / tiny(1 + num * d), tiny(1 + num / c)
            h *= d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    out = np.where(flip, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _upper_quantile(a, b, level: float):
    """The `level` quantile of p (1 - p) for p ~ Beta(a, b), by bisection on its distribution, for arrays."""
    import numpy as np

    lo, hi = np.zeros(np.shape(a)), np.full(np.shape(a), 0.25)
    for _ in range(60):
        y = (lo + hi) / 2
        r = np.sqrt(1 - 4 * y)
        below = 1 - (_beta_cdf(a, b, (1 + r) / 2) - _beta_cdf(a, b, (1 - r) / 2)) < level
        lo, hi = np.where(below, y, lo), np.where(below, hi, y)
    return (lo + hi) / 2


def quantile_weights(state: DataFrame, level: float) -> DataFrame:
    """Upper-confidence weights: a quantile of p (1 - p) under the posterior."""
    import pandas as pd

    udf = F.pandas_udf(lambda a, b: pd.Series(_upper_quantile(a.to_numpy(float), b.to_numpy(float), level)), "double")
    return state.withColumn("weight", udf(F.col("a") + 1, F.col("b") + 1))


def thompson_weights(state: DataFrame, seed: int, temperature: float = 1.0, form: int = 1) -> DataFrame:
    """Weights of one keyed Beta draw a row."""
    import numpy as np
    import pandas as pd

    udf = F.pandas_udf(lambda key, a, b: pd.Series([np.random.default_rng(abs(int(k))).beta(x, y) for k, x, y in zip(key, a, b)]), "double")
    draw = udf(F.xxhash64(F.lit(seed), "idx"), (F.col("a") + 1) / temperature, (F.col("b") + 1) / temperature)
    return state.withColumn("_p", draw).withColumn("weight", learnability(F.col("_p"), form)).drop("_p")


def attention_probabilities(df: DataFrame, predicted: str, target: float = 0.5, temperature: float = 0.1) -> DataFrame:
    """Adds probability: softmax of -|predicted - target| / temperature over valid rows, uniform if there are none."""
    z = F.when(~F.isnan(predicted), -F.abs(F.col(predicted) - target) / temperature)
    d = df.withColumn("_z", z)
    top = d.agg(F.max("_z").alias("_top"), F.count(F.lit(1)).alias("_rows"))
    d = d.crossJoin(F.broadcast(top)).withColumn("_e", F.coalesce(F.exp(F.col("_z") - F.col("_top")), F.lit(0.0)))
    s = d.agg(F.sum("_e").alias("_s"))
    p = F.when(F.col("_s") > 0, F.col("_e") / F.col("_s")).otherwise(1.0 / F.col("_rows"))
    return d.crossJoin(F.broadcast(s)).withColumn("probability", p).drop("_z", "_top", "_rows", "_e", "_s")


# ---- rounds


def jaccard(a: DataFrame, b: DataFrame, key: str = "idx") -> DataFrame:
    """One row: the similarity of two index sets, 1 for two empty ones."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    g = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("i"), F.count(F.lit(1)).alias("u"))
    return g.select(F.when(F.col("u") == 0, 1.0).otherwise(F.col("i") / F.col("u")).alias("jaccard"))


def first_per_key(df: DataFrame, key: str, n: int = 32, order: str = "row_idx") -> DataFrame:
    """The first row of each key, the first n of them: a minimum by key, no window over a key's rows."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*").orderBy(order).limit(n)


def contrast(real, null, mask) -> Column:
    """Masked mean of log-probability differences, the count at least 1."""
    return A.masked_sum(F.zip_with(real, null, lambda a, b: a - b), mask) / F.greatest(A.count_mask(mask), F.lit(1.0))


def digest(indices: list[int]) -> str:
    """sha256 of the ordered indices as little-endian 64-bit integers."""
    return hashlib.sha256(b"".join(int(i).to_bytes(8, "little", signed=True) for i in indices)).hexdigest()


def phase(used: float, schedule: list[tuple[float, str]]) -> str:
    """The name of the first stage whose upper share of the budget is above `used`, else the last."""
    return next((name for upper, name in schedule if used < upper), schedule[-1][1])


@dataclass
class Budget:
    """Unique rows admitted, by disjoint origin; refuses what would go beyond the cap."""

    cap: int
    origin: dict[int, str] = field(default_factory=dict)

    def admit(self, indices, origin: str) -> None:
        new = [int(i) for i in dict.fromkeys(indices) if int(i) not in self.origin]
        if len(self.origin) + len(new) > self.cap:
            raise ValueError(f"{len(new)} new rows exceed the budget of {self.cap}")
        self.origin.update(dict.fromkeys(new, origin))

    def left(self) -> int:
        return self.cap - len(self.origin)

    def breakdown(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for o in self.origin.values():
            out[o] = out.get(o, 0) + 1
        return out


SELECTORS: dict = {}


def register_selector(name: str):
    def put(fn):
        if SELECTORS.get(name, fn) is not fn:
            raise ValueError(f"selector {name} is taken")
        SELECTORS[name] = fn
        return fn

    return put


@register_selector("random")
def _random(items: DataFrame, n: int, seed: int = 0, **_) -> DataFrame:
    return random_rows(items, n, "idx", seed)


@register_selector("top")
def _top(items: DataFrame, n: int, score: str = "score", **_) -> DataFrame:
    return items.orderBy(F.desc(score), "idx").limit(n)


@register_selector("weighted")
def _weighted(items: DataFrame, n: int, weight: str = "weight", seed: int = 0, **_) -> DataFrame:
    return weighted_rows(items, n, "idx", weight, seed)


@register_selector("top_clusters")
def _top_clusters(items: DataFrame, n: int, values: DataFrame, order: str = "score", **_) -> DataFrame:
    """Whole clusters by falling value; values(cluster, value)."""
    sizes = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(values, "cluster")
    return fill(items, top_clusters(sizes, "value", n), order).drop("rank", "take")


@register_selector("scored")
def _scored(items: DataFrame, n: int, values: DataFrame, temperature: float = 1.0, order: str = "score", **_) -> DataFrame:
    """Clusters share the budget by the softmax of their value, moved to meet it; the best rows of each."""
    sizes = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(values, "cluster")
    take = adjusted(softmax_share(sizes, "value", n, temperature), n, "value")
    return fill(items, take, order).drop("rank", "take")


@register_selector("interpolated")
def _interpolated(items: DataFrame, n: int, refs: DataFrame, k: int = 8, temperature: float = 0.05, diverse: bool = False, means: str | None = None, bias: float = 0.5, low: float = 0.0, high: float = 1.0, **_) -> DataFrame:
    """Rows of the greatest predicted variance, interpolated from refs(ref, vec, value) by similarity.

    `means` names a column of expected rewards that tilts the variance towards hard rows, unless that leaves nothing.  If `diverse`,
    clusters share the budget by their mean prediction, each with one row at least.
    """
    near = nearest_references(items.select("idx", "vec"), refs, k)
    d = items.join(interpolated(near, temperature), "idx").withColumnRenamed("predicted", "score")
    if means is not None:
        d = d.withColumn("_tilted", F.greatest(utility(F.col("score"), F.col(means), bias, low, high), F.lit(0.0)))
        alive = d.agg(F.sum("_tilted").alias("_alive"))
        d = d.crossJoin(F.broadcast(alive)).withColumn("score", F.when(F.col("_alive") > 0, F.col("_tilted")).otherwise(F.col("score"))).drop("_tilted", "_alive")
    if not diverse:
        return first_rows(d, n, F.desc("score"), "idx")
    per = d.groupBy("cluster").agg(F.avg("score").alias("value"), F.count(F.lit(1)).alias("size"))
    return fill(d, adjusted(proportional(per, "value", n), n, "value"), "score").drop("rank", "take")


@register_selector("similarity")
def _similarity(items: DataFrame, n: int, refs: DataFrame, k: int = 8, temperature: float = 0.05, target: float = 0.5, sharpness: float = 0.1, seed: int = 0, **_) -> DataFrame:
    """Rows drawn without replacement by how near their predicted mean reward is to the target; refs(ref, vec, value)."""
    near = nearest_references(items.select("idx", "vec"), refs, k)
    d = attention_probabilities(items.join(interpolated(near, temperature), "idx"), "predicted", target, sharpness)
    return weighted_rows(d, n, "idx", "probability", seed)


@register_selector("bandit")
def _bandit(items: DataFrame, n: int, state: DataFrame, seen: DataFrame | None = None, new_left: int | None = None, weights: str = "direct", level: float = 0.9, form: int = 1, seed: int = 0, **_) -> DataFrame:
    """The greatest learnability under state(idx, a, b), at most new_left of the rows unseen."""
    weighted = {"direct": lambda: direct_weights(state, form), "quantile": lambda: quantile_weights(state, level), "draw": lambda: thompson_weights(state, seed, form=form)}[weights]()
    d = items.join(weighted.select("idx", "weight"), "idx")
    if new_left is None:
        return first_rows(d, n, F.desc("weight"), "idx")
    return top_with_budget(d, seen if seen is not None else d.select("idx").limit(0), "weight", n, new_left)


@register_selector("none")
def _none(items: DataFrame, n: int, **_) -> DataFrame:
    return items


def select_round(items: DataFrame, config: SelectionConfig, size: int) -> DataFrame:
    if config.strategy not in SELECTORS:
        raise ValueError(f"unknown strategy {config.strategy}")
    return SELECTORS[config.strategy](items, config.rows(size), seed=config.seed, **config.options)


# ---- rounds of discovery under a budget


@dataclass
class Rounds:
    """What selection remembers between rounds: rows taken (idx, origin) and the last choice; frozen once the cap is reached."""

    cap: int | None = None
    floor: int = 0
    seen: DataFrame | None = None
    last: DataFrame | None = None
    frozen: bool = False
    number: int = 0

    def remaining(self) -> int | None:
        return None if self.cap is None else self.cap - (0 if self.seen is None else self.seen.count())

    def admit(self, chosen: DataFrame, origin: str) -> int:
        """Takes new rows in under their origin; the rows seen then.  Rows already seen keep theirs."""
        new = chosen.select("idx").distinct()
        new = new if self.seen is None else new.join(self.seen.select("idx"), "idx", "left_anti")
        new = new.withColumn("origin", F.lit(origin))
        self.seen = (new if self.seen is None else self.seen.unionByName(new)).persist()
        n = self.seen.count()
        self.frozen = self.frozen or self.cap is not None and n >= self.cap
        return n


def discovery_round(items: DataFrame, config: SelectionConfig, rounds: Rounds, size: int, signal: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(idx and place of the chosen rows, metrics) of one round, which `rounds` then remembers.

    Before the cap, unseen rows are chosen by the strategy, at random if its options hold no signal yet, never more than the cap has left.
    Once frozen, the pool of seen rows is drawn with replacement by signal(idx, value), floored.  Rows seen fill up to `floor`, drawn with
    replacement, so that a batch is whole and no new row is spent.
    """
    from .advantages import resampled

    left, was_frozen = rounds.remaining(), rounds.frozen
    n = config.rows(size) if left is None else min(config.rows(size), max(left, 0))
    rounds.number += 1
    if was_frozen or left is not None and left <= 0:
        pool = rounds.seen.select("idx")
        weights = pool.join(signal, "idx", "left") if signal is not None else pool.withColumn("value", F.lit(1.0))
        weights = frozen_weights(weights, "value").select(F.col("idx").alias("row_idx"), "weight")
        chosen = resampled(weights, "weight", max(config.rows(size), rounds.floor), config.seed + rounds.number).select(F.col("row_idx").alias("idx"), F.col("draw").alias("place"))
        origin = None
    else:
        open_ = items if rounds.seen is None else items.join(rounds.seen.select("idx"), "idx", "left_anti")
        needs = {"top_clusters": "values", "scored": "values", "interpolated": "refs", "similarity": "refs", "bandit": "state"}.get(config.strategy)
        cold = needs is not None and config.options.get(needs) is None
        picked = random_rows(open_, n, "idx", config.seed + rounds.number) if cold else SELECTORS[config.strategy](open_, n, seed=config.seed + rounds.number, **config.options)
        chosen, origin = picked.select("idx"), "train"
    chosen = chosen.persist()
    took = chosen.count()
    metrics = {"round": rounds.number, "selected": took, "jaccard": 0.0 if rounds.last is None else jaccard(chosen, rounds.last).first()[0]}
    rounds.last = chosen.select("idx").distinct()
    if origin:
        metrics["seen"] = rounds.admit(chosen, origin)
        if took < rounds.floor:
            reusable = rounds.seen.select(F.col("idx").alias("row_idx"), F.lit(1.0).alias("weight"))
            pad = resampled(reusable, "weight", rounds.floor - took, config.seed + rounds.number).select(F.col("row_idx").alias("idx"))
            chosen = chosen.unionByName(pad)
            metrics["padded"] = rounds.floor - took
    metrics["frozen"] = rounds.frozen
    return chosen.select("idx"), metrics


def probes(items: DataFrame, predictions: DataFrame, n: int, beta: float = 1.0, radius: float = 0.0, seen: DataFrame | None = None, batch: int = 2_048) -> list:
    """The n unseen rows of the greatest predicted + beta * sigma, each choice keeping others at least a cosine radius away.

    predictions(idx, predicted, sigma).  Rows come to the driver a bounded batch at a time, those already suppressed left out, until n are chosen.
    """
    import numpy as np

    d = items.join(predictions, "idx").select("idx", unit("vec").alias("u"), (F.col("predicted") + beta * F.col("sigma")).alias("acq")).where("acq is not null and not isnan(acq)")
    if seen is not None:
        d = d.join(seen.select("idx"), "idx", "left_anti")
    chosen: list = []
    vectors: list = []
    while len(chosen) < n:
        rows = d.orderBy(F.desc("acq"), "idx").limit(batch).collect()
        if not rows:
            break
        for r in rows:
            u = np.array(r["u"])
            if len(chosen) < n and not (radius > 0 and any(v @ u > 1 - radius for v in vectors)):
                chosen.append(r["idx"])
                vectors.append(u)
        edge = rows[-1]
        d = d.where((F.col("acq") < F.lit(edge["acq"])) | (F.col("acq") == F.lit(edge["acq"])) & (F.col("idx") > F.lit(edge["idx"])))
    return chosen


def exploration_rows(items: DataFrame, rounds: Rounds, n: int, every: int, seed: int = 0) -> DataFrame:
    """Random rows that nobody has seen, every so many rounds and within the cap; none once frozen."""
    left = rounds.remaining()
    n = 0 if rounds.frozen or every <= 0 or rounds.number % every else n if left is None else min(n, max(left, 0))
    open_ = items if rounds.seen is None else items.join(rounds.seen.select("idx"), "idx", "left_anti")
    return random_rows(open_.select("idx"), n, "idx", seed + rounds.number)
