"""Embedding near-duplicates by lattice hashing.

Each of `TABLES` tables projects a vector at random to 16 dimensions and decodes both halves to the nearest point
of the lattice E8; the pair of points is the vector's cell. Scaled so that two vectors at the threshold lie about
half a packing radius apart, near vectors share a cell or lie in neighbouring ones, so a vector looks up its own
cell and the `PROBES` - 1 neighbouring pairs of cells that are nearest to it. Every candidate is verified by its
cosine in double precision inside the join; only verified links leave it, and a pair that shared its cell in an
earlier table is skipped before its cosine is taken. A hot cell is split by the adaptive skew join.

Equal vectors are folded first and count as links of each other.

Defined results: null, empty or zero vectors and those with null or non-finite components link with nothing;
vectors of different sizes never link; null vec_ids are ignored by component_id; repeated rows are separate
vectors; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read
from .components import components

THRESHOLD, TABLES, PROBES, SCALE, SEED = 0.95, 6, 6, 0.5, 20250101


def _minimal_vectors():
    import itertools

    import numpy as np

    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [[s / 2 for s in signs] for signs in itertools.product((1, -1), repeat=8) if sum(s < 0 for s in signs) % 2 == 0]
    return np.array(out)


def nearest_e8(y):
    """Nearest points of E8 to the rows of y (n, 8): the nearer of the decodings in D8 and in D8 + 1/2."""
    import numpy as np

    def d8(x):
        r = np.rint(x)
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return r

    a, b = d8(y), d8(y - 0.5) + 0.5
    closer = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


def cells(tables: int, probes: int) -> Callable:
    """mapInPandas function: (vec, ...) -> the same with home (a key for each table) and near (probes keys for
    each table, the home first)."""

    def run(frames: Iterator) -> Iterator:
        import numpy as np

        least = _minimal_vectors()
        mix = np.random.default_rng(SEED).integers(1, 1 << 62, size=(tables, 16), dtype=np.int64) | 1

        def keys(t, left, right):
            with np.errstate(over="ignore"):
                h = (np.concatenate([left, right], axis=1) * 2).astype(np.int64) @ mix[t]
                return (h ^ (h >> 29)) * np.int64(0x5851F42D4C957F2D) + t

        for f in frames:
            home, near = np.zeros((len(f), tables), dtype=np.int64), np.zeros((len(f), tables, probes), dtype=np.int64)
            sizes = f["vec"].map(len).to_numpy()
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                x = np.stack(f["vec"].iloc[rows].to_list()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                flat = np.random.default_rng([SEED, int(d)])
                for t in range(tables):
                    y = x @ flat.normal(size=(d, 16)) * SCALE
                    halves = []
                    for z in (y[:, :8], y[:, 8:]):
                        c = nearest_e8(z)
                        gain = (z - c) @ least.T
                        best = np.argpartition(-gain, 3, axis=1)[:, :3]
                        cost = np.concatenate([np.zeros((len(z), 1)), 2 - 2 * np.take_along_axis(gain, best, axis=1)], axis=1)
                        halves.append((np.concatenate([c[:, None], c[:, None] + least[best]], axis=1), cost))
                    (left, lc), (right, rc) = halves
                    order = np.argsort((lc[:, :, None] + rc[:, None, :]).reshape(len(x), 16), axis=1, kind="stable")[:, :probes]
                    at = np.arange(len(x))
                    for p in range(probes):
                        near[rows, t, p] = keys(t, left[at, order[:, p] // 4], right[at, order[:, p] % 4])
                    home[rows, t] = near[rows, t, 0]
            yield f.assign(home=list(home), near=[n.reshape(-1) for n in near])

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def links(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vectors(id, vec, norm), distinct and valid -> (a, b), a < b, without repeats."""
    hashed = vectors.mapInPandas(cells(tables, probes), vectors.schema.simpleString()[7:-1].replace(":", " ", len(vectors.columns)) + ", home array<long>, near array<long>")
    hashed = durable(hashed)
    index = hashed.select(F.col("id").alias("b"), F.col("vec").alias("vec_b"), F.col("norm").alias("norm_b"), F.col("home").alias("home_b"), F.posexplode("home").alias("t", "key"))
    asked = hashed.select(F.col("id").alias("a"), "vec", "norm", "home", F.posexplode("near").alias("i", "key"))
    table = F.floor(F.col("i") / probes).cast("int")
    earlier = F.exists(F.arrays_zip(F.slice("home", F.lit(1), F.col("t")).alias("x"), F.slice("home_b", F.lit(1), F.col("t")).alias("y")), lambda z: z.x == z.y)
    # A pair in one cell is seen from both ends; one that shares no cell may be seen from one end only.
    ours = (F.col("t") == table) & (F.col("a") != F.col("b")) & ((F.get("home", F.col("t")) != F.col("key")) | (F.col("a") < F.col("b"))) & ~earlier
    close = (F.size("vec") == F.size("vec_b")) & (_dot(F.col("vec"), F.col("vec_b")) / (F.col("norm") * F.col("norm_b")) >= threshold)
    found = asked.hint("merge").join(index, "key").filter(ours).filter(close)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding")))
    ok = F.coalesce(~bad & (norm > 0), F.lit(False))
    keyed = durable(rows.select("vec_id", F.when(ok, F.col("embedding")).alias("vec"), F.when(ok, norm).alias("norm"), F.when(ok, F.xxhash64("embedding")).alias("print")))
    # Equal vectors fold by value, under a hash of it; 0.0 and -0.0 are one value to groupBy and may stay two here.
    groups = durable(keyed.filter("vec is not null").groupBy("print", "vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.first("norm").alias("norm")).withColumn("id", F.xxhash64("print", F.to_json("vec"))))
    pairs = durable(links(groups.select("id", "vec", "norm"), threshold))
    both = pairs.union(pairs.select("b", "a"))
    others = both.join(groups.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(pairs)
    known = groups.drop("norm").join(roots, groups.id == roots.node, "left").withColumn("root", F.coalesce("root", "id"))
    ids = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = known.join(ids, "root").join(others, F.col("id") == F.col("a"), "left").select("print", "vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = keyed.alias("k").join(found.alias("f"), (F.col("k.print") == F.col("f.print")) & (F.col("k.vec") == F.col("f.vec")), "left")
    root = F.coalesce("component_id", "vec_id")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col("vec_id")).alias("kept"))


def op4_e8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
