"""Inferential statistics: bootstrap intervals, signed ranks, false-discovery control, effect sizes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scans

BOOT, SEED, ALPHA = 2000, 42, 0.05
#: Cells whose replicate sums one task holds before it passes them on.
HELD_CELLS = 500
#: Values of a cell that one task holds for exact intervals; larger cells are resampled block by block.
BLOCK_VALUES = 500_000
#: Positions drawn at once by a block's task.
_DRAWN = 1 << 20
#: Groups of untied differences up to this size get exact signed-rank probabilities.
EXACT_RANKS = 50


def bootstrap_interval(values: np.ndarray, n_boot: int = BOOT, seed: int = SEED, alpha: float = ALPHA) -> tuple[float, float, float]:
    """(mean, low, high) of resampled means with linear percentiles; the order of values matters. NaNs for no values."""
    if not values.size:
        return math.nan, math.nan, math.nan
    rng = np.random.RandomState(seed)
    means = np.array([values[rng.randint(0, values.size, values.size)].mean() for _ in range(n_boot)])
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(values.mean()), float(low), float(high)


def poisson_sums(df: DataFrame, cell: Sequence[str], moments: Sequence[str], order: Sequence[str], n_boot: int = BOOT, seed: int = SEED) -> DataFrame:
    """(cell, b, w, moments): sums of Poisson(1) weights and weighted columns for each replicate ``b``.

    A row's weights come from a hash of seed, replicate and order columns. Each task folds its rows into one row of sums
    per cell and replicate before the shuffle, so no row is repeated and no cell is gathered.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in cell], F.xxhash64(F.lit(seed), *order).alias("_h"), *[F.col(m).cast("double").alias(m) for m in moments])
    fields = list(rows.select(*cell).schema.fields)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "b int", "w double", *(f"`{m}` double" for m in moments)])
    # inverse Poisson(1): how many thresholds of its distribution a uniform number passes
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    replicate = np.arange(n_boot, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def weights(h: np.ndarray) -> np.ndarray:
        x = h.view(np.uint64)[:, None] ^ replicate
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)).astype(float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            made = [pd.DataFrame({**dict(zip(cell, key)), "b": np.arange(n_boot), "w": s[0], **dict(zip(moments, s[1:]))}) for key, s in sums.items()]
            return pd.concat(made) if made else pd.DataFrame(columns=[*cell, "b", "w", *moments])

        for pdf in frames:
            keys = pdf[list(cell)].astype(object).where(pdf[list(cell)].notna(), None)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys.itertuples(index=False, name=None)):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                at = np.array(at)
                held = sums.setdefault(key, np.zeros((1 + len(moments), n_boot)))
                for part in np.array_split(at, -(-at.size // 1000)):
                    w = weights(pdf["_h"].to_numpy()[part])
                    held[0] += w.sum(0)
                    held[1:] += pdf[list(moments)].to_numpy(float)[part].T @ w
            if len(sums) > HELD_CELLS:
                yield out()
                sums.clear()
        if sums:
            yield out()

    partial = rows.mapInPandas(run, schema)
    return partial.groupBy(*cell, "b").agg(F.sum("w").alias("w"), *[F.sum(m).alias(m) for m in moments])


def _per_cell(df: DataFrame, cell: Sequence[str], order: Sequence[str], values: Sequence[str], names: Sequence[str], run) -> DataFrame:
    """One row per cell of what ``run`` makes of its values in order; a cell's values are held by one task."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cell).schema.fields), "n long", *(f"{n} double" for n in names)])

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        return pd.DataFrame([[*pdf.iloc[0][list(cell)], len(pdf), *run(*[pdf[v].to_numpy(float) for v in values])]], columns=[*cell, "n", *names])

    return df.groupBy(*cell).applyInPandas(each, schema)


def _resampled(rows: DataFrame, cell: Sequence[str], order: Sequence[str], values: Sequence[str], moments, n_boot: int, seed: int) -> DataFrame:
    """(cell, b, n, distinct, sums): for every replicate ``b`` the sums over its drawn rows of each of ``moments(values)``.

    Each cell's values in order are cut into blocks of BLOCK_VALUES. A block's task draws all of a cell's positions, from
    the same generator as every other block, and counts how often each of its own is drawn; the blocks' sums are added.
    ``distinct`` tells for each value column whether a replicate drew more than one value of it.
    """
    placed = scans.places(rows, cell, order, BLOCK_VALUES).withColumn("_block", F.floor(F.col("_place") / BLOCK_VALUES))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cell).schema.fields)
    m = len(moments(*[np.zeros(1)] * len(values)))
    ends = [f"{e}{i}" for i in range(len(values)) for e in ("lo", "hi")]
    schema = f"{fields}, b int, n long, " + ", ".join(f"{x} double" for x in [*[f"s{i}" for i in range(m)], *ends])
    size = BLOCK_VALUES

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        n, first = int(pdf["_n"].iloc[0]), int(pdf["_block"].iloc[0]) * size
        own = [pdf[v].to_numpy(float) for v in values]
        terms = np.stack(moments(*own), 1)
        rng = np.random.RandomState(seed)
        out = []
        for b in range(n_boot):
            drawn = np.zeros(len(pdf), np.int64)
            for at in range(0, n, _DRAWN):
                places = rng.randint(0, n, min(_DRAWN, n - at)) - first
                drawn += np.bincount(places[(places >= 0) & (places < len(pdf))], minlength=len(pdf))
            met = drawn > 0
            out.append([b, n, *(drawn @ terms), *(f(v[met]) if met.any() else math.nan for v in own for f in (np.min, np.max))])
        got = pd.DataFrame(out, columns=["b", "n", *[f"s{i}" for i in range(m)], *ends])
        for i, c in enumerate(cell):
            got.insert(i, c, pdf[c].iloc[0])
        return got

    parts = placed.groupBy(*cell, "_block").applyInPandas(each, schema)
    spread = F.array(*[F.min(F.nanvl(f"lo{i}", F.lit(float("inf")))) < F.max(F.nanvl(f"hi{i}", F.lit(float("-inf")))) for i in range(len(values))])
    return parts.groupBy(*cell, "b").agg(F.max("n").alias("n"), spread.alias("distinct"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(m)])


def _by_size(rows: DataFrame, cell: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of cells that one task may hold, and those of larger cells (none if there are none)."""
    large = rows.groupBy(*cell).agg(F.count("*").alias("_rows")).where(F.col("_rows") > BLOCK_VALUES)
    if large.isEmpty():
        return rows, None
    keys = large.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)])
    on = F.lit(True)
    for i, c in enumerate(cell):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(keys, on, "left_anti"), rows.join(keys, on, "left_semi")


def _limits(found: DataFrame, cell: Sequence[str], value: str, alpha: float) -> DataFrame:
    return found.groupBy(*cell).agg(F.percentile(value, alpha / 2).alias("lo"), F.percentile(value, 1 - alpha / 2).alias("hi"))


def _beside(stats: DataFrame, ends: DataFrame, cell: Sequence[str]) -> DataFrame:
    """``stats`` with the limits of each cell, null where it has none."""
    named = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)], "lo", "hi")
    on = F.lit(True)
    for i, c in enumerate(cell):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return stats.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(cell))])


def bootstrap_ci(df: DataFrame, cell: Sequence[str], value: str, order: Sequence[str], n_boot: int = BOOT, seed: int = SEED, alpha: float = ALPHA, method: str = "exact") -> DataFrame:
    """(cell, n, mean, lo, hi) per cell over non-null values in the given order.

    ``exact`` resamples each cell's vector with one generator: in one task up to BLOCK_VALUES values, beyond that block by
    block with the same draws, so the limits are the same but for the order of additions. ``poisson`` weighs rows by
    Poisson numbers instead and passes over them once; its limits differ from the exact ones by chance.
    """
    rows = df.where(F.col(value).isNotNull()).select(*cell, *order, F.col(value).cast("double").alias("_v"))
    if method == "exact":
        small, large = _by_size(rows, cell)
        out = _per_cell(small, cell, order, ["_v"], ["mean", "lo", "hi"], lambda v: bootstrap_interval(v, n_boot, seed, alpha))
        if large is None:
            return out
        means = _resampled(large, cell, order, ["_v"], lambda v: [v], n_boot, seed).withColumn("_m", F.col("s0") / F.col("n"))
        stats = large.groupBy(*cell).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
        return out.unionByName(_beside(stats, _limits(means, cell, "_m", alpha), cell))
    if method != "poisson":
        raise ValueError(f"unknown method {method}")
    means = poisson_sums(rows, cell, ["_v"], order, n_boot, seed).select(*cell, F.try_divide("_v", "w").alias("_m"))
    return rows.groupBy(*cell).agg(F.count("*").alias("n"), F.avg("_v").alias("mean")).join(_limits(means, cell, "_m", alpha), list(cell))


def pearson_interval(x: np.ndarray, y: np.ndarray, n_boot: int = BOOT, seed: int = SEED, alpha: float = ALPHA) -> tuple[float, float, float]:
    """(r, low, high) of resampled pairs; NaNs for fewer than 2 pairs or without spread. Resamples without spread don't count."""
    if x.size < 2 or not x.std() or not y.std():
        return math.nan, math.nan, math.nan
    rng = np.random.RandomState(seed)
    found = []
    for _ in range(n_boot):
        at = rng.randint(0, x.size, x.size)
        if x[at].std() and y[at].std():
            found.append(np.corrcoef(x[at], y[at])[0, 1])
    low, high = np.percentile(found, [100 * alpha / 2, 100 * (1 - alpha / 2)]) if found else (math.nan, math.nan)
    return float(np.corrcoef(x, y)[0, 1]), float(low), float(high)


def _correlation() -> Column:
    """Correlation of _x and _y, null without spread."""
    return F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))


def _large_pearson(rows: DataFrame, cell: Sequence[str], order: Sequence[str], n_boot: int, seed: int, alpha: float) -> DataFrame:
    """``pearson_interval`` of cells that no task holds whole; columns are centred first, so that little is lost in their products."""
    stats = rows.groupBy(*cell).agg(F.count("*").alias("n"), _correlation().alias("r"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), (F.min("_x") < F.max("_x")).alias("_vx"), (F.min("_y") < F.max("_y")).alias("_vy"))
    means = stats.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)], "_mx", "_my")
    on = F.lit(True)
    for i, c in enumerate(cell):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    centred = rows.join(means, on).select(*cell, *order, (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y"))
    s = _resampled(centred, cell, order, ["_x", "_y"], lambda x, y: [x, y, x * x, y * y, x * y], n_boot, seed).where("distinct[0] and distinct[1]")
    sx, sy, xx, yy, xy, n = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "n"))
    r = (n * xy - sx * sy) / F.sqrt((n * xx - sx * sx) * (n * yy - sy * sy))
    got = _beside(stats.drop("_mx", "_my"), _limits(s.withColumn("_r", r), cell, "_r", alpha), cell)
    return got.select(*cell, "n", *[F.when(F.col("_vx") & F.col("_vy"), F.col(c)).alias(c) for c in ("r", "lo", "hi")])


def pearson_ci(df: DataFrame, cell: Sequence[str], x: str, y: str, order: Sequence[str], n_boot: int = BOOT, seed: int = SEED, alpha: float = ALPHA, method: str = "exact") -> DataFrame:
    """(cell, n, r, lo, hi): correlation of the non-null pairs of each cell with its bootstrap limits; methods as ``bootstrap_ci``."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*cell, *order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    if method == "exact":
        small, large = _by_size(rows, cell)
        out = _per_cell(small, cell, order, ["_x", "_y"], ["r", "lo", "hi"], lambda a, b: pearson_interval(a, b, n_boot, seed, alpha))
        return out if large is None else out.unionByName(_large_pearson(large, cell, order, n_boot, seed, alpha))
    if method != "poisson":
        raise ValueError(f"unknown method {method}")
    rows = rows.withColumns({"_xx": F.col("_x") * F.col("_x"), "_yy": F.col("_y") * F.col("_y"), "_xy": F.col("_x") * F.col("_y")})
    s = poisson_sums(rows, cell, ["_x", "_y", "_xx", "_yy", "_xy"], order, n_boot, seed)
    w, spread = F.col("w"), lambda c: F.col(f"_{c}{c}") * F.col("w") - F.col(f"_{c}") * F.col(f"_{c}")
    r = F.try_divide(F.col("_xy") * w - F.col("_x") * F.col("_y"), F.sqrt(F.greatest(spread("x") * spread("y"), F.lit(0.0))))
    ends = _limits(s.select(*cell, r.alias("_r")), cell, "_r", alpha)
    return rows.groupBy(*cell).agg(F.count("*").alias("n"), _correlation().alias("r")).join(ends, list(cell))


def signed_ranks(df: DataFrame, cell: Sequence[str], difference: str) -> DataFrame:
    """(cell, n, w_plus, w_minus, tie_term) over non-zero differences with average ranks of their sizes.

    Ranks come from counts per distinct size, summed up range by range: no task holds all sizes of a cell.
    """
    d = df.where((F.col(difference) != 0) & F.col(difference).isNotNull())
    by_size = d.groupBy(*cell, F.abs(difference).alias("_a")).agg(F.count("*").alias("_k"), F.count_if(F.col(difference) > 0).alias("_p"))
    ranged = scans.carried(scans.in_ranges(by_size, cell, ["_a"]), cell, {"_t": F.sum("_k")}, {"_below": F.coalesce(F.sum("_t").over(scans.before(cell)), F.lit(0))})
    below = F.col("_below") + F.sum("_k").over(scans.inside(cell, ["_a"])) - F.col("_k")
    ranked = ranged.withColumn("_r", below + (F.col("_k") + 1) / F.lit(2.0))
    return ranked.groupBy(*cell).agg(
        F.sum("_k").alias("n"),
        F.sum(F.col("_r") * F.col("_p")).alias("w_plus"),
        F.sum(F.col("_r") * (F.col("_k") - F.col("_p"))).alias("w_minus"),
        F.sum(F.col("_k") * F.col("_k") * F.col("_k") - F.col("_k")).cast("double").alias("tie_term"),
    )


def signed_rank_probability(n: int, w_plus: float, w_minus: float, tie_term: float) -> float | None:
    """Two-sided probability: none for fewer than 6 differences; exact for up to EXACT_RANKS untied ones, else normal."""
    if n < 6:
        return None
    w = min(w_plus, w_minus)
    if not tie_term and n <= EXACT_RANKS:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[: ways.size - k].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else None


def wilcoxon(df: DataFrame, cell: Sequence[str], difference: str) -> DataFrame:
    """Signed ranks with ``p``, computed batch-wise on one row per cell."""

    @F.pandas_udf("double")
    def p(n: pd.Series, w_plus: pd.Series, w_minus: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_probability(int(a), b, c, d) for a, b, c, d in zip(n, w_plus, w_minus, tie)], dtype=float)

    got = signed_ranks(df, cell, difference)
    return got.withColumn("p", p("n", "w_plus", "w_minus", "tie_term"))


def bh_adjust(df: DataFrame, cell: Sequence[str], p: str, order: Sequence[str], out: str = "p_bh") -> DataFrame:
    """Benjamini-Hochberg values of the non-null probabilities of each family; others stay null.

    Ranks are places in ranges of the family, and the least value behind a row is carried back from range to range: no task
    holds a family.
    """
    known = df.where(F.col(p).isNotNull())
    by = [p, *order]
    held = {"_held": F.count("*")}
    ranged = scans.carried(scans.in_ranges(known, cell, by), cell, held, {"_first": F.coalesce(F.sum("_held").over(scans.before(cell)), F.lit(0)), "_n": F.sum("_held").over(scans.whole(cell))})
    up = scans.inside(cell, by)
    raw = F.col(p) * F.col("_n") / (F.col("_first") + F.row_number().over(up))
    ranked = ranged.withColumn("_raw", raw)
    later = scans.carried(ranked, cell, {"_least": F.min("_raw")}, {"_later": F.min("_least").over(scans.behind(cell))})
    least = F.least(F.lit(1.0), F.min("_raw").over(up.rowsBetween(W.currentRow, W.unboundedFollowing)), F.col("_later"))
    got = later.withColumn(out, least).select(*df.columns, out)
    return got.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def cohens_d(df: DataFrame, cell: Sequence[str], a: str, b: str, least: int = 5) -> DataFrame:
    """Paired effect sizes of two columns per cell: n, mean difference, d_z, d_av; null for fewer than ``least`` pairs."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    got = pairs.groupBy(*cell).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("_sd"), F.stddev_samp(a).alias("_sa"), F.stddev_samp(b).alias("_sb"))
    enough = (F.col("n") >= least) & (F.col("_sd") > 0)
    both = F.sqrt((F.col("_sa") * F.col("_sa") + F.col("_sb") * F.col("_sb")) / 2)
    return got.select(*cell, "n", "mean_diff", F.when(enough, F.col("mean_diff") / F.col("_sd")).alias("d_z"), F.when(enough & (both > 0), F.col("mean_diff") / both).alias("d_av"))


def pooled_d(effects: DataFrame, cell: Sequence[str], d: str = "d_z", digits: int | None = None) -> DataFrame:
    """Mean of the sizes of effects, weighted by pairs, and the signed mean; ``digits`` rounds the effects first."""
    e = effects.where(F.col(d).isNotNull()).withColumn("_d", F.col(d) if digits is None else F.round(d, digits))
    return e.groupBy(*cell).agg((F.sum(F.abs("_d") * F.col("n")) / F.sum("n")).alias("abs_d"), (F.sum(F.col("_d") * F.col("n")) / F.sum("n")).alias("signed_d"), F.sum("n").alias("n"))
