"""Datasets behind charts (V1-V8).  Drawing is left to the caller; every
function returns the aggregate a chart needs, computed by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import pround, rnd, col, num
from tessera.functions.frames import multipass
from tessera.functions.quantiles import quantile_values
from tessera.functions.ranking import grouped_quantiles, keyed, small
from tessera.operators.sampling import sample_n
from tessera.operators.stats import grouped_mean


def _bin_expr(x, lo: float, hi: float, bins: int):
    span = hi - lo
    if span <= 0:
        return F.lit(0)
    b = F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(span)).cast("int")
    return F.least(b, F.lit(bins - 1))


def histogram(df: DataFrame, c: str, bins: int = 40, by: str | None = None,
              digits: int = 6) -> DataFrame:
    """Equal-width histogram: (bin, bin_lo, bin_hi[, by], n).  Edges span
    [min, max] of the column; the maximum falls in the last bin.  One pass
    for the range, one grouped count with map-side combine."""
    x = num(df, c)
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).collect()[0]
    lo, hi = rng["lo"], rng["hi"]
    keys = [col(by)] if by else []
    if lo is None:
        schema = "bin int, bin_lo double, bin_hi double, " + (f"`{by}` string, " if by else "") + "n long"
        return df.sparkSession.createDataFrame([], schema)
    width = (hi - lo) / bins
    d = df.where(x.isNotNull())
    out = d.groupBy(_bin_expr(x, lo, hi, bins).alias("bin"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin",
                      rnd(F.lit(lo) + F.col("bin") * F.lit(width), digits).alias("bin_lo"),
                      rnd(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), digits).alias("bin_hi"),
                      *([col(by)] if by else []), "n")


def mean_marker(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    """Mean of ``c`` (per ``by``) for the vertical marker on a histogram."""
    x = num(df, c)
    if by:
        return df.where(col(by).isNotNull()).groupBy(col(by)).agg(F.avg(x).alias("mean"))
    return df.agg(F.avg(x).alias("mean"))


def box_stats(df: DataFrame, c: str, by: str | None = None, k: float = 1.5,
              digits: int = 6) -> DataFrame:
    """Box summary ([by,] n, q1, median, q3, lower_fence, upper_fence,
    whisker_lo, whisker_hi, n_outliers) with exact quartiles; whiskers are
    the extreme values inside the fences. Any number of groups."""
    probs = [0.25, 0.5, 0.75]
    if by:
        rows = keyed(df, [by])
        q = grouped_quantiles(df, [by], [c], probs)
        q = q.select(col(by), F.col("n0").alias("n"), *[F.col(f"q0_{j}").alias(name) for j, name in enumerate(("q1", "median", "q3"))])
    else:
        rows = df
        with multipass(df, [c]) as work:
            qv, ex = quantile_values(work, [c], probs)
        q = df.sparkSession.createDataFrame([[ex[()]["__n_0"], *[qv[()][(c, p)] for p in probs]]],
                                            "n long, q1 double, median double, q3 double")
    spread = F.col("q3") - F.col("q1")
    q = q.withColumns({"lower_fence": F.col("q1") - k * spread, "upper_fence": F.col("q3") + k * spread})
    data = rows.select(*([col(by)] if by else []), num(rows, c).alias("__x"))
    j = data.join(small(q), by) if by else data.join(F.broadcast(q))  # one row without groups
    x = F.col("__x")
    inside = (x >= F.col("lower_fence")) & (x <= F.col("upper_fence"))
    names = ["n", "q1", "median", "q3", "lower_fence", "upper_fence"]
    keys = [col(by)] if by else []
    # the fences go along as equal values of a group, so that the result needs no second join
    out = j.groupBy(*keys).agg(
        *[F.first(n).alias(n) for n in names], F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
        F.count_if(x.isNotNull() & ~inside).alias("n_outliers"))
    if not by:  # of an empty table too
        out = out.select(F.coalesce("n", F.lit(0)).alias("n"), *[c for c in out.columns if c != "n"])
    return out.select(*keys, "n", *[rnd(n, digits).alias(n) for n in (*names[1:], "whisker_lo", "whisker_hi")], "n_outliers")


def violin_stats(df: DataFrame, c: str, by: str | None = None, bins: int = 40) -> DataFrame:
    """Density per group for a violin: histogram counts with each bin's
    share of its group ([by,] bin, bin_lo, bin_hi, n, share)."""
    h = histogram(df, c, bins, by)
    if by:
        # a group has at most ``bins`` rows here
        tot = h.groupBy(col(by).alias("__by")).agg(F.sum("n").alias("__tot"))
        h = h.join(tot, h[by].eqNullSafe(tot["__by"])).drop("__by")
    else:
        h = h.withColumn("__tot", F.lit(h.agg(F.sum("n")).first()[0]))
    return h.withColumn("share", rnd(F.col("n") / F.col("__tot"), 6)).drop("__tot")


def violin_outliers(df: DataFrame, c: str, by: str | None = None, k: float = 1.5) -> DataFrame:
    """The points beyond the whiskers of a violin's box ([by,] value, n): each
    distinct value with its number of rows. The box itself is ``box_stats``."""
    x = num(df, c)
    box = box_stats(df, c, by, k, 12).select(*([col(by).alias("__by")] if by else []), "lower_fence", "upper_fence")
    points = df.select(*([col(by)] if by else []), x.alias("value")).where(F.col("value").isNotNull())
    points = points.groupBy(*([col(by)] if by else []), "value").agg(F.count(F.lit(1)).alias("n"))
    if by:
        points = points.join(box, points[by] == box["__by"]).drop("__by")
    else:
        fence = box.first()
        points = points.select("*", F.lit(fence["lower_fence"]).cast("double").alias("lower_fence"),
                               F.lit(fence["upper_fence"]).cast("double").alias("upper_fence"))
    out = points.where((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence")))
    return out.select(*([col(by)] if by else []), "value", "n")


def scatter_bins(df: DataFrame, x: str, y: str, color: str | None = None, bins: int = 40) -> DataFrame:
    """All rows of a scatter plot as counts on a grid of equal cells:
    (x_bin, y_bin, x_lo, y_lo[, color], n); rows where x or y is missing drop out."""
    xc, yc = num(df, x), num(df, y)
    d = df.where(xc.isNotNull() & yc.isNotNull())
    r = d.agg(F.min(xc), F.max(xc), F.min(yc), F.max(yc)).first()
    if r[0] is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, x_lo double, y_lo double, n long")

    def cell(v, lo, hi):
        w = (hi - lo) / bins
        return (F.least(F.floor((v - lo) / w), F.lit(bins - 1)) if w > 0 else F.lit(0)).cast("int")

    keys = ["x_bin", "y_bin"] + ([color] if color else [])
    counts = (d.select(cell(xc, r[0], r[1]).alias("x_bin"), cell(yc, r[2], r[3]).alias("y_bin"), *([col(color)] if color else []))
              .groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")))
    return counts.select("x_bin", "y_bin", (F.lit(r[0]) + F.col("x_bin") * ((r[1] - r[0]) / bins)).alias("x_lo"),
                         (F.lit(r[2]) + F.col("y_bin") * ((r[3] - r[2]) / bins)).alias("y_lo"), *([col(color)] if color else []), "n")


def scatter_sample(df: DataFrame, x: str, y: str, color: str | None = None, n: int = 5000,
                   key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Seeded hash-ordered sample of (x, y[, color]) points."""
    cols = [x, y] + ([color] if color else [])
    key = key or df.columns
    s = sample_n(df.select(*[col(c) for c in dict.fromkeys(cols + key)]), n, key, seed)
    return s.select(*[col(c) for c in cols])


def scatter_matrix(df: DataFrame, cols: list[str], color: str | None = None, n: int = 5000,
                   key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """One seeded sample of the feature columns (+ color) for a pair plot;
    needs at least two features."""
    if len(cols) < 2:
        raise ValueError("scatter matrix needs at least two columns")
    key = key or df.columns
    keep = list(dict.fromkeys(cols + ([color] if color else []) + key))
    s = sample_n(df.select(*[col(c) for c in keep]), n, key, seed)
    return s.select(*[col(c) for c in cols + ([color] if color else [])])


def chart_data(df: DataFrame, kind: str, x: str, y: str | None = None, color: str | None = None,
               **kw) -> DataFrame:
    """Dataset for the custom chart kinds: Scatter (all rows on a grid; a
    sample of points if ``n`` is given), Histogram, Box, Violin, Line (grouped
    mean)."""
    k = kind.lower()
    if k == "scatter":
        return scatter_sample(df, x, y, color, **kw) if "n" in kw else scatter_bins(df, x, y, color, kw.get("bins", 40))
    if k == "histogram":
        return histogram(df, x, kw.get("bins", 40), color)
    if k == "box":
        return box_stats(df, y, color)
    if k == "violin":
        return violin_stats(df, y, color, kw.get("bins", 40))
    if k.startswith("line"):
        return grouped_mean(df, x, y, kw.get("grain"))
    raise ValueError(f"unknown chart kind {kind}")


def normalized_profile(profile_df: DataFrame, key: str, feats: list[str], eps: float = 1e-8,
                       digits: int = 4) -> DataFrame:
    """(x - min) / (max - min + eps) per feature across the rows of a small
    per-group profile (e.g. one row per cluster)."""
    rng = profile_df.agg(*[F.min(col(f)).alias(f"lo{i}") for i, f in enumerate(feats)],
                         *[F.max(col(f)).alias(f"hi{i}") for i, f in enumerate(feats)]).collect()[0]
    return profile_df.select(col(key), *[
        rnd((col(f) - F.lit(rng[f"lo{i}"])) / F.lit((rng[f"hi{i}"] or 0) - (rng[f"lo{i}"] or 0) + eps),
                digits).alias(f) for i, f in enumerate(feats)])
