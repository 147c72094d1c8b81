"""Preprocessing: imputation, scaling, one-hot encoding, constant-column
removal, univariate F scores and k-best selection (R1-R12).

Every step is fitted with one aggregation job (or the exact quantile
routine for medians) and applied as a lazy projection of built-in Column
expressions, so transforms stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import categorical_cols, col, is_missing, num, numeric_cols, pround, rnd
from tessera.functions.frames import explode_structs, multipass
from tessera.functions.quantiles import quantile_values
from tessera.operators.profile import distinct_upto
from tessera.operators.wide_onehot import fit_wide_onehot


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-missing value of each column, the smallest on
    ties.  (column, value) counts are a distributed aggregation with
    map-side combine; only per-column maxima meet in a small table."""
    if not cols:
        return {}
    tall = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), F.when(~is_missing(df, c), col(c).cast("string")).alias("v"))
        for i, c in enumerate(cols)])).alias("s")).select("s.ci", "s.v").where(F.col("v").isNotNull())
    counts = tall.groupBy("ci", "v").count()
    top = counts.groupBy("ci").agg(F.max("count").alias("mx"))
    best = (counts.join(F.broadcast(top), on="ci").where(F.col("count") == F.col("mx"))
            .groupBy("ci").agg(F.min("v").alias("v")))
    out = {}
    for r in best.collect():
        c = cols[r["ci"]]
        dt = df.schema[c].dataType
        out[c] = float(r["v"]) if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)) else (
            int(r["v"]) if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else r["v"])
    return out


def _numeric_modes(df: DataFrame, cols: list[str]) -> dict:
    from tessera.operators.stats import modes
    return {r["column"]: r["mode"] for r in modes(df, cols).collect()}


def impute_values(df: DataFrame, cols: list[str], strategy: str = "mean") -> dict:
    """Fill value per column for ``strategy`` in mean / median /
    most_frequent / constant (0 for numbers, "missing" for text)."""
    nums = [c for c in cols if c in numeric_cols(df)]
    cats = [c for c in cols if c not in nums]
    vals: dict = {}
    if strategy == "mean":
        if cats:
            raise ValueError("mean imputation needs numeric columns")
        row = df.agg(*[F.avg(num(df, c)).alias(f"m{i}") for i, c in enumerate(nums)]).collect()[0]
        vals = {c: row[f"m{i}"] for i, c in enumerate(nums)}
    elif strategy == "median":
        if cats:
            raise ValueError("median imputation needs numeric columns")
        qv, _ = quantile_values(df, nums, [0.5])
        vals = {c: qv[()][(c, 0.5)] for c in nums}
    elif strategy == "most_frequent":
        vals.update(_numeric_modes(df, nums) if nums else {})
        vals.update(column_modes(df, cats))
    elif strategy == "constant":
        vals = {c: 0 for c in nums}
        vals.update({c: "missing" for c in cats})
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return vals


def impute(df: DataFrame, cols: list[str], strategy: str = "mean") -> DataFrame:
    """Replace NULL/NaN in ``cols`` by the fitted fill value."""
    vals = impute_values(df, cols, strategy)
    out = []
    for c in df.columns:
        if c in vals and vals[c] is not None:
            if c in numeric_cols(df):
                out.append(F.coalesce(num(df, c), F.lit(float(vals[c]))).alias(c))
            else:
                dt = df.schema[c].dataType
                out.append(F.coalesce(col(c), F.lit(vals[c]).cast(dt)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def scaling_params(df: DataFrame, cols: list[str]) -> dict:
    """(mean, population std) per column; a zero std scales by 1."""
    row = df.agg(*[F.avg(num(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(num(df, c)).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m if m is not None else 0.0, s if s else 1.0)
    return out


def standard_scale(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(x - mean) / population std for ``cols`` (other columns kept)."""
    cols = cols or numeric_cols(df)
    p = scaling_params(df, cols)
    return df.select(*[((num(df, c) - F.lit(p[c][0])) / F.lit(p[c][1])).alias(c) if c in p else col(c)
                       for c in df.columns])


#: Levels of a column that may become columns of their own.
ONE_HOT_WIDTH = 1000


def one_hot(df: DataFrame, cols: list[str], max_width: int = ONE_HOT_WIDTH, keep_source: bool = False) -> DataFrame:
    """One 0/1 double column ``<col>_<value>`` per category (sorted, all
    kept; NULL becomes ``<col>_nan``).  The category count is checked
    against ``max_width`` before any column is built; ``wide_onehot`` codes
    columns of more levels."""
    widths = distinct_upto(df, cols, max_width)
    too_wide = [c for c, w in widths.items() if w > max_width]
    if too_wide:
        raise ValueError(f"one-hot width above {max_width} for {too_wide}")
    levels = {}
    rows = df.agg(*[F.sort_array(F.collect_set(col(c).cast("string"))).alias(f"l{i}")
                    for i, c in enumerate(cols)],
                  *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0]
    out = [col(c) for c in df.columns if keep_source or c not in cols]
    for i, c in enumerate(cols):
        levels[c] = rows[f"l{i}"]
        s = col(c).cast("string")
        for v in levels[c]:
            out.append(F.when(s == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}"))
        if rows[f"n{i}"]:
            out.append(F.when(col(c).isNull(), 1.0).otherwise(0.0).alias(f"{c}_nan"))
    return df.select(*out)


def variances(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[F.var_pop(num(df, c)).alias(f"v{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: row[f"v{i}"] for i, c in enumerate(cols)}


def drop_constant(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """Drop numeric columns whose population variance is not above
    ``threshold`` (all-missing columns too)."""
    cols = cols or numeric_cols(df)
    v = variances(df, cols)
    drop = {c for c in cols if v[c] is None or v[c] <= threshold}
    return df.select(*[col(c) for c in df.columns if c not in drop])


def f_classif(df: DataFrame, feats: list[str], target: str, digits: int | None = 3) -> DataFrame:
    """One-way ANOVA F per feature against class ``target``: (feature,
    score).  Per-class count / mean / M2 come from one grouped
    aggregation; the between / within ratio is a second aggregation over
    the per-class rows."""
    d = df.where(col(target).isNotNull())
    aggs = []
    for i, c in enumerate(feats):
        x = num(d, c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 (F.var_pop(x) * F.count(x)).alias(f"w{i}")]
    per = d.groupBy(col(target)).agg(*aggs)
    outs = []
    for i, c in enumerate(feats):
        n, m, w = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"w{i}")
        tot = F.sum(n)
        grand = F.try_divide(F.sum(n * m), tot)
        k = F.count_if(n > 0)
        outs.append(F.struct(F.lit(i).alias("__pos"), F.lit(c).alias("feature"),
                             F.sum(n).alias("__n"), F.sum(n * m).alias("__sx"),
                             F.sum(n * m * m).alias("__sxx"), F.sum(w).alias("__ssw"), k.alias("__k")))
    st = per.agg(*[o.alias(f"s{i}") for i, o in enumerate(outs)])
    tall = explode_structs(st, [F.col(f"s{i}") for i in range(len(feats))])
    grand = F.col("__sx") / F.col("__n")
    ssb = F.col("__sxx") - F.col("__n") * grand * grand
    between = F.try_divide(ssb, F.col("__k") - 1)
    within = F.try_divide(F.col("__ssw"), F.col("__n") - F.col("__k"))
    # classes that a feature separates perfectly have no spread within: infinite, unless nothing differs at all
    score = F.when((within == 0) & (between > 1e-12 * F.col("__sxx") / F.col("__n")), F.lit(float("inf"))).otherwise(
        F.try_divide(between, within))
    score = rnd(score, digits) if digits is not None else score
    return tall.select("__pos", "feature", score.alias("score"))


def f_regression(df: DataFrame, feats: list[str], target: str, digits: int | None = 3) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2) per feature against a numeric target."""
    from tessera.functions.moments import pearson
    y = num(df, target)
    row = df.agg(*[pearson(num(df, c), y).alias(f"r{i}") for i, c in enumerate(feats)],
                 *[F.count(F.when(num(df, c).isNotNull() & y.isNotNull(), 1)).alias(f"n{i}")
                   for i, c in enumerate(feats)])
    structs = []
    for i, c in enumerate(feats):
        r, n = F.col(f"r{i}"), F.col(f"n{i}")
        score = F.when((r * r >= 1) & (n > 2), F.lit(float("inf"))).otherwise(F.try_divide(r * r, 1 - r * r) * (n - 2))
        score = rnd(score, digits) if digits is not None else score
        structs.append(F.struct(F.lit(i).alias("__pos"), F.lit(c).alias("feature"), score.alias("score")))
    return explode_structs(row, structs)


def is_classification_target(df: DataFrame, target: str) -> bool:
    """Text target, or at most 20 distinct values."""
    if isinstance(df.schema[target].dataType, T.StringType):
        return True
    return distinct_upto(df, [target], 20)[target] <= 20


def feature_scores(df: DataFrame, feats: list[str], target: str, digits: int | None = 3) -> DataFrame:
    fn = f_classif if is_classification_target(df, target) else f_regression
    return fn(df, feats, target, digits)


def select_k_best(df: DataFrame, feats: list[str], target: str, k: int = 5):
    """(selected DataFrame, scores of kept features sorted descending).
    Highest unrounded scores win; among equal scores the later column (stable
    ascending sort, last k).  The table shows them rounded to 3 digits."""
    scores = feature_scores(df, feats, target, None).collect()
    k = min(k, len(feats))
    order = sorted(scores, key=lambda r: (float("-inf") if r["score"] is None else r["score"], r["__pos"]))
    kept = {r["feature"] for r in order[len(order) - k:]}
    keep_cols = [c for c in feats if c in kept]
    sel = df.select(*[col(c) for c in keep_cols], *[col(c) for c in df.columns if c not in feats])
    sc = df.sparkSession.createDataFrame(
        [(r["feature"], pround(r["score"], 3)) for r in scores if r["feature"] in kept], "feature string, score double"
    ).orderBy(F.col("score").desc_nulls_last(), "feature")
    return sel, sc


def preprocess(df: DataFrame, target: str | None = None, remove_dups: bool = True,
               impute_num: bool = True, impute_cat: bool = True, scale: bool = True,
               encode: bool = True, var_thresh: bool = True, feat_select: bool = False,
               k_best: int = 5, num_strategy: str = "mean", cat_strategy: str = "most_frequent") -> DataFrame:
    """Column transformer: numeric features (impute, scale) then
    categorical features (impute, one-hot); optional constant removal and
    k-best selection; the target column stays in each row.  Columns keep
    their real names (categoricals pass through unchanged when they have
    no step).  Categoricals of more than ``ONE_HOT_WIDTH`` levels become one
    sparse vector column ``onehot`` (see ``wide_onehot``)."""
    work = df.dropDuplicates() if remove_dups else df
    feat_num = [c for c in numeric_cols(work) if c != target]
    feat_cat = [c for c in categorical_cols(work) if c != target]
    if impute_num and feat_num:
        work = impute(work, feat_num, num_strategy)
    if scale and feat_num:
        work = standard_scale(work, feat_num)
    if impute_cat and feat_cat:
        work = impute(work, feat_cat, cat_strategy if cat_strategy != "constant" else "constant")
    out_cols = list(feat_num)
    if encode and feat_cat:
        work = work.select(*[col(c) for c in feat_num + feat_cat + ([target] if target else [])])
        widths = distinct_upto(work, feat_cat, ONE_HOT_WIDTH)
        wide = [c for c in feat_cat if widths[c] > ONE_HOT_WIDTH]
        if len(wide) < len(feat_cat):
            work = one_hot(work, [c for c in feat_cat if c not in wide])
        if wide:
            work = fit_wide_onehot(work, wide).transform(work, "onehot")
        out_cols += [c for c in work.columns if c not in feat_num and c != target]
    else:
        out_cols += feat_cat
    work = work.select(*[col(c) for c in out_cols + ([target] if target else [])])
    if var_thresh:
        numeric_out = [c for c in out_cols if c in numeric_cols(work)]
        v = variances(work, numeric_out)
        out_cols = [c for c in out_cols if c not in v or (v[c] is not None and v[c] > 0)]
        work = work.select(*[col(c) for c in out_cols + ([target] if target else [])])
    if feat_select and target:
        numeric_out = [c for c in out_cols if c in numeric_cols(work)]
        work, _ = select_k_best(work, numeric_out, target, k_best)
    return work
