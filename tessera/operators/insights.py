"""Findings report (I1-I10): a table of rules over measures.

A *measure* is a small table of (subject, value) that one of the distributed
operators gives: null shares by column, the duplicate share, outlier shares,
adjusted skewness, correlated pairs, class counts, means of recognised
variables. A *rule* names a measure, a threshold, how its subjects are to be
reported, and a sentence. ``insights`` evaluates the rules in order; whatever
the input's size, a measure has at most a row a column or a pair of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, find_col, num, numeric_cols, pround
from tessera.functions.moments import adj_skew
from tessera.operators import profile as P
from tessera.operators import quality as Q
from tessera.operators import stats as S

# Keyword groups used to find the variables the notes describe.
TEMP_KW = ["temp", "temperature"]
HUMID_KW = ["humidity", "humid"]
RAIN_KW = ["rain", "rainfall", "precipitation"]
PRESSURE_KW = ["pressure", "baro"]
SEASON_KW = ["season", "month", "date", "year", "quarter"]

SECTIONS = ["observations", "warnings", "notes", "recommendations"]
SCHEMA = "section string, rank int, code string, message string, value double"


@dataclass(frozen=True)
class Rule:
    """``mode``: 'some' reports once how many subjects are above the threshold,
    'none' that no subject is, 'each' every subject above it (at most
    ``limit``), 'first' the first subject with its value."""

    section: str
    code: str
    measure: str
    mode: str
    above: float
    text: str
    upto: float = float("inf")
    limit: int | None = None

    def apply(self, measures: dict[str, list]) -> list[tuple]:
        if self.measure not in measures:
            return []
        hits = [(s, v) for s, v in measures[self.measure] if v is not None and self.above < abs(v) <= self.upto]
        names = ", ".join(str(s) for s, _ in hits[:5]) + (", ..." if len(hits) > 5 else "")
        if self.mode == "none":
            return [] if hits else [(self.code, self.text, None)]
        if not hits:
            return []
        if self.mode == "some":
            return [(self.code, self.text.format(n=len(hits), names=names), float(len(hits)))]
        chosen = hits[:1] if self.mode == "first" else hits[:self.limit]
        return [(self.code, self.text.format(name=s, value=v, n=len(hits)), float(v)) for s, v in chosen]


ANY = -1.0
RULES = [
    Rule("observations", "size", "rows", "first", ANY, "{value:,.0f} rows in {name}"),
    Rule("warnings", "missing", "null_pct", "some", 0, "{n} columns lack some values: {names}"),
    Rule("warnings", "missing_high", "null_pct", "some", 30, "Over 30% of the values are absent in: {names}"),
    Rule("recommendations", "missing_drop", "null_pct_worst", "first", 30,
         "Column {name} is the emptiest; leave out columns that are mostly empty and fill the rest from similar rows"),
    Rule("recommendations", "missing_median", "null_pct_worst", "first", 0, "Fill the gaps with each column's median", upto=30),
    Rule("observations", "missing_none", "null_pct", "none", 0, "Every cell has a value"),
    Rule("warnings", "duplicates", "duplicate_rows", "first", 0, "{value:,.0f} rows repeat an earlier one ({name} of all); remove them before fitting"),
    Rule("observations", "duplicates_none", "duplicate_rows", "none", 0, "No row occurs twice"),
    Rule("observations", "target", "classes", "first", 0, "{name}"),
    Rule("warnings", "imbalance_severe", "class_ratio", "first", 5,
         "The largest class of {name} has {value:.1f} times the rows of the smallest; weight or resample"),
    Rule("warnings", "imbalance_moderate", "class_ratio", "first", 2, "Class sizes of {name} differ by a factor of {value:.1f}", upto=5),
    Rule("observations", "balanced", "class_ratio", "first", 0, "Class sizes of {name} are alike (factor {value:.1f})", upto=2),
    Rule("notes", "temperature", "temperature", "first", ANY, "Temperature column {name}, {value:.1f} on average"),
    Rule("notes", "temperature_skew", "temperature_skew", "first", 1, "{name} has a long tail (skewness {value:.2f}); a power transform may help"),
    Rule("notes", "humidity", "humidity", "first", ANY, "Humidity column {name}, {value:.1f}% on average"),
    Rule("notes", "rainfall", "rainfall", "first", ANY, "Rainfall column {name}, {value:.2f} on average"),
    Rule("notes", "dry", "dry_pct", "first", 60, "{name} is zero in {value:.1f}% of its rows: a dry climate or season"),
    Rule("notes", "pressure", "pressure", "first", ANY, "Pressure column {name}, {value:.1f} on average"),
    Rule("notes", "season", "season", "first", ANY, "{name} can serve as the time axis of grouped trends"),
    Rule("warnings", "high_corr", "abs_r", "some", 0.80, "{n} pairs of columns move together (|r| above 0.80)"),
    Rule("warnings", "high_corr_pair", "abs_r", "each", 0.80, "{name}: r = {value:.3f}", limit=5),
    Rule("recommendations", "merge_corr", "abs_r", "first", 0.80, "Keep one column of each such pair, or replace them by components ({n} pairs)"),
    Rule("warnings", "outliers", "outlier_pct", "some", 5, "Over 5% of the values lie beyond the whiskers in: {names}"),
    Rule("recommendations", "robust", "outlier_pct", "first", 5, "Scale by median and quartiles, or clip, where outliers are many"),
    Rule("observations", "outliers_ok", "outlier_pct", "none", 5, "At most 5% of any column lies beyond its whiskers"),
    Rule("observations", "skewed", "skewness", "some", 1, "{n} columns are clearly asymmetric: {names}"),
    Rule("recommendations", "transform", "skewness", "first", 1, "Bring asymmetric columns closer to symmetry with logarithms or powers"),
    Rule("recommendations", "dimensionality", "columns", "first", 30, "{value:.0f} columns are many; select the best or project them"),
    Rule("recommendations", "models", "classes", "first", 0, "Compare tree ensembles, a kernel machine and a linear model on the classes"),
    Rule("recommendations", "analyses", "classes", "first", 0,
         "Look at components, discriminant axes, clusters and latent factors"),
]


def measures(df: DataFrame, target: str | None = None) -> dict[str, list]:
    """Measure name -> [(subject, value)]. No measure grows with the rows."""
    nums, out = numeric_cols(df), {}
    prof = P.profile(df).collect()
    rows = prof[0]["non_null"] + prof[0]["nulls"] if prof else 0
    size = df.agg(F.count(F.lit(1)).alias("n")).first()["n"] if not prof else rows
    out["rows"] = [(f"{len(df.columns)} columns", size)]
    out["columns"] = [("columns", len(df.columns))]
    out["null_pct"] = [(r["column"], 100.0 * r["nulls"] / rows if rows else 0.0) for r in prof]
    out["null_pct_worst"] = sorted(out["null_pct"], key=lambda x: -x[1])[:1]
    dup = Q.duplicate_count(df).first()["duplicate_rows"] or 0
    out["duplicate_rows"] = [(f"{pround(100.0 * dup / size, 2) if size else 0}%", dup)]
    if target:
        top = P.class_counts(df, target, 6).collect()
        stat = S.class_imbalance(df, target).first()
        if stat["n_classes"]:
            out["classes"] = [(f"{stat['n_classes']} classes in {target}, the largest: " + ", ".join(str(r[target]) for r in top), stat["n_classes"])]
        if stat["n_classes"] >= 2:
            out["class_ratio"] = [(target, stat["max_count"] / stat["min_count"])]
    out |= _variables(df, nums)
    if len(nums) >= 2:
        out["abs_r"] = [(f"{r['feature_a']} and {r['feature_b']}", r["correlation"])
                        for r in S.corr_pairs(df, nums, n=None, min_abs=0.80, digits=6).collect()]
    if nums:
        out["outlier_pct"] = [(r["column"], 100.0 * r["outliers"] / r["n"] if r["n"] else None) for r in _outliers(df, nums, prof)]
        skew = df.agg(*[adj_skew(num(df, c)).alias(f"k{i}") for i, c in enumerate(nums)]).first()
        out["skewness"] = [(c, skew[f"k{i}"]) for i, c in enumerate(nums)]
    return out


def _outliers(df: DataFrame, nums: list[str], prof: list) -> list[dict]:
    counted = {r["column"]: r["non_null"] for r in prof}
    return [{"column": r["column"], "outliers": r["outliers"], "n": counted[r["column"]]} for r in Q.iqr_outliers(df, nums).collect()]


def _variables(df: DataFrame, nums: list[str]) -> dict[str, list]:
    """Means, spreads, skewness and zero shares of the variables that keywords find, in one pass."""
    found = {k: find_col(df, kw) for k, kw in (("temperature", TEMP_KW), ("humidity", HUMID_KW), ("rainfall", RAIN_KW), ("pressure", PRESSURE_KW))}
    found = {k: c for k, c in found.items() if c in nums}
    season, out = find_col(df, SEASON_KW), {}
    if season and nums:
        out["season"] = [(season, 0)]
    if not found:
        return out
    row = df.agg(*[f.alias(f"{k}_{s}") for k, c in found.items() for s, f in (
        ("mean", F.avg(num(df, c))), ("skew", adj_skew(num(df, c))), ("std", F.stddev_samp(num(df, c))),
        ("min", F.min(num(df, c))), ("max", F.max(num(df, c))),
        ("zero", F.try_divide(F.count_if(num(df, c) == 0) * 100.0, F.count(num(df, c)))))]).first()
    out |= {k: [(c, row[f"{k}_mean"])] for k, c in found.items()}
    if "temperature" in found and row["temperature_std"] is not None:
        spread = f"standard deviation {row['temperature_std']:.1f}, from {row['temperature_min']:.1f} to {row['temperature_max']:.1f}"
        out["temperature"] = [(f"{found['temperature']} ({spread})", row["temperature_mean"])]
    if "temperature" in found:
        out["temperature_skew"] = [(found["temperature"], row["temperature_skew"])]
    if "rainfall" in found:
        out["dry_pct"] = [(found["rainfall"], row["rainfall_zero"])]
    return out


def insights(df: DataFrame, target: str | None = None) -> DataFrame:
    """(section, rank, code, message, value): the rules' findings in report order."""
    found = measures(df, target or P.detect_target(df))
    rows = []
    for section in SECTIONS:
        said = [f for r in RULES if r.section == section for f in r.apply(found)]
        rows += [(section, i, code, text, pround(value, 4)) for i, (code, text, value) in enumerate(said, 1)]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def insights_text(report: DataFrame) -> DataFrame:
    """The report as text lines (``value``), a heading a section and a line a finding."""
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), col("section"))
    lines = (report.select(place.alias("s"), "rank", F.concat(F.lit("- "), "message").alias("value"))
             .union(report.sparkSession.createDataFrame(
                 [(i, r, v) for i, s in enumerate(SECTIONS, 1) for r, v in ((-1, f"### {s.capitalize()}"), (1 << 30, ""))]
                 + [(0, 0, "## Findings"), (0, 1, "")], "s long, rank int, value string")))
    return lines.orderBy("s", "rank").select("value")
