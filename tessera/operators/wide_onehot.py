"""One-hot codes of columns with any number of levels.

The dictionary (column, level, place) is a distributed table numbered by a total order;
codes are joined to the rows, by broadcast only where the dictionary is short.  A row's
code is the places of its ones, or a sparse vector of as many entries as there are levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.functions.frames import stored
from tessera.functions.ranking import positions, small


@dataclass
class WideOneHot:
    cols: list[str]
    levels: DataFrame           # ci, level (as text), place within the column
    widths: list[int]

    @property
    def size(self) -> int:
        return sum(self.widths)

    def dictionary(self) -> DataFrame:
        """(place, column, level, feature): entry ``place`` of the vector is 1 where
        ``column`` is ``level``; the feature of NULL is ``<column>_nan``."""
        start = [sum(self.widths[:i]) for i in range(len(self.cols))]
        name = F.element_at(F.array(*[F.lit(c) for c in self.cols]), F.col("ci") + 1)
        return self.levels.select((F.element_at(F.array(*[F.lit(s).cast("long") for s in start]), F.col("ci") + 1) + F.col("place")).alias("place"),
                                  name.alias("column"), "level", F.concat(name, F.lit("_"), F.coalesce("level", F.lit("nan"))).alias("feature"))

    def _coded(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """``df`` with each column's place, NULL for a level that the fit has not met."""
        codes, out = [], df
        for i, c in enumerate(self.cols):
            code, level = _free(df, f"__code{i}"), _free(df, f"__level{i}")
            own = self.levels.where(F.col("ci") == i).select(F.col("level").alias(level), F.col("place").alias(code))
            out = out.join(small(own, self.widths[i]), col(c).cast("string").eqNullSafe(F.col(level)), "left").drop(level)
            codes.append(code)
        return out, codes

    def places(self, df: DataFrame, name: str = "onehot") -> DataFrame:
        """Instead of the coded columns, ``name``: the ascending places of the row's ones
        (array of long; a level that the fit has not met has none)."""
        out, codes = self._coded(df)
        start = [sum(self.widths[:i]) for i in range(len(self.cols))]
        ones = F.array_compact(F.array(*[F.col(c) + F.lit(s).cast("long") for c, s in zip(codes, start)]))
        return out.select(*[col(c) for c in df.columns if c not in self.cols], ones.alias(name))

    def transform(self, df: DataFrame, name: str = "onehot") -> DataFrame:
        """Instead of the coded columns, ``name``: a sparse vector with ``size`` entries."""
        out, codes = self._coded(df)
        keep = [col(c) for c in df.columns if c not in self.cols]
        if not self.size:
            return out.select(*keep, array_to_vector(F.array().cast("array<double>")).alias(name))
        # an unknown level is a further category, the one that the encoder drops
        marked = [F.coalesce(F.col(c), F.lit(w)).cast("double").alias(c, metadata={"ml_attr": {"type": "nominal", "num_vals": w + 1, "name": c}})
                  for c, w in zip(codes, self.widths)]
        out = out.select(*keep, *marked)
        parts = [_free(df, f"__part{i}") for i in range(len(codes))]
        coded = OneHotEncoder(inputCols=codes, outputCols=parts, dropLast=True).fit(out).transform(out)
        return (VectorAssembler(inputCols=parts, outputCol=name).transform(coded.select(*keep, *parts))
                .select(*keep, name))


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fit_wide_onehot(df: DataFrame, cols: list[str]) -> WideOneHot:
    """Levels of ``cols`` in ascending order of their text, NULL last (a level of its own where
    it occurs). Equal values merge in the map tasks; no level comes to the driver. An
    empty table has no levels, and codes nothing."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), col(c).cast("string").alias("level")) for i, c in enumerate(cols)])).alias("s"))
    found = tall.select("s.*").distinct().withColumn("w", F.lit(1).cast("long"))
    at = positions(found, [F.col("ci"), F.col("level").asc_nulls_last()], "w")
    count = {r["ci"]: r["n"] for r in at.groupBy("ci").agg(F.count(F.lit(1)).alias("n")).collect()}
    widths = [count.get(i, 0) for i in range(len(cols))]
    start = F.element_at(F.array(*[F.lit(sum(widths[:i])).cast("long") for i in range(len(cols))]), F.col("ci") + 1)
    return WideOneHot(list(cols), stored(at.select("ci", "level", (F.col("__before") - start).alias("place")), "levels"), widths)
