"""ProfileFrame: metadata columns plus one ``features array<double>`` column and its name list."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from phenospark.operators.relational import infer_columns, numeric_columns


@dataclass(frozen=True)
class ProfileFrame:
    """Rows with a unique ``id_col``, metadata columns, and a fixed-length feature array.

    The array keeps plans short when there are thousands of features. Three views are cheap to
    reach: wide (one column per feature), array, and long (row, idx, value).
    """

    df: DataFrame
    names: tuple[str, ...]
    id_col: str = "row_id"

    @classmethod
    def from_wide(cls, df: DataFrame, names: Sequence[str] | None = None, id_col: str = "row_id") -> "ProfileFrame":
        """Numeric non-metadata columns become the feature array; other columns become metadata."""
        if names is None:
            candidates, _ = infer_columns(df)
            names = [c for c in numeric_columns(df, candidates) if c != id_col]
        rest = [c for c in df.columns if c not in names]
        vector = F.array(*[F.col(c).cast("double") for c in names]).alias("features")
        return cls(df.select(*rest, vector), tuple(names), id_col)

    @property
    def meta(self) -> list[str]:
        return [c for c in self.df.columns if c != "features"]

    @property
    def width(self) -> int:
        return len(self.names)

    def wide(self) -> DataFrame:
        return self.df.select(*self.meta, *[F.col("features")[i].alias(n) for i, n in enumerate(self.names)])

    def long(self, *keep: str, value: str = "value", finite: bool = True) -> DataFrame:
        """(keep..., idx, value); non-finite values become NULL so that aggregates skip them."""
        out = self.df.select(*keep, F.posexplode("features").alias("idx", value))
        return out.withColumn(value, finite_or_null(F.col(value))) if finite else out

    def select(self, keep: Sequence[str]) -> "ProfileFrame":
        """Keep the named features, in the current order."""
        wanted = set(keep)
        idx = [i for i, n in enumerate(self.names) if n in wanted]
        if len(idx) == self.width:
            return self
        picked = F.transform(F.array(*[F.lit(i) for i in idx]), lambda i: F.get(F.col("features"), i))
        return replace(self, df=self.df.withColumn("features", picked), names=tuple(self.names[i] for i in idx))

    def with_df(self, df: DataFrame) -> "ProfileFrame":
        return replace(self, df=df)

    def map_features(self, fn: Callable[[Column], Column]) -> "ProfileFrame":
        return replace(self, df=self.df.withColumn("features", fn(F.col("features"))))


def is_bad(x: Column) -> Column:
    """NULL, NaN or infinite."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def assemble(long: DataFrame, keys: Sequence[str], value_cols: Sequence[str], idx: str = "idx") -> DataFrame:
    """Per key, arrays ordered by feature position. Group size is the feature count, not the rows."""
    packed = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(idx, *value_cols))).alias("_p"))
    pick = lambda c: F.transform("_p", lambda s: s[c])
    return packed.select(*keys, *[pick(c).alias(c) for c in value_cols])
