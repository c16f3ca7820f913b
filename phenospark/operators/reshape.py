"""Long measurement files to wide rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


#: Objects that only object measurements have.
CELL_OBJECTS = ("cell", "nuclei")


def detect_layout(columns: Sequence[str], objects: Sequence[str] = ()) -> str:
    """'wide' without a metric column; else object-measurement ('cp_long') or embedding ('dl_long') rows."""
    if "metric" not in columns:
        return "wide"
    return "cp_long" if set(CELL_OBJECTS) & set(objects) else "dl_long"


def value_column(schema) -> tuple[str, bool]:
    """(name of the value column, whether it is a list that must be exploded)."""
    names = {f.name: f.dataType.typeName() for f in schema}
    col = "values" if "values" in names else "value"
    return col, names[col] == "array"


def explode_values(df: DataFrame, col: str = "values", out: str = "value") -> DataFrame:
    return df.withColumn(out, F.explode(col)).drop(*([col] if col != out else []))


def well_medians(eav: DataFrame, well: Sequence[str], name: Column, value: str = "value", **kw) -> DataFrame:
    """Median per (well, feature name) as long rows."""
    from phenospark.operators.aggregate import group_median

    named = eav.select(*well, name.alias("feature"), value)
    return group_median(named, [*well, "feature"], value, "value", **kw)


def pivot_features(cells: DataFrame, rows: Sequence[str], names: Sequence[str] | None = None,
                   name: str = "feature", value: str = "value") -> DataFrame:
    """One column per feature. Give the names when known; otherwise one small job lists them."""
    if names is None:
        names = [r[0] for r in cells.select(name).distinct().orderBy(name).collect()]
    return cells.groupBy(*rows).pivot(name, list(names)).agg(F.first(value))


def long_to_wells(eav: DataFrame, well: Sequence[str], name: Column, names: Sequence[str] | None = None,
                  value: str = "value", objects: Sequence[str] = ("cell", "nuclei"), label: str = "label",
                  per_site: Sequence[str] = (), **kw) -> DataFrame:
    """Long measurements to one wide row per well plus distinct object counts.

    Objects are counted by label within the well; give ``per_site`` columns when labels restart per site.
    """
    wide = pivot_features(well_medians(eav, well, name, value, **kw), well, names)
    ident = F.struct(*per_site, label) if per_site else F.col(label)
    counts = eav.groupBy(*well).agg(
        *[F.countDistinct(F.when(F.col("object") == o, ident)).alias(f"n_{o}") for o in objects])
    return wide.join(counts, list(well))


def wide_to_wells(df: DataFrame, well: Sequence[str], drop: Sequence[str] = ("tile", "label", "filename", "tp", "site")) -> DataFrame:
    """Mean of every remaining numeric column per well."""
    from phenospark.operators.relational import numeric_columns

    cols = [c for c in numeric_columns(df) if c not in well and c not in drop]
    return df.groupBy(*well).agg(*[F.avg(c).alias(c) for c in cols])


def bounding_boxes(eav: DataFrame, site: Sequence[str], label: str, metric: str, value: str,
                   x_metric: str, y_metric: str) -> DataFrame:
    pick = lambda m: F.max(F.when(F.col(metric) == m, F.col(value)))
    return (eav.filter(F.col(metric).isin(x_metric, y_metric)).groupBy(*site, label)
            .agg(pick(x_metric).alias("x_max"), pick(y_metric).alias("y_max")))


def interior_objects(eav: DataFrame, site: Sequence[str], label: str, metric: str, value: str,
                     x_metric: str, y_metric: str) -> DataFrame:
    """Objects whose box lies strictly inside the extent of their site."""
    boxes = bounding_boxes(eav, site, label, metric, value, x_metric, y_metric)
    extent = boxes.groupBy(*site).agg(F.max("x_max").alias("_w"), F.max("y_max").alias("_h"))
    return (boxes.join(extent, list(site)).filter((F.col("x_max") < F.col("_w")) & (F.col("y_max") < F.col("_h")))
            .select(*site, label))


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns to rows; NULL cells are left out."""
    return df.unpivot(list(ids), list(cols), name, value).filter(F.col(value).isNotNull())


def expand_channels(df: DataFrame, ids: Sequence[str], channels: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per channel in the given order, NULL cells kept, in a single pass."""
    rows = F.array(*[F.struct(F.lit(i).alias("channel_order"), F.lit(c).alias(name), F.col(c).alias(value))
                     for i, c in enumerate(channels)])
    return df.select(*ids, F.inline(rows))


def explode_targets(df: DataFrame, col: str, out: str = "target", sep: str = "|") -> DataFrame:
    """One row per non-empty element of a separated list."""
    parts = F.transform(F.split(F.col(col), "[" + sep + "]"), F.trim)
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode(parts).alias(out)).filter(F.col(out) != "").distinct()


def concat_diagonal(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def flatten_groups(df: DataFrame, ids: Sequence[str], groups: str, prefix: str, group_names: Sequence[str],
                   stats: Sequence[str]) -> DataFrame:
    """A map column group -> struct of statistics becomes ``prefix_group_stat`` columns."""
    cols = [F.col(groups)[g][s].alias(f"{prefix}_{g}_{s}") for g in group_names for s in stats]
    return df.select(*ids, *cols)
