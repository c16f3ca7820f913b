"""Parsing of feature, model and configuration names as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Model families; a name belongs to the longest prefix it starts with.
MODEL_FAMILIES = (
    "cellprofiler", "openphenom", "openphenom_stdscale", "openphenom_stdscale_false", "openphenom_nonclip",
    "openphenom_8clip_std", "morphem", "subcell", "subcell_wrongchannels", "subcell__clip01", "subcell__nonstd",
    "subcell_nonstd", "cell_count", "dinov2", "dinov2_490", "dinov2_random",
)

# Feature name starts and parts by measurement group.
TEXTURE_STARTS = ("AngularSecondMoment", "Contrast", "Correlation", "DifferenceEntropy", "DifferenceVariance", "Entropy",
                  "InfoMeas1", "InfoMeas2", "InverseDifferenceMoment", "SumAverage", "SumEntropy", "SumVariance", "Variance")
INTENSITY_PARTS = ("IntegratedIntensity", "MeanIntensity", "StdIntensity", "MaxIntensity", "MinIntensity", "MedianIntensity",
                   "MADIntensity", "MassDisplacement", "LowerQuartileIntensity", "UpperQuartileIntensity", "Location_Center",
                   "Location_Max")
RADIAL_STARTS = ("FracAtD", "MeanFrac", "RadialCV")
SHAPE_STARTS = ("Area", "Perimeter", "FormFactor", "Solidity", "Extent", "Eccentricity", "MajorAxisLength", "MinorAxisLength",
                "Orientation", "Compactness", "EulerNumber", "Center_X", "Center_Y", "BoundingBox", "EquivalentDiameter",
                "ConvexArea", "MaxFeretDiameter", "MinFeretDiameter", "MaximumRadius", "MeanRadius", "MedianRadius",
                "MinimumRadius", "Moment", "InertiaTensor")
MOMENT_STARTS = ("CentralMoment", "HuMoment", "NormalizedMoment", "SpatialMoment", "InertiaTensor")
EXCLUDED_MOMENTS = ("InertiaTensor_", "InertiaTensorEigenvalues_", "SpatialMoment_", "HuMoment_", "CentralMoment_", "NormalizedMoment_")

# Names of compartments, channels and feature types in the two naming schemes.
COMPARTMENTS = {"cell": "Cells", "nuclei": "Nuclei", "cytoplasm": "Cytoplasm"}
CHANNELS = {"0": "DNA", "1": "AGP", "2": "Mito", "3": "RNA", "4": "ER"}
SHAPE_TYPES = ("sizeshape", "ferret", "feret", "zernike")
CATEGORIES = {
    "sizeshape": "AreaShape",
    "ferret": "AreaShape",
    "feret": "AreaShape",
    "zernike": "AreaShape",
    "intensity": "Intensity",
    "radial_distribution": "RadialDistribution",
    "radial_zernikes": "RadialDistribution",
    "texture": "Texture",
    "correlation": "Correlation",
    "granularity": "Granularity",
    "neighbors": "Neighbors",
}


def _starts(words: Sequence[str]) -> str:
    return "^(" + "|".join(words) + ")"


def family(name: Column, families: Sequence[str] = MODEL_FAMILIES) -> Column:
    """Longest family prefix of the lower-cased name."""
    lowered = F.lower(name)
    out = F
    for f in sorted(families, key=len, reverse=True):
        out = out.when(lowered.startswith(f), f)
    return out.otherwise(None)


def short_model_name(folder: Column, datasets: Mapping[str, str], unprefixed: Sequence[str] = (), suffix: str = "_features") -> Column:
    """``<model>_<dataset>_<codec>_features`` to ``<model><tag>_<codec>``.

    ``datasets`` maps the dataset part of the name to the tag kept for it; models in ``unprefixed`` are left out.
    """
    out = F
    for dataset, label in sorted(datasets.items(), key=lambda kv: -len(kv[0])):
        mark = f"_{dataset}_"
        at = F.locate(mark, folder)
        model = F.substring(folder, F.lit(1), at - 1)
        codec = F.regexp_replace(F.substring(folder, at + len(mark), F.length(folder)), suffix + "$", "")
        short = F.when(model.isin(list(unprefixed)), codec).otherwise(F.concat(model, F.lit(label + "_"), codec))
        out = out.when(at > 0, short)
    return out.otherwise(folder)


def feature_group(name: Column) -> Column:
    """Measurement group of a feature; a channel digit in front is ignored."""
    base = F.regexp_replace(name, "^[0-9]_(?=.)", "")
    return (F.when(base.rlike(_starts(TEXTURE_STARTS)), "Texture")
            .when(base.rlike("|".join(INTENSITY_PARTS)), "Intensity")
            .when(base.contains("RadialDistribution") | base.rlike(_starts(RADIAL_STARTS)), "RadialDistribution")
            .when(base.contains("Zernike"), "Zernike").when(base.startswith("Granularity"), "Granularity")
            .when(base.rlike(_starts(SHAPE_STARTS)), "SizeShape").otherwise("Other"))


def feature_subcategory(name: Column) -> Column:
    """Finer label: order of a Zernike term, kind of a radial measure, or the leading word."""
    order = F.regexp_extract(name, r"_([0-9]+_[0-9]+)$", 1)
    zernike = F.when(order != "", order).otherwise("Zernike")
    radial = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^radial_", ""), r"_[0-9]+_[0-9]+$", ""), r"_[0-9]+of[0-9]+$", "")
    rest = F.regexp_extract(name, "^[a-z]+([A-Z].*)", 1)
    moment = F.regexp_extract(rest, _starts(MOMENT_STARTS), 1)
    word = F.regexp_extract(rest, "^([A-Z][a-zA-Z]*)", 1)
    return (F.when(name.isNull(), "Unknown").when(name.startswith("zernike") & name.contains("Zernike"), zernike)
            .when(name.startswith("radial_"), radial).when(moment != "", moment).when(word != "", word).otherwise(name))


# ---- configuration names ---------------------------------------------------------------------------

def parse_config(name: Column) -> Column:
    """Settings encoded in a configuration name as one struct.

    Parts are separated by double underscores; each starts with its method, its settings follow.
    """
    parts = F.split(name, "__")

    def part(*starts: str) -> Column:
        hit = F.filter(parts, lambda p: p.rlike(_starts(starts)))
        return F.try_element_at(hit, F.lit(-1))

    def number(text: Column, pattern: str, kind: str) -> Column:
        return F.expr("NULL").cast(kind) if text is None else F.regexp_extract(text, pattern, 1).try_cast(kind)

    norm = part("robustmad", "std")
    outlier, prune, pca = part("outlier"), part("prune"), part("pca")
    original, aligned, cascade = part("tvn_original"), part("tvn_efaar"), part("cascade_tvn")
    white = part("ZCA-cor_")
    batch = part("tvn_original", "tvn_efaar", "cascade_tvn", "ZCA-cor_")
    is_global = white.startswith("ZCA-cor_global_")
    eps_text = F.regexp_extract(white, r"_e([0-9.]+)$", 1)
    eps = eps_text.try_cast("double")
    # A whole number from 2 on is an exponent: e6 is 1e-6; otherwise the number itself: e0.5.
    epsilon = F.when(~eps_text.contains(".") & (eps >= 2), F.pow(F.lit(10.0), -eps)).otherwise(eps)
    fit = F.regexp_extract(white, r"^ZCA-cor_(?:global_)?(.*)_e[^_]*$", 1)
    components = number(aligned, r"_e[0-9.]+_c([0-9]+)$", "int")
    aligned_eps = number(aligned, r"_e([0-9.]+)(?:_c[0-9]+)?$", "double")
    return F.struct(
        F.when(norm.startswith("robustmad"), "robustmad").when(norm.startswith("std"), "standardize").otherwise("unknown").alias("norm_method"),
        number(outlier, r"^outlier([0-9]+)$", "int").alias("outlier_cutoff"),
        F.array_contains(parts, "INT").alias("use_int"),
        number(prune, r"^prune([0-9.]+)$", "double").alias("prune_thresh"),
        pca.isNotNull().alias("use_pca"),
        number(pca, r"^pca([0-9]+)$", "int").alias("pca_components"),
        F.when(batch.startswith("ZCA-cor_global_"), "spherize_global").when(batch.startswith("ZCA-cor_"), "spherize")
        .when(batch.startswith("tvn_original"), "tvn_original").when(batch.startswith("tvn_efaar"), "tvn_efaar")
        .when(batch.startswith("cascade_tvn"), "cascade_tvn").otherwise("none").alias("batch_method"),
        F.when(is_global | white.isNotNull(), F.when(fit != "", fit)).alias("spherize_fit"),
        F.when(white.isNotNull(), epsilon).alias("spherize_epsilon"),
        aligned_eps.alias("tvn_epsilon"),
        number(original, r"_k([0-9]+)$", "int").alias("tvn_original_k"),
        F.when(aligned_eps.isNotNull(), F.coalesce(components, F.lit(128))).alias("tvn_efaar_n_components"),
        number(cascade, r"_k([0-9]+)_k[0-9]+$", "int").alias("tvn_cascade_k1"),
        number(cascade, r"_k[0-9]+_k([0-9]+)$", "int").alias("tvn_cascade_k2"),
    )


# ---- mapping between the two feature naming schemes ------------------------------------------------

def canonical_feature(name: Column) -> Column:
    """``cell_0/max/textureContrast_3_00`` to ``Cells_Texture_Contrast_DNA_3_00``; NULL when no rule applies."""
    pieces = F.split(name, "/")
    compartment = F.regexp_extract(pieces[0], "^(.*)_([^_]*)$", 1)
    channel = F.regexp_extract(pieces[0], "^(.*)_([^_]*)$", 2)
    lookup = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    comp, chan = lookup(COMPARTMENTS, compartment), lookup(CHANNELS, channel)
    full = F.get(pieces, F.lit(2))
    kind = F.regexp_extract(full, _starts(sorted(CATEGORIES, key=len, reverse=True)), 1)
    category = lookup(CATEGORIES, kind)
    rest = F.substring(full, F.length(kind) + 1, F.length(full))
    bare = F.regexp_replace(rest, F.concat(F.lit("^"), category, F.lit("_?")), F.lit(""))
    # Parameters start at the first part that begins with a digit or holds "of"; the channel goes in front of them.
    base = F.regexp_extract(bare, r"^(.*?)(?:_((?:[0-9]|[^_]*of).*))?$", 1)
    params = F.regexp_extract(bare, r"^(.*?)(?:_((?:[0-9]|[^_]*of).*))?$", 2)
    placed = F.concat_ws("_", comp, category, base, chan, F.when(params != "", params))
    location = F.concat_ws("_", comp, F.lit("Location"), F.regexp_replace(rest, "^Location_?", ""), chan)
    shape = F.concat_ws("_", comp, category, rest)
    out = (F.when(kind.isin(*SHAPE_TYPES), shape)
           .when((kind == "intensity") & rest.startswith("Location"), F.when(chan.isNotNull(), location))
           .when(kind == "intensity", F.when(chan.isNotNull(), F.concat_ws("_", comp, category, bare, chan)))
           .when(kind.isin("radial_distribution", "radial_zernikes", "texture"), F.when(chan.isNotNull(), placed))
           .otherwise(shape))
    return F.when((F.size(pieces) == 3) & comp.isNotNull() & (kind != ""), out)


def map_features(names: DataFrame, known: DataFrame, col: str = "feature") -> DataFrame:
    """Names of one scheme joined to the names of the other; every name of either side appears."""
    left = names.select(F.col(col).alias("feature_b"), canonical_feature(F.col(col)).alias("_k")).distinct()
    right = known.select(F.col(col).alias("feature_a")).distinct()
    return left.join(right, left["_k"] == right["feature_a"], "full_outer").select("feature_b", "feature_a")


def mapping_coverage(mapped: DataFrame) -> DataFrame:
    a, b = F.col("feature_a"), F.col("feature_b")
    both = a.isNotNull() & b.isNotNull()
    return mapped.agg(
        F.countDistinct(a).alias("total_a"), F.countDistinct(b).alias("total_b"),
        F.countDistinct(F.when(both, a)).alias("mapped_a"), F.countDistinct(F.when(both, b)).alias("mapped_b"),
    ).withColumns({"coverage_a": F.try_divide("mapped_a", "total_a") * 100, "coverage_b": F.try_divide("mapped_b", "total_b") * 100})


def greenlist_filter(df: DataFrame, green: DataFrame, col: str = "full_feature_name") -> DataFrame:
    """Rows whose (object, channel, core name) is listed; list names without a channel match every channel."""
    channel = F.regexp_extract("feature", "^([0-9]+)_(.*)", 1)
    listed = green.select("object", F.when(channel != "", channel).alias("channel"),
                          F.regexp_replace("feature", "^[0-9]+_", "").alias("core"))
    listed = listed.filter(~F.col("core").rlike(_starts(EXCLUDED_MOMENTS))).distinct()
    pieces = F.split(F.col(col), "/")
    where = "^(cell|nuclei)_([0-9]+)"
    stripped = F.regexp_extract(F.get(pieces, F.lit(2)), "^[a-z][a-z_]*([A-Z].*)", 1)
    keyed = df.withColumns({
        "_o": F.regexp_extract(pieces[0], where, 1), "_c": F.regexp_extract(pieces[0], where, 2),
        "_f": F.when(stripped != "", stripped).otherwise(F.get(pieces, F.lit(2)))})
    exact = listed.filter("channel IS NOT NULL")
    loose = listed.filter("channel IS NULL")
    hit = keyed.join(exact.toDF("_o", "_c", "_f"), ["_o", "_c", "_f"], "left_semi")
    rest = keyed.join(exact.toDF("_o", "_c", "_f"), ["_o", "_c", "_f"], "left_anti")
    any_channel = rest.join(loose.select(F.col("object").alias("_o"), F.col("core").alias("_f")), ["_o", "_f"], "left_semi")
    return hit.select(*df.columns).unionByName(any_channel.select(*df.columns))
