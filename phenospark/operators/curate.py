"""Annotation tables and relation graphs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenospark.operators.relational import canonical_pairs, class_pairs_in_group, first_per_key, pairs_in_group, symmetrize

# Relation types that state a direct compound-gene mechanism.
STRICT_COMPOUND_GENE = (
    "target", "targets", "binds", "BINDS_CHbG", "DRUG_BINDING_GENE", "DRUG_INHIBITION_GENE", "inhibitor",
    "DRUG_ACTIVATION_GENE", "agonist", "antagonist", "enzyme",
)

# Relation types that state a direct gene-gene mechanism.
STRICT_GENE_GENE = (
    "ppi", "PPI", "GENE_BINDING_GENE", "INTERACTS_GiG", "interacts", "GENE_PTMOD_GENE",
)

# Relation type to action class.
ACTION_CLASS = {
    "inhibitor": "inhibitory",
    "antagonist": "inhibitory",
    "blocker": "inhibitory",
    "negative modulator": "inhibitory",
    "inverse agonist": "inhibitory",
    "DRUG_INHIBITION_GENE": "inhibitory",
    "inhibitory allosteric modulator": "inhibitory",
    "agonist": "activating",
    "activator": "activating",
    "positive modulator": "activating",
    "partial agonist": "activating",
    "DRUG_ACTIVATION_GENE": "activating",
    "agonist,allosteric modulator": "activating",
    "binds": "binding",
    "targets": "binding",
    "modulator": "binding",
    "allosteric modulator": "binding",
    "DRUG_BINDACT_GENE": "binding",
    "agonist,antagonist": "binding",
    "blocker,activator": "binding",
}

# The strictest mode keeps the types whose action is known, and only physical gene pairs.
ULTRA_COMPOUND_GENE = tuple(ACTION_CLASS)
# Relation types of physical gene-gene interactions.
ULTRA_GENE_GENE = ("ppi", "PPI", "GENE_BINDING_GENE", "GENE_PTMOD_GENE")

# Gene perturbation type to the compound mode it mimics.
MODALITY_MODE = {"crispr": "inhibition", "orf": "activation"}

EDGE_COLUMNS = ("compound", "target", "partner", "target_modality", "source")
# Of an edge between classes: the edges it stands for, and the members of the classes at its ends.
CLASS_COLUMNS = ("n_edges", "n_compounds", "n_partners")


# ---- confidence tiers ------------------------------------------------------------------------

def interaction_counts(df: DataFrame, compound: str, target: str, support: str, strong: int) -> DataFrame:
    """All and strong interaction counts per compound and per target, joined back to the rows.

    Each count is a map-side combined aggregate; a strong count of zero is NULL.
    """
    out = df
    for key, name in ((compound, "cmp"), (target, "tgt")):
        n_strong = F.count_if(F.col(support) >= strong)
        counts = df.groupBy(key).agg(F.when(n_strong > 0, n_strong).alias(f"{name}_geq5"),
                                     F.count(F.lit(1)).alias(f"{name}_all"))
        out = out.join(counts, key)
    return out


def cross_modality_tier(unspecified: str = "unspecified", mode: str = "mode") -> Column:
    """Tier from uniqueness of the compound-target interaction; NULL comparisons fall through."""
    known = F.col(mode) != unspecified
    single = (F.col("cmp_geq5") == 1) & (F.col("cmp_all") == 1)
    single_target = (F.col("tgt_all") == 1) & (F.col("tgt_geq5") == 1)
    return (F.when(single & single_target & known, "Tier0").when(single & known, "Tier1")
            .when((F.col("cmp_geq5") < 3) & known, "Tier2").otherwise("Tier3"))


def within_modality_tier(df: DataFrame, target: str = "target", mode: str = "mode",
                         unspecified: str = "unspecified") -> DataFrame:
    """Tier whose eligible rows number at least two for the target, else Excluded."""
    has_null = F.max(F.col(mode).isNull().cast("int"))
    per_target = df.groupBy(target).agg(
        (F.countDistinct(mode) + has_null).alias("_modes"), F.count(F.lit(1)).alias("_rows"))
    base = df.join(per_target, target)
    e2 = (F.col(mode) != unspecified) & (F.col("_modes") == 1)
    e1 = e2 & (F.col("cmp_geq5") == 1)
    e0 = e1 & (F.col("cmp_all") == 1)
    flags = {"_e0": e0, "_e1": e1, "_e2": e2, "_e3": F.col("_rows") > 1}
    base = base.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    sums = base.groupBy(target).agg(*[F.count_if(f"_e{i}").alias(f"_n{i}") for i in range(4)])
    tier = F
    for i in range(4):
        tier = tier.when(F.col(f"_e{i}") & (F.col(f"_n{i}") >= 2), f"Tier{i}")
    out = base.join(sums, target).withColumn("within_tier", tier.otherwise("Excluded"))
    return out.drop("_modes", "_rows", *flags, *[f"_n{i}" for i in range(4)])


def tier_annotations(df: DataFrame, compound: str = "compound", target: str = "target", support: str = "support") -> DataFrame:
    kept = df.filter((F.col("target_type") == "gene") & (F.col(support) > 1))
    counted = interaction_counts(kept, compound, target, support, 5)
    return within_modality_tier(counted.withColumn("cross_tier", cross_modality_tier()))


def match_directions(ann: DataFrame, genes: DataFrame, target: str, mode: str, symbol: str, modality: str,
                     mode_of: Mapping[str, str] = MODALITY_MODE, unspecified: str = "unspecified") -> DataFrame:
    """Annotations meet gene perturbations of the same direction; undirected ones meet both."""
    wanted = F
    for name, m in mode_of.items():
        wanted = wanted.when(F.col(modality) == name, m)
    g = genes.select(F.col(symbol).alias(target), modality, wanted.alias("_mode"))
    directed = ann.join(g.withColumnRenamed("_mode", mode), [target, mode]).withColumn("how", F.lit("matched"))
    undirected = ann.filter(F.col(mode) == unspecified).join(g.drop("_mode"), target).withColumn("how", F.lit("undirected"))
    cols = [c for c in ("compound", target, mode, modality, "how")]
    return directed.select(*cols).unionByName(undirected.select(*cols))


def annotation_overlap(ann: DataFrame, ids: DataFrame, key: str, extra: DataFrame, extra_key: str, flag: str) -> DataFrame:
    """Annotations of known ids, one row each, with a flag of presence in another list.

    The ids are distinct, so the inner join keeps the same rows as a semi-join. A semi-join would be moved below the
    aggregates of ``ann``: its raw rows would meet the ids, and sort and all aggregates would share one task.
    """
    marked = extra.select(extra_key).distinct().withColumn(flag, F.lit(True))
    return (ann.dropDuplicates().join(ids.select(key).distinct(), key).select(*ann.columns)
            .join(marked, ann[key] == marked[extra_key] if key != extra_key else key, "left")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


# ---- edges -----------------------------------------------------------------------------------

def compound_gene_edges(pairs: DataFrame, genes: DataFrame, source: str = "cg", rel_types: Sequence[str] | None = None) -> DataFrame:
    """(compound, target) joined to the perturbations of the target gene, per modality."""
    if rel_types is not None:
        pairs = pairs.filter(F.col("rel_type").isin(list(rel_types)))
    linked = pairs.select("compound", "target").distinct().join(
        genes.select(F.col("symbol").alias("target"), F.col("gene_id").alias("partner"),
                     F.col("modality").alias("target_modality")).distinct(), "target")
    return linked.withColumn("source", F.lit(source)).select(*EDGE_COLUMNS)


def compound_compound_edges(pairs: DataFrame, ids: DataFrame, a: str, b: str, key: str, id_col: str) -> DataFrame:
    """Both ends looked up in the id map, mirrored, without self pairs."""
    ends = (pairs.select(F.col(a).alias("_ka"), F.col(b).alias("_kb")).distinct()
            .join(ids.select(F.col(key).alias("_ka"), F.col(id_col).alias("compound")), "_ka")
            .join(ids.select(F.col(key).alias("_kb"), F.col(id_col).alias("partner")), "_kb")
            .select("compound", "partner").filter("compound <> partner"))
    both = symmetrize(ends, "compound", "partner")
    return both.select("compound", F.lit(None).cast("string").alias("target"), "partner",
                       F.lit(None).cast("string").alias("target_modality"), F.lit("cc").alias("source"))


def gene_gene_edges(pairs: DataFrame, genes: DataFrame, rel_types: Sequence[str] | None = None) -> DataFrame:
    """Gene pairs as perturbation pairs of the same modality, both directions."""
    if rel_types is not None:
        pairs = pairs.filter(F.col("rel_type").isin(list(rel_types)))
    lohi = canonical_pairs(pairs.select("target_a", "target_b"), "target_a", "target_b")
    g = genes.select("symbol", "gene_id", "modality").distinct()
    left = g.select(F.col("symbol").alias("lo"), F.col("gene_id").alias("compound"), "modality")
    right = g.select(F.col("symbol").alias("hi"), F.col("gene_id").alias("partner"), "modality")
    ends = lohi.join(left, "lo").join(right, ["hi", "modality"])
    fwd = ends.select("compound", F.col("hi").alias("target"), "partner", "modality")
    back = ends.select(F.col("partner").alias("compound"), F.col("lo").alias("target"),
                       F.col("compound").alias("partner"), "modality")
    return (fwd.union(back).distinct().filter("compound <> partner")
            .select("compound", "target", "partner", F.col("modality").alias("target_modality"), F.lit("gg").alias("source")))


def classify_actions(pairs: DataFrame, classes: Mapping[str, str] = ACTION_CLASS, rel: str = "rel_type") -> DataFrame:
    """Adds the action class; the job fails on a relation type without a class."""
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    found = F.element_at(table, F.col(rel))
    checked = F.when(found.isNotNull(), found).otherwise(
        F.raise_error(F.concat(F.lit("relation type without action class: "), F.col(rel))).cast("string"))
    return pairs.withColumn("action_class", checked)


def bridged_compound_edges(cg: DataFrame, keys: Sequence[str] = ("target",), block: int = 2048) -> DataFrame:
    """Compounds that share a target (and an action class when it is among the keys)."""
    pairs = pairs_in_group(cg, keys, "compound", block)
    return pairs.select(F.col("a").alias("compound"), F.lit(None).cast("string").alias("target"),
                        F.col("b").alias("partner"), F.lit(None).cast("string").alias("target_modality"),
                        F.lit("cc").alias("source"))


def bridged_compound_classes(cg: DataFrame, keys: Sequence[str] = ("target",), block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The edges of ``bridged_compound_edges`` between classes of compounds with the same targets, and who is in a class.

    (edges with ``CLASS_COLUMNS``, whose ends are representatives; members (rep, id)). An edge of a representative with
    itself stands for those between different members of its class.
    """
    links, members = class_pairs_in_group(cg, keys, "compound", block)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("_n"))
    ends = (links.join(sizes.select(F.col("rep").alias("a"), F.col("_n").alias("n_compounds")), "a")
            .join(sizes.select(F.col("rep").alias("b"), F.col("_n").alias("n_partners")), "b"))
    n_edges = F.col("n_compounds") * (F.col("n_partners") - (F.col("a") == F.col("b")).cast("bigint"))
    empty = F.lit(None).cast("string")
    edges = ends.select(F.col("a").alias("compound"), empty.alias("target"), F.col("b").alias("partner"), empty.alias("target_modality"),
                        F.lit("cc").alias("source"), n_edges.alias("n_edges"), "n_compounds", "n_partners")
    return edges, members


def relation_graph(mode: str, pairs: DataFrame, genes: DataFrame, gene_pairs: DataFrame, known: DataFrame, by_class: bool = False) -> DataFrame:
    """Edges of all three kinds in one schema, for the modes full, strict and ultra.

    ``pairs`` (compound, target, rel_type) and ``gene_pairs`` (target_a, target_b, rel_type) are filtered by the mode's
    types. Compounds are linked by ``known`` (compound, partner) in full mode, by a shared target in strict mode, by a
    shared target and action class in ultra mode, where a compound-gene edge also stands once per relation type.
    ``by_class`` links classes of compounds with the same targets, whose edges carry ``CLASS_COLUMNS``.
    """
    bridged = (lambda *a: bridged_compound_classes(*a)[0]) if by_class else bridged_compound_edges
    pairs = pairs.filter(F.col("target") != "")
    if mode == "full":
        ends = symmetrize(known.select("compound", "partner").filter("compound <> partner"), "compound", "partner")
        empty = F.lit(None).cast("string")
        cc = ends.select("compound", empty.alias("target"), "partner", empty.alias("target_modality"), F.lit("cc").alias("source"))
        return union_edges(compound_gene_edges(pairs, genes), cc, gene_gene_edges(gene_pairs, genes))
    if mode == "strict":
        kept = pairs.filter(F.col("rel_type").isin(*STRICT_COMPOUND_GENE))
        return union_edges(compound_gene_edges(kept, genes), bridged(kept), gene_gene_edges(gene_pairs, genes, STRICT_GENE_GENE))
    if mode == "ultra":
        kept = classify_actions(pairs.filter(F.col("rel_type").isin(*ULTRA_COMPOUND_GENE)))
        typed = kept.select("compound", "target", "rel_type").distinct()
        linked = typed.join(genes.select(F.col("symbol").alias("target"), F.col("gene_id").alias("partner"), F.col("modality").alias("target_modality")).distinct(), "target")
        return union_edges(linked.withColumn("source", F.lit("cg")), bridged(kept, ["target", "action_class"]), gene_gene_edges(gene_pairs, genes, ULTRA_GENE_GENE))
    raise ValueError(f"unknown mode {mode}")


def map_splits(splits: DataFrame, ids: DataFrame, key: str, split: str, id_key: str, id_col: str) -> DataFrame:
    """Split names per id through the connectivity layer of the structure key."""
    layer = lambda c: F.split_part(F.col(c), F.lit("-"), F.lit(1)).alias("_layer")
    return (splits.select(layer(key), F.col(split).alias("split"))
            .join(ids.select(layer(id_key), id_col), "_layer").select(id_col, "split").distinct())


def union_edges(*parts: DataFrame) -> DataFrame:
    """All edges in one schema; with an edge between classes among them, every other edge stands for itself."""
    weighted = any("n_edges" in p.columns for p in parts)

    def shaped(p):
        if weighted and "n_edges" not in p.columns:
            p = p.withColumns({c: F.lit(1).cast("bigint") for c in CLASS_COLUMNS})
        return p.select(*EDGE_COLUMNS, *(CLASS_COLUMNS if weighted else ()))

    out = shaped(parts[0])
    for p in parts[1:]:
        out = out.unionByName(shaped(p))
    return out


def edge_counts(edges: DataFrame) -> DataFrame:
    """Per source: edges, different compounds and partners, edges with a target and with a target modality.

    Edges between classes count as the edges they stand for. Both ends meet in one aggregation, which combines map-side.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    n, left, right = (F.col(c) if "n_edges" in edges.columns else one for c in CLASS_COLUMNS)
    of = lambda c: F.when(F.col(c).isNotNull(), n).otherwise(none)
    end = lambda side, c, size, *counts: F.struct(F.lit(side).alias("_left"), F.col(c).alias("_id"), size.alias("_size"), *[
        x.alias(k) for k, x in zip(("n", "n_target", "n_modality"), counts)])
    ends = edges.select("source", F.inline(F.array(end(True, "compound", left, n, of("target"), of("target_modality")), end(False, "partner", right, none, none, none))))
    per = ends.groupBy("source", "_left", "_id").agg(F.max("_size").alias("_size"), *[F.sum(c).alias(c) for c in ("n", "n_target", "n_modality")])
    known = lambda side: F.sum(F.when((F.col("_left") == side) & F.col("_id").isNotNull(), F.col("_size")).otherwise(none))
    return per.groupBy("source").agg(F.sum("n").alias("n"), known(True).alias("n_left"), known(False).alias("n_right"), F.sum("n_target").alias("n_target"), F.sum("n_modality").alias("n_modality"))


# ---- metadata build --------------------------------------------------------------------------

def id_mapping(sources: Sequence[tuple[DataFrame, str]], registry: DataFrame, reg_key: str, id_col: str) -> DataFrame:
    """Structure keys of several sources to ids by connectivity layer, one id per key."""
    layer = lambda c: F.split_part(F.col(c), F.lit("-"), F.lit(1)).alias("layer")
    keys = None
    for df, col in sources:
        part = df.select(F.col(col).alias("structure_key"), layer(col))
        keys = part if keys is None else keys.unionByName(part)
    joined = keys.distinct().join(registry.select(layer(reg_key), id_col), "layer", "left")
    return first_per_key(joined.filter(F.col(id_col).isNotNull()), ["structure_key", id_col])


def classify_types(wells: DataFrame, key: str, typed: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Perturbation type from the first id table that knows the id, in the given priority."""
    out = wells
    flags = []
    for name, ids in typed:
        flag = f"_is_{name}"
        out = out.join(ids.select(key).distinct().withColumn(flag, F.lit(name)), key, "left")
        flags.append(flag)
    return out.withColumn("perturbation_type", F.coalesce(*flags, F.lit("UNKNOWN"))).drop(*flags)


def filter_fill_rate(wells: DataFrame, plate: Sequence[str], well: str, minimum: float, capacity: int = 384) -> DataFrame:
    from phenospark.operators.aggregate import fill_rate

    rates = fill_rate(wells, plate, well, capacity).filter(F.col("fill_rate") >= minimum)
    return wells.join(rates, list(plate))


def min_replicates(df: DataFrame, id_col: str, at_least: int, within: Column | None = None) -> DataFrame:
    rows = df.filter(within) if within is not None else df
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least).select(id_col)


def target_lists(wells: DataFrame, ann: DataFrame, id_col: str, is_control: Column, gene_symbol: Column) -> DataFrame:
    """Target list per row: 'unknown' for controls, the symbol for genes, annotated targets otherwise."""
    from phenospark.operators.aggregate import sorted_unique_join

    lists = ann.groupBy(id_col).agg(sorted_unique_join("target").alias("_list"))
    picked = (F.when(is_control, F.lit("unknown")).when(gene_symbol.isNotNull(), gene_symbol)
              .otherwise(F.coalesce(F.col("_list"), F.lit("unknown"))))
    return wells.join(lists, id_col, "left").withColumn("target_list", picked).drop("_list")
