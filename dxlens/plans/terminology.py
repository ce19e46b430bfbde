"""Terminology jobs: current names (D1), descendant closure (D7), specificity (D9),
semantic tags (D10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dxlens.functions.labels import first_label
from dxlens.operators.closure import descendant_closure
from dxlens.operators.grouping import latest_per_group

# Fixed values of the terminology release.
FSN_TYPE = 900000000000003001   # description type: fully specified name
ISA_TYPE = 116680003            # relationship type: is-a
# Semantic tags in the order the labels were assigned; a later entry overrides
# an earlier one when a concept carries both.
SEMANTIC_TAGS = [
    ("finding", "(finding)"),
    ("morphology", "(morphologic abnormality)"),
    ("procedure", "(procedure)"),
    ("situation", "(situation)"),
    ("organism", "(organism)"),
    ("disorder", "(disorder)"),
    ("person", "(person)"),
    ("bodystruc", "(body structure)"),
    ("regime", "(regime/therapy)"),
]
OTHER_TYPE = "other"
FINDING_TAG = "(finding)"


def current_names(descr: DataFrame, type_id: int = FSN_TYPE, dedupe: bool = False) -> DataFrame:
    """The latest active name of the given type per concept.

    Versions compare by ``effectivetime`` text (``yyyymmdd``).  Names sharing
    the latest date are all returned (``dedupe=False``), so joins to names can
    fan out; ``dedupe=True`` keeps one per concept.
    """
    fsn = descr.where((F.col("active") == 1) & (F.col("typeid") == type_id))
    return latest_per_group(fsn, ["conceptid"], "effectivetime", keep_ties=not dedupe)


def isa_edges(relats: DataFrame, type_id: int = ISA_TYPE) -> DataFrame:
    """Active is-a edges of any version (child ``sourceid`` -> parent ``destinationid``)."""
    return relats.where((F.col("typeid") == type_id) & (F.col("active") == 1)).select("sourceid", "destinationid")


def concept_seeds(problems: DataFrame) -> DataFrame:
    """Distinct concepts in use."""
    return problems.select("conceptid").where(F.col("conceptid").isNotNull()).distinct()


def closure(relats: DataFrame, problems: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(destinationid ancestor, sourceid descendant, depth)`` from the concepts in use."""
    return descendant_closure(isa_edges(relats), concept_seeds(problems), max_depth=max_depth)


def descendant_counts(closure_df: DataFrame) -> DataFrame:
    """Number of descendants per ancestor concept."""
    return closure_df.groupBy(F.col("destinationid").alias("conceptid")).agg(F.count(F.lit(1)).alias("_n"))


def with_specificity(problems: DataFrame, closure_df: DataFrame) -> DataFrame:
    """``descendants`` (0 when none) and ``descendantslog`` = log10(1 + descendants)."""
    counts = descendant_counts(closure_df)
    base = problems.drop("descendants", "descendantslog")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return (base.join(counts, "conceptid", "left")
            .select(*base.columns, n.cast("int").alias("descendants"),
                    F.log10(n + 1).alias("descendantslog")))


def _tag_flags(term: Column) -> list[Column]:
    return [term.contains(tag).cast("int").alias(f"_{label}") for label, tag in SEMANTIC_TAGS]


def _tag_columns() -> list[Column]:
    """``finding`` and ``snomedtype`` of a concept from its tag flags."""
    rules = [(F.col(f"_{label}") == 1, label) for label, _ in reversed(SEMANTIC_TAGS)]
    return [F.col("_finding").alias("finding"), first_label(rules, OTHER_TYPE).alias("snomedtype")]


def concept_tags(names: DataFrame) -> DataFrame:
    """Per concept: ``finding`` flag and ``snomedtype`` label from its names.

    A concept with several current names gets a tag when any name carries it;
    the label is the highest-priority tag present.
    """
    flags = names.select("conceptid", *_tag_flags(F.col("term")))
    per_concept = flags.groupBy("conceptid").agg(*[F.max(c).alias(c) for c in flags.columns[1:]])
    return per_concept.select("conceptid", *_tag_columns())


def with_semantic_tags(problems: DataFrame, names: DataFrame) -> DataFrame:
    """``finding`` (0/1) and ``snomedtype`` ('other' when no tag) per problem."""
    tags = concept_tags(names)
    base = problems.drop("finding", "snomedtype")
    return (base.join(tags, "conceptid", "left")
            .select(*base.columns, F.coalesce(F.col("finding"), F.lit(0)).alias("finding"),
                    F.coalesce(F.col("snomedtype"), F.lit(OTHER_TYPE)).alias("snomedtype")))


def concept_facts(closure_df: DataFrame, names: DataFrame) -> DataFrame:
    """One row per concept: its number of descendants (``_n``, D9), ``finding`` and ``snomedtype``.

    Closure rows and names are added up in one grouping by concept.
    """
    flags = [f"_{label}" for label, _ in SEMANTIC_TAGS]
    below = closure_df.select(F.col("destinationid").alias("conceptid"), F.lit(1).alias("_n"), *[F.lit(0).alias(c) for c in flags])
    named = names.select("conceptid", F.lit(0).alias("_n"), *_tag_flags(F.col("term")))
    per_concept = (below.unionByName(named).where(F.col("conceptid").isNotNull()).groupBy("conceptid")
                   .agg(F.sum("_n").alias("_n"), *[F.max(c).alias(c) for c in flags]))
    return per_concept.select("conceptid", "_n", *_tag_columns())


def with_concept_facts(problems: DataFrame, closure_df: DataFrame, names: DataFrame) -> DataFrame:
    """D9 and D10 at once: the columns of :func:`with_specificity` and :func:`with_semantic_tags` by one join."""
    base = problems.drop("descendants", "descendantslog", "finding", "snomedtype")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return (base.join(concept_facts(closure_df, names), "conceptid", "left")
            .select(*base.columns, n.cast("int").alias("descendants"), F.log10(n + 1).alias("descendantslog"),
                    F.coalesce(F.col("finding"), F.lit(0)).alias("finding"),
                    F.coalesce(F.col("snomedtype"), F.lit(OTHER_TYPE)).alias("snomedtype")))
