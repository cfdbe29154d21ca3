"""Validation against the vocabulary and the policy folders: rejected rows with a reason."""

from pyspark.sql import DataFrame, functions as F

from factwright.functions.checks import disallowed_verdict
from factwright.functions.envelopes import parse_vn


def undeclared_predicate(identities: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Facts whose predicate the active vocabulary does not declare. A vocabulary is a few dozen rows, and facts have as few predicates: dealt
    by them, most facts would meet in a few tasks, so the vocabulary is broadcast and facts stay where they are."""
    return identities.join(F.broadcast(vocabulary.select("predicate").distinct()), "predicate", "left_anti")


def disallowed_verdicts(policies: DataFrame) -> DataFrame:
    rows = policies.select("name", "version", F.explode("allowed_verdicts").alias("verdict"))
    return rows.withColumn("reason", disallowed_verdict("verdict")).where(F.col("reason").isNotNull())


def manifest_mismatch(policies: DataFrame) -> DataFrame:
    """Manifests whose id or version is not what their folder is called (name, version, id,
    declared_version)."""
    reason = F.coalesce(
        F.when(~F.col("id").eqNullSafe(F.col("name")), F.lit("id differs from folder")),
        F.when(~F.col("declared_version").eqNullSafe(F.col("version")), F.lit("version differs from folder")),
    )
    return policies.withColumn("reason", reason).where(F.col("reason").isNotNull())


def vocabulary_not_superset(vocabulary: DataFrame) -> DataFrame:
    """(version, predicate, reason): predicates of version N that N+1 lacks or changes."""
    fields = ["subject_kind", "object_kind", "object_datatype"]
    n = parse_vn("version")
    rows = vocabulary.where(n.isNotNull()).select(n.alias("n"), "predicate", F.struct(*fields).alias("d"), F.col("verification_class").alias("cls"))
    after = rows.select((F.col("n") - 1).alias("n"), "predicate", F.col("d").alias("d2"), F.col("cls").alias("cls2"))
    last = rows.agg(F.max("n").alias("last"))
    both = rows.join(after, ["n", "predicate"], "left").where(F.col("n") < last.scalar())
    changed_class = F.col("cls").isNotNull() & ~F.col("cls").eqNullSafe(F.col("cls2"))
    reason = F.when(F.col("d2").isNull(), F.lit("dropped")).when((F.col("d") != F.col("d2")) | changed_class, F.lit("changed"))
    return both.select(
        F.concat(F.lit("v"), (F.col("n") + 1).cast("string")).alias("version"), "predicate", reason.alias("reason")
    ).where(F.col("reason").isNotNull())
