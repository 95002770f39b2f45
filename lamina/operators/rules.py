"""Ordered validation rules: each row is kept, or leaves under exactly one motif."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lamina.contract import DISCARDED, KEPT


@dataclass(frozen=True)
class Rule:
    motif: str
    broken: Column
    detail: Column


def judge(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add `_motif` and `_detail`: the first broken rule, or `retenu`.

    One pass, whatever the number of rules. Motifs exclude each other, so kept
    rows and rejects always add up to the input.
    """
    verdict = None
    for rule in rules:
        outcome = F.struct(F.lit(rule.motif).alias("motif"), rule.detail.alias("detail"))
        broken = F.coalesce(rule.broken, F.lit(False))
        verdict = F.when(broken, outcome) if verdict is None else verdict.when(broken, outcome)
    return (
        df.withColumn("_verdict", verdict)
        .withColumn("_motif", F.coalesce(F.col("_verdict.motif"), F.lit(KEPT)))
        .withColumn("_detail", F.col("_verdict.detail"))
        .drop("_verdict")
    )


def kept(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("_motif") == KEPT).drop("_motif", "_detail")


def rejects(
    judged: DataFrame, source: str, key: Column, action: str = DISCARDED, carry: list[str] | None = None
) -> DataFrame:
    """The rows that broke a rule, in the shape of the reject register, with columns to carry along."""
    lines = F.col("nb_lignes") if "nb_lignes" in judged.columns else F.lit(1).cast("bigint")
    return judged.where(F.col("_motif") != KEPT).select(
        F.lit(source).alias("source"),
        key.alias("cle"),
        F.col("_motif").alias("motif"),
        F.lit(action).alias("action"),
        F.col("_detail").alias("detail"),
        lines.alias("nb_lignes"),
        F.col("_jour_depot"),
        F.col("_fichier_source"),
        *(carry or []),
    )
