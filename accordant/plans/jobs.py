"""The four jobs of an annotation project, each from stored table to stored table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from accordant.functions import prompts, text as T
from accordant.operators import agreement, align, annotate, consensus, dedup, labels, quality, reshape, selection, training
from accordant.sources import artefacts
from accordant.sources.versions import built, digest
from accordant.sources.workspace import fresh_path


@dataclass(frozen=True)
class ConsensusReport:
    """Consensus table and its agreement tables, all lazy."""

    table: DataFrame
    categories: list[int]
    models: list[str]
    pairwise: DataFrame
    cohen: DataFrame
    fleiss: DataFrame
    problematic: DataFrame
    validation: DataFrame | None
    summary: DataFrame


def annotation_job(texts: DataFrame, annotator: annotate.Annotator, models: Sequence[str], *, categories: Sequence[int],
                   meanings: Mapping[str, str], template: str = "base", description: str = "Text", reps: int = 1,
                   configs: Mapping[str, Mapping[str, Any]] | None = None, cache: str | None = None,
                   truth: DataFrame | None = None, truth_order: str = "ground_truth", order: str | None = None,
                   parallelism: int | None = None) -> DataFrame:
    """Texts to the wide annotation table: prompt, call or cache, parse, vote, join the truth."""
    keyed = texts.withColumn("text_id", T.text_id("text"))
    if order:
        keyed = dedup.keep_first(keyed, "text_id", order)
    keyed = keyed.withColumns({
        "prompt": prompts.render(template, "text", meanings=meanings, description=description),
        "text_len": T.text_len("text")})
    pairs = annotate.expand_variants(models, configs or {})
    reqs = annotate.requests(keyed, pairs, reps)
    # Responses are stored before use, in the given cache or in a fresh table: an action that
    # reads the result twice, or a task that is retried later, must not call the model again.
    answered = annotate.call_with_cache(
        reqs, annotator, cache or fresh_path(texts.sparkSession, "responses"), parallelism)
    wide = annotate.to_wide(annotate.parse(answered, categories), [name for name, _ in pairs], reps)
    out = keyed.select("text_id", "text", "text_len").join(wide, "text_id")
    return align.attach_truth(out, truth, truth_order) if truth is not None else out


def consensus_job(annotations: DataFrame, *, dataset: str, order: str, threshold: float = 0.8,
                  strategy: str = "majority_vote", categories: Sequence[int] | None = None,
                  params: Mapping[str, Any] | None = None, output: str | None = None) -> ConsensusReport:
    """Resolve votes over the whole table and report agreement; nothing is filtered.

    Rows with an invalid label are left out of the comparison with the truth only.
    """
    rows = dedup.keep_first(annotations, "text_id", order)
    columns = consensus.vote_columns(rows.columns)
    found = list(categories) if categories is not None else labels.category_list(
        rows, columns + (["ground_truth"] if "ground_truth" in rows.columns else []))
    table = consensus.resolve(rows, columns, threshold=threshold, strategy=strategy, params=params)
    if output:
        artefacts.write_consensus(table, f"{output}/consensus", threshold)
        table = table.sparkSession.read.parquet(f"{output}/consensus").drop("subset")
    models = [consensus.annotator_name(c) for c in columns]
    fleiss = agreement.fleiss_kappa(table, columns, categories=found)
    valid = consensus.valid_for_evaluation(table)
    report = (quality.classification_report(valid) if "ground_truth" in table.columns else None)
    summary = artefacts.experiment_summary(
        table, fleiss, dataset=dataset, models=models, categories=found, threshold=threshold,
        strategy=strategy, report=report)
    if output:
        artefacts.write_summary(summary, f"{output}/summary")
    return ConsensusReport(
        table=table, categories=found, models=models, pairwise=agreement.pairwise_agreement(table, columns),
        cohen=agreement.cohen_kappa(table, columns), fleiss=fleiss,
        problematic=consensus.problematic_cases(table, columns), validation=report, summary=summary)


def selection_job(consensus_table: DataFrame, output: str, *, force: bool = False, **options: Any) -> DataFrame:
    """Select instances, store rows and report, return the stored rows.

    The stored selection is reused as long as the rows of the table and the options are those it was made from.
    Anything else selects anew: whether a text is redundant or noise depends on all the others.  Rows and report are
    committed together.
    """
    reports: list[DataFrame] = []

    def rows() -> DataFrame:
        selected, report = selection.filter_annotations(consensus_table, **options)
        reports.append(report)
        return selected

    return built(consensus_table.sparkSession, output, rows, made_from={"rows": digest(consensus_table), "options": options}, force=force,
                 partition_by=["selection"], with_it=lambda folder: reports[-1].write.json(f"{folder}/report"))


def perspectives_job(spark: SparkSession, annotations: DataFrame, path: str, *,
                     meanings: Mapping[str, str] | None = None, force: bool = False, track: bool = False) -> DataFrame:
    """The one-row-per-annotator dataset, reused when it is already stored.

    With ``track`` it is reused only while annotations and meanings are those it was made from.
    """
    made_from = {"rows": digest(annotations), "meanings": dict(meanings) if meanings else None} if track else None
    return artefacts.load_or_build(spark, path, lambda: reshape.perspectives(annotations, meanings=meanings), force, made_from)


def training_job(folds: DataFrame, annotated: DataFrame, *, per_annotator: bool = False) -> DataFrame:
    """Leak-free folds: annotated labels in training rows, true labels in evaluation rows."""
    return align.align_folds(folds, annotated, allow_duplicate_ids=per_annotator)
