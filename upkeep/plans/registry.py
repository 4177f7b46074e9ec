"""Every query by name: ``name -> callable(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from upkeep.plans import corpus, interval, lifespan, models, reports, tickets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "interval_assignment": interval.interval_assignment,
    "interval_distribution": interval.interval_distribution,
    "asset_complaint_rollup": interval.asset_complaint_rollup,
    "schedule_fanout": interval.schedule_fanout,
    "schedule_first": interval.schedule_first,
    "interval_lists": interval.interval_lists,
    "severity_describe": interval.severity_describe,
    "complaint_boxplot": interval.complaint_boxplot,
    "criticality_crosstab": interval.criticality_crosstab,
    "table_profile": interval.table_profile,
    "label_encoding": interval.label_encoding,
    "stratified_split": interval.stratified_split,
    "classification_report": interval.classification_report,
    "rul_target": lifespan.rul_target,
    "complaint_history_features": lifespan.complaint_history_features,
    "penalty_target": lifespan.penalty_target,
    "time_split": lifespan.time_split_query,
    "critical_oversample": lifespan.critical_oversample,
    "asset_rollup_full": lifespan.asset_rollup_full,
    "lifespan_target": lifespan.lifespan_target,
    "target_encoding": lifespan.target_encoding,
    "complaint_target_encoding": lifespan.complaint_target_encoding,
    "worst_predictions": lifespan.worst_predictions,
    "type_slice_error": lifespan.type_slice_error,
    "diverse_sample": lifespan.diverse_sample,
    "regression_metrics": lifespan.regression_metrics,
    "ticket_concat": tickets.ticket_concat,
    "ticket_clean_basic": tickets.ticket_clean_basic,
    "ticket_clean_strict": tickets.ticket_clean_strict,
    "ticket_stop_lemma": tickets.ticket_stop_lemma,
    "hash_split": tickets.hash_split_query,
    "ticket_synonym_augment": tickets.ticket_synonym_augment,
    "ticket_partial_substitution": tickets.ticket_partial_substitution,
    "ticket_tfidf": tickets.ticket_tfidf,
    "exact_match": tickets.exact_match,
    "allowed_values": corpus.allowed_values,
    "valid_combinations": corpus.valid_combinations,
    "combination_sample": corpus.combination_sample,
    "coverage_queue": corpus.coverage_queue,
    "queue_remaining": corpus.queue_remaining,
    "response_rows": corpus.response_rows,
    "response_conformance": corpus.response_conformance,
    "prompt_text": corpus.prompt_text,
    "delimiter_sniff": corpus.delimiter_sniff,
    "ticket_read_bad_lines": corpus.ticket_read_bad_lines,
    "tagged_parse": reports.tagged_parse,
    "tagged_permute": reports.tagged_permute,
    "linearize_asset": reports.linearize_asset,
    "report_pairs": reports.report_pairs,
    "fixed_length_ids": reports.fixed_length_ids,
    "asset_report_text": reports.asset_report_text,
    # model training (checked on row counts only)
    "interval_model": models.interval_model,
    "interval_feature_importance": models.interval_feature_importance,
    "interval_boosted_model": models.interval_boosted_model,
    "interval_boosted_report": models.interval_boosted_report,
    "interval_boosted_importance": models.interval_boosted_importance,
    "lifespan_model": models.lifespan_model,
    "lifespan_feature_importance": models.lifespan_feature_importance,
    "lifespan_worst_predictions": models.lifespan_worst_predictions,
    "lifespan_type_error": models.lifespan_type_error,
    "lifespan_report_text": models.lifespan_report_text,
    "ticket_model": models.ticket_model,
    "ticket_grid": models.ticket_grid,
    "vector_model": models.vector_model,
    "text_vector_model": models.text_vector_model,
    "text_vector_grid": models.text_vector_grid,
}
