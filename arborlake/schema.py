"""Schemas of the canonical tables, as DDL strings."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES = {
    "files": "id BIGINT NOT NULL, path STRING NOT NULL, language STRING, file_role STRING, hash STRING, mtime DOUBLE, line_count BIGINT",
    "symbols": "id BIGINT NOT NULL, file_id BIGINT, name STRING, qualified_name STRING, kind STRING, signature STRING, line_start BIGINT, line_end BIGINT, docstring STRING, visibility STRING, is_exported INT, parent_id BIGINT, default_value STRING",
    "edges": "id BIGINT, source_id BIGINT, target_id BIGINT, kind STRING, line BIGINT",
    "file_edges": "id BIGINT, source_file_id BIGINT, target_file_id BIGINT, kind STRING, symbol_count BIGINT",
    "graph_metrics": "symbol_id BIGINT, pagerank DOUBLE, in_degree BIGINT, out_degree BIGINT, betweenness DOUBLE",
    "clusters": "symbol_id BIGINT, cluster_id BIGINT, cluster_label STRING",
    "symbol_metrics": "symbol_id BIGINT, cognitive_complexity DOUBLE, nesting_depth BIGINT, param_count BIGINT, line_count BIGINT, return_count BIGINT, bool_op_count BIGINT, callback_depth BIGINT, cyclomatic_density DOUBLE, halstead_volume DOUBLE, halstead_difficulty DOUBLE, halstead_effort DOUBLE, halstead_bugs DOUBLE",
    "file_stats": "file_id BIGINT, commit_count BIGINT, total_churn BIGINT, distinct_authors BIGINT, complexity DOUBLE, health_score DOUBLE, cochange_entropy DOUBLE, cognitive_load DOUBLE",
    "git_commits": "id BIGINT, hash STRING, author STRING, timestamp BIGINT, message STRING",
    "git_file_changes": "id BIGINT, commit_id BIGINT, file_id BIGINT, path STRING, lines_added BIGINT, lines_removed BIGINT",
    "git_cochange": "file_id_a BIGINT, file_id_b BIGINT, cochange_count BIGINT",
    "git_hyperedges": "id BIGINT, commit_id BIGINT, file_count BIGINT, sig_hash STRING",
    "git_hyperedge_members": "hyperedge_id BIGINT, file_id BIGINT, ordinal BIGINT",
    "snapshots": "id BIGINT, timestamp BIGINT, tag STRING, source STRING, git_branch STRING, git_commit STRING",
    "metrics_history": "id BIGINT, timestamp BIGINT, file_count BIGINT, symbol_count BIGINT, edge_count BIGINT, avg_complexity DOUBLE, max_complexity BIGINT, dead_count BIGINT, dead_pct DOUBLE, test_ratio DOUBLE, cycle_count BIGINT, tangle_ratio DOUBLE, health_score BIGINT, god_components BIGINT, coupling_density DOUBLE, extra_json STRING",
    "references": "source_name STRING, target_name STRING, kind STRING, line BIGINT, import_path STRING, source_file STRING",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
