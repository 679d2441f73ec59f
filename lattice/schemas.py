"""Declared schemas of the persisted tables, and the nested pattern signature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SIGNATURE = (
    "struct<graphlets:struct<triangle:bigint,wedge:bigint,triplet:bigint,edges:bigint,nodes:bigint>,"
    "degree_stats:struct<mean_degree:double,std_degree:double,max_degree:int,min_degree:int,degree_distribution:map<int,bigint>>,"
    "random_walks:struct<return_probability:double,path_diversity:double,num_unique_patterns:bigint,avg_transition_prob:double,stationary_distribution_entropy:double>,"
    "semantic_centroids:map<int,array<double>>,graph_properties:struct<density:double,num_nodes:bigint,num_edges:bigint>,"
    "embedding_stats:struct<mean_embedding_norm:double,std_embedding_norm:double,intra_cluster_similarity:double>,"
    "cluster_size:int,uncertainty:double,quality_metrics:map<string,double>>"
)

_STAMPS = "created_at timestamp, updated_at timestamp"

TABLES: dict[str, str] = {
    "workspaces": "id string, name string, user_id string, created_at timestamp",
    "episodes": "id string, workspace_id string, summary string, content string, embedding array<float>, metadata map<string,string>, created_at timestamp",
    "units": "id string, workspace_id string, episode_id string, content string, embedding array<float>, metadata map<string,string>, is_archived boolean, created_at timestamp",
    "concepts": f"id string, workspace_id string, name string, description string, centroid array<float>, pattern_signature {SIGNATURE}, metadata map<string,string>, generation int, created_at timestamp",
    "concept_members": "concept_id string, unit_id string",
    "unit_edges": "id string, workspace_id string, src string, dst string, semantic_similarity double, temporal_proximity double, causal_weight double, attributes map<string,string>, created_at timestamp",
    "training_jobs": f"id string, workspace_id string, status string, progress int, message string, metadata map<string,string>, {_STAMPS}",
    "settings": f"id string, workspace_id string, key string, value string, {_STAMPS}",
    "ranker_state": f"id string, model_id string, weights array<double>, metadata map<string,string>, {_STAMPS}",
    "chat_sessions": f"id string, workspace_id string, name string, focus_state string, {_STAMPS}",
    "chat_messages": "id string, session_id string, role string, content string, mode_used string, metadata map<string,string>, created_at timestamp",
    "personas": f"id string, workspace_id string, name string, personality string, voice_style string, {_STAMPS}",
    "consciousness": "id string, workspace_id string, mood string, thought_summary string, focus_topics array<string>, created_at timestamp",
    "tasks": f"id string, workspace_id string, name string, description string, status string, progress double, result string, error string, metadata map<string,string>, {_STAMPS}",
}

#: The column by which a child belongs to its parent, for cascading deletes.
PARENTS: dict[str, list[tuple[str, str]]] = {
    "workspaces": [(t, "workspace_id") for t in ("episodes", "units", "concepts", "unit_edges", "training_jobs", "settings", "chat_sessions", "personas", "consciousness", "tasks")],
    "chat_sessions": [("chat_messages", "session_id")],
    "concepts": [("concept_members", "concept_id")],
}

TASK_STATUSES = ("pending", "running", "completed", "failed", "cancelled")


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def has_dimension(vector: Column, dim: int) -> Column:
    """Whether a vector has the declared dimension; rows of another one are to be refused."""
    return F.coalesce(F.size(vector) == dim, F.lit(False))
