"""Schemas of the documents that stages exchange, by their format tag. They are given, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_FRAME = "frame_id BIGINT, frame_stem STRING"
_BOX = "center_3d ARRAY<DOUBLE>, bbox_min ARRAY<DOUBLE>, bbox_max ARRAY<DOUBLE>, bbox_size ARRAY<DOUBLE>, bbox_volume DOUBLE"
_TASK = (
    "task_index BIGINT, trajectory_index BIGINT, " + _FRAME + ", is_init BOOLEAN, is_keyframe BOOLEAN, image_path STRING, image_relative_path STRING, image_exists BOOLEAN, depth_path STRING, "
    "depth_relative_path STRING, depth_exists BOOLEAN, timestamp DOUBLE, depth_timestamp DOUBLE, pose_c2w ARRAY<ARRAY<DOUBLE>>, intrinsics STRUCT<fx: DOUBLE, fy: DOUBLE, cx: DOUBLE, cy: DOUBLE>, "
    "width BIGINT, height BIGINT, depth_scale DOUBLE"
)
_DETECTION = "det_index INT, prompt STRING, label STRING, box_xyxy ARRAY<DOUBLE>, box_score DOUBLE, mask_score DOUBLE, mask_area_ratio DOUBLE, kept BOOLEAN, instance_index INT, reject_reason STRING"
_OBJECT = (
    "object_id STRING, status STRING, canonical_label STRING, aliases ARRAY<STRING>, label_counts MAP<STRING, BIGINT>, observation_indices ARRAY<BIGINT>, observation_ids ARRAY<STRING>, "
    "observed_frames ARRAY<BIGINT>, first_seen_frame BIGINT, last_seen_frame BIGINT, support_frame_count BIGINT, support_observation_count BIGINT, point_count BIGINT, object_point_key STRING, "
    "mean_box_score DOUBLE, mean_mask_score DOUBLE, mean_hit_ratio DOUBLE, " + _BOX + ", final_status STRING, refine_reason STRING, refine_suppressed_by STRING, source_object_ids ARRAY<STRING>, absorbed_object_ids ARRAY<STRING>"
)

# The formats' names, and the field of a document that holds its rows.
FORMATS: dict[str, tuple[str, str]] = {
    "online_semantic_task_v1": ("", "format STRING, queue_status STRING, queued_at STRING, processing_started_at STRING, finished_at STRING, retried_at STRING, retry_reason STRING"),
    "grounded_sam2_frame_observations_v1": ("frames", _FRAME + ", status STRING, accepted_observations ARRAY<STRUCT<observation_id: STRING, label: STRING, mask_path: STRING, mask_area_ratio: DOUBLE, max_box_score: DOUBLE, max_mask_score: DOUBLE>>"),
    "frame_3d_observations_v1": ("observations", "observation_id STRING, source_observation_id STRING, observation_index BIGINT, component_index INT, component_count INT, " + _FRAME + ", label STRING, status STRING, hit_key STRING, visible_key STRING, hit_point_count BIGINT, visible_point_count BIGINT, hit_ratio DOUBLE, max_box_score DOUBLE, max_mask_score DOUBLE, mask_area_ratio DOUBLE, " + _BOX),
    "grouped_label_similarity_v1": ("items", "label_a STRING, label_b STRING, pair_key STRING, relation STRING, similarity DOUBLE, merge_policy STRING, reason STRING"),
    "semantic_label_groups_v1": ("groups", "group_id STRING, group_name STRING, group_type STRING, labels ARRAY<STRING>, reason STRING"),
    "object_memory_v1": ("objects", _OBJECT),
    "final_object_memory_v1": ("objects", _OBJECT),
    "final_refined_object_memory_v1": ("objects", _OBJECT + ", final_refine_status STRING, final_refine_reason STRING, final_refine_kept_object_id STRING"),
    "scene_objects_v1": ("objects", "object_id STRING, display_name STRING, canonical_label STRING, aliases ARRAY<STRING>, status STRING, final_status STRING, " + _BOX + ", support_frame_count BIGINT, support_observation_count BIGINT, point_count BIGINT, source_object_ids ARRAY<STRING>"),
}


def rows_field(tag: str) -> str:
    return FORMATS[tag][0]


def row_schema(tag: str) -> T.StructType:
    schema = T.StructType.fromDDL(FORMATS[tag][1])
    return schema.add("task", T.StructType.fromDDL(_TASK)) if tag == "online_semantic_task_v1" else schema
