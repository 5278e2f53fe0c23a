"""Explicit schemas of the files read and written."""

DETECTION = (
    "struct<class_id:bigint,class_name:string,confidence:double,track_id:bigint,"
    "xyxy:array<double>,stable_object_key:string,is_signal_target:boolean,signal_state:string,"
    "signal_state_confidence:double>"
)
RESULT = (
    "struct<object_type:string,analyzer_name:string,stable_id:string,state:string,"
    "confidence:double,is_uncertain:boolean,attributes:map<string,string>>"
)
EVENT = (
    "struct<event_type:string,object_type:string,class_name:string,stable_id:string,"
    "object_key:string,timestamp_s:double,previous_state:string,current_state:string,"
    "confidence:double,is_uncertain:boolean,message:string,attributes:map<string,string>>"
)
FRAME = (
    "frame_index bigint, timestamp_s double, inference_ms double, "
    f"detections array<{DETECTION}>, events array<{EVENT}>, analysis_results array<{RESULT}>, "
    f"analysis_events array<{EVENT}>, narrations array<string>"
)
_RANGE = "start_frame:bigint,end_frame:bigint"
OBJECT = (
    "struct<ground_truth_id:string,object_type:string,"
    f"visible_frame_ranges:array<struct<{_RANGE}>>,"
    f"signal_state_intervals:array<struct<{_RANGE},state:string>>,"
    "transitions:array<struct<frame:bigint,from_state:string,to_state:string,ambiguous:boolean>>,"
    f"motion_intervals:array<struct<{_RANGE},state:string>>,route_number:string,"
    f"screen_stage_intervals:array<struct<{_RANGE},stage:string>>,"
    f"text_annotations:array<struct<{_RANGE},text:string,ambiguous:boolean>>>"
)
ANNOTATION = (
    "schema_version string, video_id string, review_status string, review_notes string, "
    "video_metadata struct<fps:double,frame_count:bigint,width:bigint,height:bigint>, "
    f"objects array<{OBJECT}>, narration_constraints struct<forbidden_phrases:array<string>,"
    "forbidden_patterns:array<string>,maximum_duplicate_events:bigint,notes:string>"
)
MANIFEST = (
    "schema_version string, dataset_id string, videos array<struct<id:string,category:string,"
    "video_paths:array<string>,annotation_path:string,recommended_class_ids:array<bigint>,"
    "expected_size_bytes:bigint,expected_sha1:string,expected_duration_seconds:double>>"
)
RUN_SUMMARY = (
    "videos array<struct<video_id:string,status:string,effective_fps:double,"
    "realtime_factor:double,source_fps:double,elapsed_s:double,average_inference_ms:double,"
    "output_jsonl:string>>"
)
CLASS_MAPPING = "classes array<string>, label_map map<string,string>"
CVAT_BOX = (
    "_name string, _width int, _height int, box array<struct<_label:string,_xtl:double,"
    "_ytl:double,_xbr:double,_ybr:double>>"
)
CVAT_POLYGON = (
    "_name string, _width int, _height int, polygon array<struct<_label:string,_points:string>>"
)
