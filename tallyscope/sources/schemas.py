"""Schemas of the tables that enter and leave the engine, as DDL; nothing is inferred."""

VIDEO = "relative_path string, split string, label string, class_directory string, size_bytes bigint, readable boolean, fps double, frame_count int, width int, height int, duration_seconds double, error string"
DETECTION = "clip bigint, frame bigint, det_idx int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
TRACK = "clip bigint, frame bigint, track_id bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
EVENT = "clip bigint, frame bigint, event_type string, description string, confidence double, evidence array<string>, object_id bigint, object_ids array<bigint>, timestamp_seconds double"
WINDOW_SCORE = "split string, clip string, window_index int, first_frame int, last_frame int, true_label string, fight_probability double"
PREDICTION = "index int, true_label string, fight_probability double, predicted_label string"
ARCHIVE_ENTRY = "path string, size bigint, crc string"
