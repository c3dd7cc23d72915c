"""Column types of the persisted tables."""

from __future__ import annotations

AUDIO_TRACK = "struct<index:int,lang_tag:string,codec:string,channels:int>"
PROBE = f"struct<duration_s:double,width:int,height:int,vcodec:string,bitrate_kbps:bigint,audio_tracks:array<{AUDIO_TRACK}>>"
COLOR = "struct<clip:double,cast:double,saturation:double,contrast:double>"
ALIGNMENT = "struct<score:double,offset_s:double,coverage:double,superset:boolean,superset_dir:int,extra_ratio:double,interleaved_ratio:double,ad_dir:int>"

FILES = f"path string, mtime double, size bigint, content_hash string, feature_version string, probe {PROBE}, lang_detected string, cam_score double, audio_coverage double, color {COLOR}, global_vec array<float>, audio_fp array<bigint>, scene_cuts array<double>, indexed_at double"
FRAMES = "path string, frame_no int, ts double, vec array<float>"
WINDOWS = "path string, w int, vec array<float>"
MATCHES = f"a string, b string, verdict string, confidence double, reason string, ad_offset_s double, audio {ALIGNMENT}, video {ALIGNMENT}, scenes {ALIGNMENT}, created_at double"
LEDGER = "pair_hash string, fingerprint string"
CLUSTERS = "cluster_id bigint, path string, is_keep boolean, rank_reason string"
PROBLEMS = "path string, error string, mtime double, size bigint, category string, repair_note string"
FEEDBACK = "a string, b string, label string, note string"
DELETIONS = "path string, dest string, size bigint, deleted_at double"
OVERRIDES = "path string, kind string, mtime double, size bigint"
PENDING = "path string, mtime double, size bigint, seen_at double"

TABLES = {"files": FILES, "frames": FRAMES, "windows": WINDOWS, "matches": MATCHES, "ledger": LEDGER, "clusters": CLUSTERS, "problems": PROBLEMS, "feedback": FEEDBACK, "deletions": DELETIONS, "overrides": OVERRIDES, "pending": PENDING}
KEYS = {"files": ["path"], "frames": ["path", "frame_no"], "windows": ["path", "w"], "matches": ["a", "b"], "ledger": ["pair_hash"], "clusters": ["cluster_id", "path"], "problems": ["path"], "feedback": ["a", "b"], "deletions": [], "overrides": ["path", "kind"], "pending": ["path"]}

VERDICTS = ("CERTAIN", "VERY_HIGH", "HIGH", "NAME_COPY", "PROBABLE", "DIFFERENT_EDITION", "CONTAINS", "DIFFERENT")
STRONG = ("CERTAIN", "VERY_HIGH")
DUPLICATE = ("CERTAIN", "VERY_HIGH", "HIGH")
CLUSTERED = ("CERTAIN", "VERY_HIGH", "HIGH", "NAME_COPY")
