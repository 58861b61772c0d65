"""Domains, formats and texts that results have to carry exactly as they stand here."""

ROLES = ("debug", "train", "validate", "frozen_unseen_test")
FROZEN_ROLE = "frozen_unseen_test"
LABELS = ("fall", "no_fall")
WINDOW_LABELS = ("fall", "no_fall", "unlabeled")
SCHEMA_VERSIONS = ("1.0", "1.1")
FORMAT_VERSION = "1.0"
CROSS_LISTED_DATASETS = ("le2i", "gmdcsa24")
VAULT_DATASETS = ("omnifall", "caucafall", "mcfd", "fallvision")
IN_SCOPE_DATASETS = ("urfd", "up_fall", "le2i", "gmdcsa24")
LIGHTING = ("daylight", "dim", "low_light", "mixed", "unknown")
OCCLUSION = ("none", "partial", "heavy", "unknown")
CONFUSERS = ("none", "sitting", "sleeping", "resting", "exercising", "crawling")
CONTEXTS = ("training", "tuning", "evaluation", "final_judgement", "unknown")
FROZEN_CONTEXTS = ("final_judgement",)
CLIP_ID_PREFIX, CLIP_ID_SUFFIX = "urfd-debug-", "-cam0-rgb"
FRAME_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
VIDEO_EXTENSIONS = ("avi", "mp4")
FRAME_LABELS = (-1, 0, 1)
SLICE_TAGS = ("lighting", "occlusion", "multi_person", "action_confuser")
NO_EVENTS, NO_ALERTS, NO_FPS = "no event GT available", "no alerts fired", "no fps / temporal metadata"
BOTH_ZERO, UNDEFINED = "precision and recall both zero", "precision or recall undefined"
NO_PREDICTED, NO_POSITIVE, NO_NEGATIVE = "no predicted positives in slice", "no actual positives in slice", "no negatives in slice"
ONE_CLASS = "only one class present in slice"
COMPONENT_REASONS = {
    "detection": "no detection ground truth",
    "tracking": "no tracking ground truth",
    "pose": "no pose ground truth",
    "pending": "component metric integration pending",
}
PROVENANCE = ("clip_id", "dataset", "label", "source_path", "track_id")
# The colour of a track: degrees of hue from one id to the next, saturation and value.
TRACK_HUE_STEP, TRACK_SATURATION, TRACK_VALUE = 47, 0.85, 0.95
# Fields of a frame's sidecar, in order; those of how it was cropped are one object between the others.
SIDECAR_FIELDS = ("clip_id", "dataset", "label", "source_path", "track_id", "frame_index", "frame_offset", "window_index", "missing_frame", "coverage")
SIDECAR_CROP, SIDECAR_LAST = ("output_size", "margin", "clip_length"), ("margin_used", "shard_filename")
