"""Row layouts and closed label domains shared by every module."""

from __future__ import annotations

# Label domains, in the order the design enumerates them.
CATEGORIES = ("serif", "non-serif", "mono", "handwriting", "other")
WEIGHTS = ("thin", "regular", "bold", "black")
MODIFIERS = ("regular", "italic", "underline", "strikethrough", "small-caps")
LEVELS = ("tight", "normal", "loose")
WIDTHS = ("narrow", "medium", "wide")

# Numeric meaning of the labels.
WEIGHT_CSS = {"thin": 200, "regular": 400, "bold": 700, "black": 900}
KERNING_EM = {"tight": -0.05, "normal": 0.0, "loose": 0.12}
LINE_HEIGHT_RATIO = {"tight": 1.15, "normal": 1.45, "loose": 1.9}
FONT_SIZE_PX = 22

# Metadata every package carries, and the providers a catalog may name.
PACKAGE_TAGS = ("typography", "font-identification", "vlm")
PROVIDERS = ("anthropic", "openai", "google")
MAX_ENABLED_PER_PROVIDER = 5
CATALOG_VERSION = 1
DEFAULT_MAX_OUTPUT_TOKENS = 1024

# Reply fields in the order they are asked for; `font` is open, the others are closed.
REPLY_FIELDS = ("font", "category", "weight", "modifier", "kerning", "line_height")
REPLY_DOMAINS = {
    "category": CATEGORIES,
    "weight": WEIGHTS,
    "modifier": MODIFIERS,
    "kerning": LEVELS,
    "line_height": LEVELS,
}
PASS_COLUMNS = tuple(f"{field}_pass" for field in REPLY_FIELDS)


# DDL of the JSON files read with an explicit schema.
TRUTH_JSON = (
    "taskId string, harborTaskId string, canonical string, aliases array<string>, category string,"
    " weight string, modifier string, kerning string, lineHeight string, widthId string, widthPx double"
)
MANIFEST_JSON = (
    "taskId string, imageSha256 string, fontName string, aliases array<string>, category string,"
    " weight string, modifier string, kerning string, lineHeight string, widthId string, widthPx double"
)
ATTEMPT_JSON = (
    "attempt_id bigint, model_id string, task_id string, ts timestamp, status string, reply string,"
    " input_tokens bigint, output_tokens bigint"
)

SUCCESS = "success"
