"""Statuses, limits, markers, messages and column names that results must carry exactly."""

PAGE_STATUSES = ("pending", "in_progress", "done", "flagged", "failed")
FINISHED = ("done", "flagged")
PAGE_TYPES = ("text", "blank", "illustration_only", "partial", "unreadable")
EMPTY_TYPES = ("blank", "illustration_only", "unreadable")
KEY_STATES = ("active", "cooldown", "exhausted", "dead")

# quality gate
MIN_TEXT_LENGTH = 20
REPEAT_WINDOW, REPEAT_TIMES = 40, 4
ILLEGIBLE, MAX_ILLEGIBLE = "[illegible]", 0.25
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
TOO_SHORT = "Classified as text but only {} characters were returned"
LOOP = "Output contains a repeated phrase loop"
TOO_ILLEGIBLE = "More than a quarter of the page was marked illegible"
HAS_CONTROL = "Output contains control characters"

# publishing
CELLS, CELL_CHARS, CHUNK_ROWS, CHUNK_CHARS, NAME_CHARS, STEM_CHARS = 4, 45_000, 150, 2_000_000, 95, 120
PLACEHOLDERS = {"blank": "[BLANK]", "illustration_only": "[IMAGE]", "unreadable": "[UNREADABLE]"}
TRUNCATED = "\n\n[TRUNCATED — this page exceeds what a sheet row can hold. Full text is in the JSON and .txt exports.]"
NOTES_TRUNCATED = "\n[TRUNCATED — see exports]"

# key quota
ZONE = "America/Los_Angeles"
WORKING_KEYS, RPM, RPD, REFUSALS, LEARN_FROM = 5, 10, 250, 4, 10
BACKOFF, MAX_BACKOFF, TRANSIENT_COOLDOWN = 15.0, 300.0, 30.0
DAILY_MARKERS = ("perday", "per day", "requests_per_day", "requestsperday", "daily limit")
DEAD_MARKERS = ("api_key_invalid", "api key not valid", "api_key", "permission_denied", "unauthenticated", "consumer_suspended", "project_denied", "billing", "disabled", "service_disabled")
SPENT = "Daily allowance spent"
LEARNED = "Daily limit reached at {} requests (learned from repeated 429s)"
PARKED = "Refused repeatedly after only {} request(s) today — parked until the next reset"
WAITING, SERVER_ERROR, REJECTED = "Rate limited, waiting {}s", "Server error, retrying: {}", "Key rejected: {}"
USAGE_FIELDS = ("usage", "usage_metadata", "usageMetadata")
INPUT_FIELDS = ("input_tokens", "prompt_token_count", "promptTokenCount")
OUTPUT_FIELDS = ("output_tokens", "candidates_token_count", "candidatesTokenCount")
MAX_ATTEMPTS, PROFILE_TRIES, KEPT_EVENTS, MOST_EVENTS = 3, 3, 5000, 1000
SNIPPET, LAST_ERROR = 400, 1000

# page images
DPI, BLANK_INK, HEAVY_INK, EMPTY_ROW_INK, MIN_EMPTY_ROWS, MAX_EMPTY_ROWS = 72, 0.002, 0.25, 0.005, 0.10, 0.85
REASONS = {"blank": "blank", "heavy": "mostly non-text (plate or dark scan)", "image": "no line structure (likely an image)", "sparse": "too sparse (title page or a few lines)", "text": "text"}
SAMPLES, FRONT_PAGES, SCAN_LIMIT = 3, 15, 40
STRATEGIES = ("after front matter", "whole book (fallback)", "no text pages found")
MIME = {"png": "image/png", "jpeg": "image/jpeg", "jpg": "image/jpeg", "webp": "image/webp"}
SKIP_DIRS = (".git", "__pycache__", ".Trash", "$RECYCLE.BIN")

# earlier application's backups
LEGACY_DONE = ("synced", "transcribed_unsynced")
LEGACY_EMPTY = "Classified as text but the old app returned no text"
