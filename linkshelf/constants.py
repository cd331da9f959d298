"""Fixed values.

Every table here is a fixed value of the data contract (names, markers,
thresholds and formats that results must reproduce), written in its natural order.
"""

from __future__ import annotations

# --- taxonomy: category -> folder, in prompt order (fixed values) ---------------
CATEGORY_FOLDERS = {
    "Saved Music": "Music",
    "Movies & Shows": "Movies & Shows",
    "Study Tips": "Study Tips",
    "Tips": "Tips",
    "Project Ideas": "Project Ideas",
    "Fitness & Health": "Fitness & Health",
    "Recipes & Food": "Recipes & Food",
    "Tech & Coding": "Tech & Coding",
    "Art/Organization/Spaces": "Art & Spaces",
    "Relationships/Dating": "Relationships",
    "Comedy/Funny": "Comedy",
    "Sports": "Sports",
    "Travel": "Travel",
    "Miscellaneous": "Inbox",
}
CATEGORIES = list(CATEGORY_FOLDERS)
CATEGORY_ALIASES = {"Music": "Saved Music"}
DEFAULT_CATEGORY = "Miscellaneous"
DEFAULT_FOLDER = "Inbox"
DEFAULT_SUMMARY = "No summary"
MANUAL_REVIEW_FOLDER = "Inbox/Manual Review"
LIBRARY_ROOT = "3 - Resources"
PROJECTS_ROOT = "1 - Projects"

# Guidance for categories that are easily confused (fixed values).
CATEGORY_HINTS = {
    "Study Tips": "Study methods, exams, note-taking, and learning techniques (not general life hacks).",
    "Tips": "Crafts, DIY, life hacks, and practical how-tos (not study, health, food, or software).",
    "Fitness & Health": "Workouts plus health, sleep, wellness, and nutrition advice (not full recipes).",
    "Art/Organization/Spaces": "Room layout, decor, organization, and visual art spaces.",
}

MUSIC = "Saved Music"
FITNESS = "Fitness & Health"
RECIPES = "Recipes & Food"
MOVIES = "Movies & Shows"
TECH = "Tech & Coding"
PROJECTS = "Project Ideas"
TRAVEL = "Travel"
ACTIONABLE = [MUSIC, FITNESS, RECIPES]
HIGH_VALUE = [TECH, PROJECTS, MOVIES]
AMBIGUOUS = "Other / Ambiguous"

SAVED_TAG = "saved-media"

# --- URL parameters that never identify content (fixed values) -------------------
TRACKING_PARAMS = [
    "igsh", "igshid", "fbclid", "mibextid",
    "is_from_webapp", "sender_device", "sender_web_id", "share_app_id", "share_link_id",
    "share_item_id", "share_author_id", "social_share_type", "tt_from", "u_code",
    "preview_pb", "timestamp", "user_id", "_r", "_t", "_d", "checksum", "sec_uid",
    "gclid", "dclid", "msclkid", "si", "ref_src", "ref_url",
]
TRACKING_PREFIX = "utm_"

# --- fetch-failure markers, lower case (fixed values) -----------------------------
PERMANENT_MARKERS = [
    "video unavailable",
    "private video",
    "this video is private",
    "has been removed",
    "was deleted",
    "account is private",
    "not available in your country",
    "geo restricted",
    "geo-restricted",
    "unsupported url",
    "404: not found",
    "http error 404",
    "requested content is not available",
    "login required",
    "requires login",
    "log in to",
    "sign in to confirm your age",
]
TRANSIENT_MARKERS = [
    "http error 429",
    "too many requests",
    "rate-limit",
    "rate limit",
    "http error 500",
    "http error 502",
    "http error 503",
    "http error 504",
    "timed out",
    "timeout",
    "connection reset",
    "connection aborted",
    "temporary failure in name resolution",
    "remote end closed connection",
    "unable to download webpage",
]
MUSIC_ONLY_MARKERS = [
    "instrumental", "no speech", "no spoken", "pure music", "music only", "just music",
]

# Claims of a numbered or ranked list, case-insensitive (fixed pattern).
LIST_CLAIM_PATTERN = (
    r"\b(top|best|favou?rite|my)\s+\d{1,2}\b"
    r"|\b\d{1,2}\s+(best|places|things|songs|albums|books|movies|shows|destinations|spots|tips|ways|"
    r"foods|restaurants|products|apps|tools|hacks|cities|countries|beaches|recipes)\b"
    r"|\bfavou?rite\s+(songs|albums|books|movies|places|artists|records)\b"
    r"|\branking\b|\btier\s+list\b"
)

# --- file names (fixed values) -----------------------------------------------------
ILLEGAL_NAME_CHARS = r'[\\/*?:"<>|]'
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]
BOARD_SUFFIXES = ["Hub.md", "Kanban.md", "Map.md"]

# Front-matter keys in write order (fixed values).
KEY_ORDER = [
    "category", "creator", "url", "status", "stage", "tags", "summary",
    "location", "location_name", "weight", "mapMarkerColor",
]

# --- pin colour by reference count: (minimum weight, colour) (fixed values) ---------
WEIGHT_COLORS = [(6, "#EF5350"), (3, "#FFA726"), (1, "#42A5F5")]
WEIGHT_ZERO_COLOR = "#9E9E9E"

# --- extracted item kind -> category (fixed values) ---------------------------------
KIND_CATEGORY = {
    "destination": "Travel",
    "album": "Saved Music",
    "song": "Saved Music",
    "movie": "Movies & Shows",
    "recipe": "Recipes & Food",
    "product": "Miscellaneous",
    "tool": "Tech & Coding",
    "workout": "Fitness & Health",
    "health_tip": "Fitness & Health",
    "study_tip": "Study Tips",
    "tip": "Tips",
    "other": "Miscellaneous",
}
ITEM_KINDS = list(KIND_CATEGORY)

MEDIA_SHAPES = [
    "standard_video", "slideshow_video", "carousel_images", "photo_slideshow", "silent_video",
    "music_only", "speech_heavy", "text_on_screen", "unavailable",
]
SLIDESHOW_SHAPES = ["slideshow_video", "photo_slideshow", "carousel_images"]
MAX_PLAUSIBLE_SLIDES = 35

TAG_VOCABULARY = [
    "tutorial", "list-or-ranking", "review", "recommendation", "recipe", "travel-guide",
    "music", "humor", "motivational", "news", "sponsored-or-ad", "mature-content",
]

# --- statuses and stages (fixed values) ----------------------------------------------
HUMAN_STATUSES = ["kept", "promoted", "tossed"]
TERMINAL_ANALYSIS = ["done", "unavailable", "needs-review", "manual-review"]
LEGACY_STATUS_STAGE = {
    "to watch": "to-watch",
    "manual-review": "manual-review",
    "ready": "ready",
    "archived": "archived",
}
ROUTE_TAGS = {
    "mapped": "travel/mapped",
    "unmapped-travel": "travel/unmapped",
    "manual-review": "travel/manual-review",
}
MODEL_OWNED_FOLDERS = ["Music", "Fitness & Health", "Recipes & Food", "Travel"]

# --- thresholds (fixed values) ----------------------------------------------------------
TITLE_CHARS = 70
CAPTION_CHARS = 90
SPARSE_CAPTION_CHARS = 40
MIN_TRANSCRIPT_CHARS = 20
MIN_TRANSCRIPT_WORDS = 25
MIN_SPEECH_RATIO = 0.2
SPOKEN_LIST_WORDS = 120
CLASSIFIER_MIN_CONFIDENCE = 0.7
NEEDS_VISUALS_THRESHOLD = 0.5
TAG_THRESHOLD = 0.5
HIGH_VALUE_THRESHOLD = 0.65
TRAVEL_THRESHOLD = 0.50
ACTIONABLE_THRESHOLD = 0.60
MAX_ATTEMPTS = 3
MAX_PASSES = 3
MAX_VIDEO_SECONDS = 180.0
MAX_STATE_CHARS = 24000
KEYFRAME_INTERVAL = 8.0
MAX_KEYFRAMES = 16
DENSE_KEYFRAME_CAP = 48
CUT_THRESHOLD = 0.35
MARKER_SECONDS = 10.0
NO_SPEECH_MAX = 0.6
LOGPROB_MIN = -1.0
BATCH_SIZE = 100
ENRICH_BATCH_SIZE = 10
PROMPT_VERSION = "3"
EST_OUTPUT_TOKENS = 900
TOKENS_PER_IMAGE = 300
CLASSIFIER_PRICE_PER_M = 0.042
QUOTA_ZONE = "America/Los_Angeles"

# Whitespace that text stripping removes (fixed values), as characters and as a regex class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
