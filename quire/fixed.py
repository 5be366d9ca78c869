"""Word lists, limits, weights and codes that results depend on."""

# Function words dropped before stemming.
STEM_STOP = (
    "a an and are as at be been by can could do does for from has have how if in into is it its may "
    "must of on or our shall should so than that the their them then there these they this to was we "
    "were what when where which who will with would"
).split()

# Function words dropped by the search index.
INDEX_STOP = (
    "a an and any are as at be been by can could do does each every for from has have how i if in into "
    "is it its may must of on or our shall should so than that the their them then there these they this "
    "to us was we were what when where which who whom why will with would you your"
).split()

# Ranking constants.
BM25_K1, BM25_B = 1.2, 0.75
HEADING_WEIGHT = 3
PHRASE_BONUS = 2.0
FIELD_BOOST = {"text": 1.0, "heading": 3.0, "title": 0.5}
FIELD_K, FIELD_B, FIELD_D = 1.2, 0.4, 0.5
# FUZZY_MAX is the most edits the search library allows by its own default, however long the term.
PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY_FRACTION, FUZZY_MAX = 0.375, 0.45, 0.15, 6

# Sizes in characters and list lengths.
CHUNK_TARGET, CHUNK_LIMIT = 900, 1260
PASSAGE_TARGET = 2800
EXTRACT_BUDGET, EXTRACT_MAX = 12000, 12
MERGE_BUDGET = 24000
MAX_ALLOCATIONS, MAX_POLICIES, MAX_SUGGESTIONS = 40, 60, 80
MAX_BYTES, MIN_CHARS, MAX_CHARS = 15 * 1024 * 1024, 300, 650_000

# Statuses in report order, and the rank of those that are judged.
STATUSES = ["met", "partly", "missing", "not-assessable"]
STATUS_RANK = {"missing": 0, "partly": 1, "met": 2}

# Characters folded before quotes are compared.
FOLD_APOSTROPHE = "‘’‚‛′`´"
FOLD_QUOTE = "“”„‟″«»"
FOLD_DASH = "‐‑‒–—―−"
FOLD_SPACE = (
    "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
    "\t\r\n\f\u000b\u2022"
)
FOLD_NOTHING = "\u00ad\u200b\u200c\u200d\ufeff"
FOLD_ELLIPSIS = "…"

# Default timetable durations, in months (m) or weeks (w).
DURATIONS = {
    "notice_m": 4, "scoping_w": 4, "prep_w": 26, "content_w": 6, "collate_w": 20, "gateway2_w": 6,
    "revise_w": 8, "plan_w": 8, "finalise_w": 4, "gateway3_w": 4, "exam_m": 6, "pause_m": 0, "adoption_w": 4,
}

# Plan events, the milestone and side each is dated from, and whether it is required.
PLAN_EVENTS = [
    ("publish-notice-intention-commence", "notice", "start", True),
    ("scoping-consultation-start", "scoping", "start", True),
    ("scoping-consultation-end", "scoping", "end", True),
    ("gateway-1-self-assessment", "gateway-1", "start", True),
    ("plan-content-evidence-consultation-start", "content", "start", True),
    ("plan-content-evidence-consultation-end", "content", "end", True),
    ("gateway-2-advice-sought", "gateway-2", "start", True),
    ("gateway-2-advice-published", "g2-publish", "start", False),
    ("proposed-plan-consultation-start", "plan", "start", True),
    ("proposed-plan-consultation-end", "plan", "end", True),
    ("gateway-3-advice-sought", "gateway-3", "start", True),
    ("gateway-3-advice-published", "gateway-3", "end", False),
    ("examination-submitted", "submission", "start", True),
    ("examination-recommendations-published", "report-publish", "start", False),
    ("adopted", "adoption", "start", True),
]

# Milestones in creation order: id, label, phase, kind.
MILESTONES = [
    ("timetable", "Publish the local plan timetable", "get-ready", "milestone"),
    ("notice", "Notice of intention to commence", "get-ready", "milestone"),
    ("scoping", "Scoping consultation", "get-ready", "window"),
    ("gateway-1", "Gateway 1: publish the self-assessment summary", "get-ready", "milestone"),
    ("scoping-summary", "Publish the summary of scoping consultation", "prepare", "milestone"),
    ("content", "Consultation on proposed plan content and evidence", "prepare", "window"),
    ("sea-scope", "SEA consultation bodies respond on the environmental report scope", "prepare", "milestone"),
    ("content-summary", "Publish the summary of that consultation", "prepare", "milestone"),
    ("g2-notice", "Tell the Planning Inspectorate your Gateway 2 date", "prepare", "milestone"),
    ("gateway-2", "Gateway 2 assessment", "prepare", "window"),
    ("g2-publish", "Publish the Gateway 2 report and everything submitted", "prepare", "milestone"),
    ("plan", "Consultation on the proposed local plan (and SDS conformity)", "prepare", "window"),
    ("plan-summary", "Publish the summary of the proposed plan consultation", "prepare", "milestone"),
    ("g3-notice", "Tell the Planning Inspectorate your Gateway 3 date", "prepare", "milestone"),
    ("gateway-3", "Gateway 3 assessment", "prepare", "window"),
    ("submission", "Submit the plan for examination", "examine", "milestone"),
    ("examination", "Examination", "examine", "window"),
    ("hearing-notice", "Publish hearing date, time, place and the Inspector's name", "examine", "milestone"),
    ("report", "Inspector's report received; fact-check within 5 days", "adopt", "milestone"),
    ("report-publish", "Publish the recommendations and reasons", "adopt", "milestone"),
    ("adoption", "Full council adopts the plan; adoption statement and SEA statement published", "adopt", "milestone"),
    ("policies-map", "Policies map published", "adopt", "deadline"),
    ("evaluation", "Plan evaluation report", "monitor", "milestone"),
    ("next-plan", "Latest date to pass Gateway 1 for the next plan", "monitor", "deadline"),
]
PHASES = ["get-ready", "prepare", "examine", "adopt"]

# What a report says of itself (the name is this library's own), and the types of document it may be about.
REPORT_SCHEMA = "plan-check-report"
REPORT_VERSION = 1
DOCUMENT_TYPES = ["docx", "pptx", "md", "txt"]
