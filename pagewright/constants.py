"""Limits and word lists of retrieval, grounding and ingestion. Results depend on them."""

VECTOR_LIMIT = 12
LEXICAL_LIMIT = 12
FINAL_LIMIT = 6
FUSION_K = 60
VECTOR_WEIGHT = 0.65
LEXICAL_WEIGHT = 0.35
KEYWORD_BONUS = 0.1
MAX_TERMS = 12
MAX_CITATIONS = 4
HISTORY_TURNS = 20
ROUTING_TURNS = 4
SNIPPET_MARGIN = 100

CHUNK_WORDS = 450
CHUNK_OVERLAP = 75
EMBEDDING_WIDTH = 1536
EMBEDDING_BATCH = 64
PAGE_BATCH = 32
SUMMARY_BATCH = 10
DELETE_BATCH = 128
MAX_PAGES = 100

LIST_DOCUMENTS = 50
LIST_CONVERSATIONS = 50
LIST_MESSAGES = 200
LIST_PAGES = 128
RECENT_EVENTS = 10

MAX_ATTEMPTS = 3
RETRY_SECONDS = (15, 60)
RESERVATION_SECONDS = 30 * 60
URL_SECONDS = 15 * 60
URL_CACHE_SECONDS = 840
PENDING_SLACK_MS = 5000

EMPTY_PAGE_SUMMARY = "No meaningful extractable text on this page."
EMPTY_DOCUMENT_SUMMARY = "No meaningful extractable text was found in this document."
NO_ANSWER = "I could not generate a response. Please try again."
STATUSES = ("uploading", "uploaded", "processing", "ready", "failed")
ROLES = ("user", "assistant")

STOP_WORDS = (
    "a an and are as at be by for from how in is it of on or that the this to what when where which who why with"
).split()
SUMMARY_PHRASES = r"summar(?:ize|y)|overview|key findings|takeaways?|main points?|what is this document about"
TRANSIENT_HTTP = (408, 429, 500, 502, 503, 504)
TRANSIENT_CODES = (4, 8, 13, 14)
TRANSIENT_ERRNO = ("ECONNRESET", "ETIMEDOUT", "EAI_AGAIN")
TRANSIENT_PHRASES = ("timeout", "temporarily unavailable", "connection reset", "rate limit")

# A step's name, what it waits for, and what it says while it is active, when it failed, and when it is done.
STEPS = [
    ("upload", None, "Uploading to storage...", "Upload failed", " pages · "),
    ("ocr", "Waiting for upload to complete", "Running OCR on document pages...", "OCR failed", " pages processed"),
    ("embedding", "Waiting for OCR", "Embedding pages...", "Embedding failed", " pages embedded"),
]
