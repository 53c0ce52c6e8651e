"""Word lists, patterns and texts that decide results.

They must stay as they are for results to be comparable; the logic using them
is in the sibling modules.
"""

# --- fixed values: handles and links -------------------------------------
HANDLE = r"@[\p{L}\p{N}_]+"
ASCII_HANDLE = r"@[A-Za-z0-9_]+"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
URL = r"https?://[^\t-\r\x1c-\x20\x85\p{Z}]+"
URL_MARK = "[URL]"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"

# --- fixed values: replies that move the customer to private messages ------
DM_REDIRECT = [
    r"please?\s*(send|dm|direct\s*message)",
    r"(send|dm)\s*(us|me)\s*(a|your)",
    r"private\s*message",
    r"follow\s*(us|me)\s*(so|and)",
]

# --- own wording: what the drafting model is told once ---------------------
SYSTEM_PROMPT = (
    "You draft replies for a customer support team. Use only what the historical evidence says. "
    "Never claim to have looked at or changed an account, and never promise refunds or dates. "
    "If the evidence does not answer the message, ask for escalation. Answer with one JSON object."
)

# --- fixed values: explicit request for a person ---------------------------
HUMAN_REQUEST = [
    r"\bconnect\s+(?:me\s+)?(?:with\s+)?(?:a\s+)?human\b",
    r"\btalk\s+to\s+(?:a\s+)?(?:human|person|agent|representative)\b",
    r"\bspeak\s+to\s+(?:a\s+)?(?:human|person|agent|representative|someone|support)\b",
    r"\bhuman\s+(?:agent|person|support|please|rep)\b",
    r"\breal\s+person\b",
    r"\btransfer\s+me\b",
    r"\b(?:don't|dont|do\s+not)\s+want\s+(?:a\s+)?bot\b",
    r"\blive\s+agent\b",
    r"\bcustomer\s+service\s+(?:rep|agent|person)\b",
]

# --- fixed values: sensitive keywords, matched as substrings ---------------
SENSITIVE = [
    "legal", "lawsuit", "lawyer", "fraud", "unauthorized", "hack", "stolen",
    "death", "threat", "sue", "police", "discrimination", "harassment",
]

# --- fixed values: claims a drafted reply must not make --------------------
FORBIDDEN_CLAIMS = [
    "i checked your account",
    "i've checked your account",
    "i have checked your account",
    "i have fixed this",
    "i fixed this",
    "i escalated this",
    "i can see your account",
    "i have contacted the team",
    "i've updated your",
    "i have updated your",
]

# --- fixed values: keywords naming a cluster; earlier entries win ties ------
INTENT_KEYWORDS = {
    "account_access": ["login", "password", "sign in", "log in", "access", "locked", "cant log", "reset password"],
    "playback_issues": ["play", "song", "music", "stream", "buffer", "skip", "pause", "audio", "sound", "playing"],
    "billing_payment": ["payment", "charge", "bill", "subscribe", "subscription", "cancel subscription", "refund", "price", "premium", "plan"],
    "app_technical": ["app", "crash", "bug", "error", "update", "install", "download", "version", "device", "phone"],
    "playlist_library": ["playlist", "songs", "library", "save", "add", "remove", "delete", "collection", "liked"],
    "connectivity": ["offline", "connect", "wifi", "internet", "network", "download", "sync"],
    "feature_request": ["feature", "want", "wish", "would be nice", "suggestion", "need", "please add"],
    "cancellation": ["cancel", "unsubscribe", "stop", "end", "terminate", "close account"],
    "general_complaint": ["bad", "worst", "terrible", "hate", "awful", "disappointed", "frustrat", "annoyed"],
    "information_request": ["how", "where", "what", "when", "help", "question", "info", "know"],
    "device_compatibility": ["device", "speaker", "alexa", "google home", "smart", "cast", "bluetooth", "headphone"],
    "content_availability": ["available", "missing", "find", "search", "where is", "looking for", "album", "artist"],
}
DEFAULT_INTENT = "general_inquiry"

# --- fixed values: words that tie a past case to a predicted intent --------
INTENT_ALIGNMENT = {
    "playback_issues": ["play", "crash", "song", "music", "audio", "app"],
    "account_access": ["login", "password", "facebook", "account", "sign in"],
    "billing_payment": ["charge", "pay", "billing", "subscription", "refund", "family"],
}

# --- fixed values: account follow-up override ------------------------------
OVERRIDE_CONTEXT_WORDS = ["account", "login", "password", "@"]
OVERRIDE_MESSAGE_WORDS = ["@", "account", "detail"]
OVERRIDE_INTENT = "account_access"
OVERRIDE_BELOW = 0.6
OVERRIDE_CONFIDENCE = 0.75

# --- fixed values: difficulty ----------------------------------------------
QUESTION_WORDS = ["why", "how", "when", "what"]
HARD_WORDS = ["cancel", "refund", "legal", "fraud"]

# --- fixed values: canned replies ------------------------------------------
CANNED_REPLIES = {
    "default": "Thank you for reaching out! We're sorry to hear you're experiencing issues. "
               "Please send us a DM with your account details so we can look into this for you.",
    "account": "We understand your concern about your account. Please DM us with your "
               "username so we can investigate further.",
    "technical": "We're sorry for the trouble! Please try restarting the app and "
                 "clearing the cache. If the issue persists, DM us with details.",
}
CANNED_CONFIDENCE = 0.1

# --- fixed values: fallback replies (reply, summary, reason) ---------------
NO_EVIDENCE = (
    "I'm sorry, but I don't have enough information from the available support history to give you "
    "a reliable answer. I can escalate this to a support specialist.",
    "Insufficient retrieval evidence.",
    "insufficient retrieval evidence",
)
UNGROUNDED = (
    "I'm sorry, I cannot perform that action or verify those details at this time. "
    "Let me escalate this to a human specialist.",
    "Grounding validation failed for LLM response.",
    "grounding failure",
)
EMPTY_DRAFT = (
    "I'm sorry, I couldn't generate a response at this moment.",
    "Empty response from generator",
    "Empty LLM response",
)
UNPARSABLE_DRAFT = (
    "I'm sorry, I am having trouble processing the evidence to answer your query.",
    "Parse error",
    "Generation parsing error",
)
COMPLEX_REASON = "conflicting evidence or complex request"

# --- fixed values: escalation decisions (source, score, reason) ------------
ESCALATE = "ESCALATE_TO_HUMAN"
AUTO = "AUTO_HANDLE"
SCORES = {
    "explicit_human_request": 1.0,
    "sensitive_content": 0.9,
    "low_intent_confidence": 0.85,
    "insufficient_evidence": 0.8,
    "llm_recommendation": 0.75,
    "policy_and_confidence_gate": 0.1,
}
HUMAN_REASON = "Customer explicitly requested to speak with a human agent."
SENSITIVE_REASON = "Sensitive keywords detected: "
NO_CASES_REASON = "No historical cases retrieved"
GENERATOR_REASON = "LLM recommended escalation due to issue complexity"

# --- fixed values: rating dimensions ---------------------------------------
DIMENSIONS = [
    "relevance", "groundedness", "correctness", "helpfulness",
    "brand_consistency", "safety", "escalation_appropriateness",
]

# --- fixed values: golden set notes ----------------------------------------
MACHINE_NOTE = "AUTO-GENERATED - requires human verification"
NO_MACHINE_NOTE = "No machine suggestion - human labeling required"
REVIEW_PENDING = "AI-assisted draft — human review pending."

# --- fixed values: English stop words (Spark ML's public default list) -----
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can will just don should now i'll
you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()
