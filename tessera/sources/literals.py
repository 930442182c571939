"""Fixed values that must equal the evaluated toolkit's for right results.

Everything in this module is data, stated as text in its natural order.
"""

# --- fixed values: model registries -------------------------------------
# Document evaluation models (name, model id), in evaluation order.
DOCUMENT_MODELS = [
    ("bge-small-en-v1.5", "BAAI/bge-small-en-v1.5"),
    ("all-MiniLM-L6-v2", "sentence-transformers/all-MiniLM-L6-v2"),
    ("gte-large", "thenlper/gte-large"),
]
# Pair comparison models (name, model id), in comparison order.
PAIR_MODELS = [
    ("bge-small-en-v1.5", "BAAI/bge-small-en-v1.5"),
    ("bge-base-en-v1.5", "BAAI/bge-base-en-v1.5"),
    ("all-MiniLM-L6-v2", "sentence-transformers/all-MiniLM-L6-v2"),
    ("multilingual-e5-large", "intfloat/multilingual-e5-large"),
    ("multilingual-MiniLM-L12-v2", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"),
    ("gte-large", "thenlper/gte-large"),
    ("nomic-embed-text-v1.5", "nomic-ai/nomic-embed-text-v1.5"),
]
# Reduced list used when the "use default models" flag is false.
REDUCED_MODELS = [
    ("bge-small-en-v1.5", "BAAI/bge-small-en-v1.5"),
]
# Text values accepted as "true" for the default-models flag (case-insensitive).
TRUE_FLAG_VALUES = ["true", "yes", "1", "on"]

# --- fixed values: human-scored pairs (text1, text2, human_score) --------
EVALUATION_PAIRS = [
    ("I love listening to rock music.", "Rock music is my favorite genre.", 0.9),
    ("This album has complex jazz fusion elements.", "The record incorporates experimental jazz techniques.", 0.85),
    ("The vocalist has a powerful voice.", "The guitar solos are impressive.", 0.3),
    ("This hip-hop album addresses social issues.", "The rapper discusses political topics in their lyrics.", 0.8),
    ("The production quality is excellent.", "The album sounds terrible.", 0.1),
]

# --- fixed values: parsing and query generation --------------------------
HEADER_MAX_CHARS = 50          # a header is shorter than this and does not end in "."
SENTENCE_MIN_CHARS = 20        # a sentence is kept when longer than this
SECTION_PARAGRAPH_MIN_CHARS = 50  # a section paragraph is longer than this
SENTENCE_DELIMITERS = "[.!?]"
MAX_TOPICS = 5
MAX_QUERIES = 7
MIN_TOPIC_QUERIES = 3
KEYWORD_MIN_CHARS = 3          # a keyword is longer than this
KEYWORD_STOP_WORDS = ["what", "when", "where", "which", "about", "does"]
EXTRA_KEYWORDS = ["information", "details"]
TOPIC_QUERY_PREFIX = "What does the document say about "
TOPIC_QUERY_SUFFIX = "?"
TOP_K = 3

# Default query set, used when no query set is given.
DEFAULT_QUERIES = [
    ("What is the main topic of this document?",
     ["main", "topic", "about", "focuses", "primary"]),
    ("What are the key components or features described?",
     ["components", "features", "elements", "parts", "aspects"]),
    ("What is the history or background information provided?",
     ["history", "background", "origins", "began", "started"]),
    ("What technical details are mentioned?",
     ["technical", "details", "specifications", "numbers", "statistics"]),
    ("What benefits or advantages are described?",
     ["benefits", "advantages", "positive", "improve", "better"]),
    ("What challenges or problems are discussed?",
     ["challenges", "problems", "issues", "difficulties", "concerns"]),
    ("What future developments are mentioned?",
     ["future", "developments", "upcoming", "next", "plans"]),
]

# Generic query set, replacing topic queries when fewer than 3 exist.
GENERIC_QUERIES = [
    ("What is the main subject of this document?",
     ["main", "subject", "topic", "about", "focuses"]),
    ("What key information is presented in this text?",
     ["key", "information", "important", "central", "critical"]),
    ("What are the main points discussed?",
     ["points", "arguments", "ideas", "concepts", "discussed"]),
    ("What conclusions or recommendations are made?",
     ["conclusions", "recommendations", "summary", "suggests", "proposes"]),
    ("What evidence or examples are provided?",
     ["evidence", "examples", "instances", "cases", "illustrations"]),
]

# --- fixed values: scoring -----------------------------------------------
WEIGHT_COHERENCE = 0.3
WEIGHT_CONTRAST = 0.3
WEIGHT_PRECISION = 0.4

# Placeholder result written when no evaluation exists yet.
PLACEHOLDER_NAME = "empty"
PLACEHOLDER_MODEL_ID = "none"

# a line that a document has when it is sent a second time (own text)
LATER_LINE = "This closing line was added when the document was sent for the second time."

# fixed values of the display: digits of scores and of times, least contrast of a chart
SCORE_DIGITS = 4
TIME_DIGITS = 2
LEAST_SHOWN_CONTRAST = -1.0
