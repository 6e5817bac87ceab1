"""Text cleaning, feature and token expressions.

Every function here maps Column -> Column and compiles to built-in Catalyst
expressions (regexp_replace, regexp_count, length, split, ...), so it runs
inside whole-stage codegen on executors and works unchanged on streaming
DataFrames. No Python UDF is involved.

Regex dialect notes. Python's ``\\s``, ``\\S`` and ``\\w`` are Unicode-aware;
Java's differ (ASCII by default, and with (?U) ``\\w`` also takes marks). We
therefore spell the Python classes out explicitly so Java (Spark) and RE2
(the DuckDB oracle) see the same character sets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.encoding import repair_fully, repair_once

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference semantics)
# ---------------------------------------------------------------------------

# Python str whitespace (str.isspace), written as a character-class body.
WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Python str word characters (str.isalnum() or "_").
WORD = r"\p{L}\p{N}_"

# Emoji kept by the emotion cleaner, in the order the rule lists them.
EMOTION_KEEP_RANGES = (
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF),
)

# Emoji counted by emoji_count, in the order the rule lists them.
EMOJI_COUNT_RANGES = (
    (0x1F300, 0x1F5FF),
    (0x1F600, 0x1F64F),
    (0x1F680, 0x1F6FF),
    (0x1F700, 0x1F77F),
    (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF),
    (0x1F900, 0x1F9FF),
    (0x1FA00, 0x1FAFF),
)

# Minimum clean-text length is "strictly longer than" this.
MIN_CLEAN_LENGTH = 10

# Default English stop words: Spark ML's StopWordsRemover English list (181 words).
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot",
    "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
)


def _ranges(ranges) -> str:
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


# Patterns that must match what the reference's match (Java syntax; the oracle module derives RE2 twins from the same pieces).
P_HTTP = f"http[^{WS}]+"
P_WWW = f"www[^{WS}]+"
P_AT_ANY = f"@[^{WS}]+"
P_NOT_LOWER = "[^a-z]+"
P_NOT_EMOTION = f"[^a-zA-Z0-9{_ranges(EMOTION_KEEP_RANGES)}]+"  # what is dropped, and white space, in one run
P_WS_RUN = f"[{WS}]+"
P_URL = f"https?://[^{WS}]+|www\\.[^{WS}]+"
P_MENTION = f"@[{WORD}]+"
P_RT = f"^RT[{WS}]+"
P_LEAD_PUNCT = f"^[:\\-{WS}]+"
P_HASHTAG = f"#([{WORD}]+)"
P_BANG = "!{4,}"
P_QUESTION = "\\?{4,}"
P_MIXED = "!{3,}\\?{3,}"
P_CRLFTAB = "[\\r\\n\\t]"
P_EMOJI_RUN = f"[{_ranges(EMOJI_COUNT_RANGES)}]+"
P_UPPER_WORD = f"(?=[A-Z])(?<![{WORD}])[A-Z]{{2,}}(?![{WORD}])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bound(col, fn) -> Column:
    """``fn`` of a column that is computed once, however often ``fn`` names it."""
    return F.transform(F.array(_c(col)), fn)[0]


def _strip_links_and_mentions(lowered: Column) -> Column:
    # Sequential on purpose: a removal can change what the next pattern sees.
    t = F.regexp_replace(lowered, P_HTTP, "")
    t = F.regexp_replace(t, P_WWW, "")
    t = F.regexp_replace(t, P_AT_ANY, "")
    # the patterns run only on texts that hold what they begin with
    some = F.contains(lowered, F.lit("http")) | F.contains(lowered, F.lit("www")) | F.contains(lowered, F.lit("@"))
    return F.replace(F.when(some, t).otherwise(lowered), F.lit("#"), F.lit(""))


def clean_semantic(col) -> Column:
    """Lower; drop links, mentions and '#'; keep only a-z words single-spaced.

    Mapping every non [a-z] run to one space and trimming is the same as the
    two-step "non-letter -> space, collapse whitespace, strip".
    """
    return _bound(F.lower(_c(col)), lambda t: F.trim(F.regexp_replace(_strip_links_and_mentions(t), P_NOT_LOWER, " ")))


def clean_emotion(col) -> Column:
    """Like clean_semantic but keeps digits, upper case after lowering and four emoji ranges.

    Dropped characters become a space and runs of white space one, so a run of either or both is one space.
    """
    return _bound(F.lower(_c(col)), lambda t: F.trim(F.regexp_replace(_strip_links_and_mentions(t), P_NOT_EMOTION, " ")))


# --- display cleaning, one rule each (I4..I12) ------------------------------

def strip_urls(col) -> Column:
    return F.regexp_replace(_c(col), P_URL, "")


def strip_mentions(col) -> Column:
    return F.regexp_replace(_c(col), P_MENTION, "")


def strip_rt(col) -> Column:
    return F.regexp_replace(_c(col), P_RT, "")


def strip_lead_punct(col) -> Column:
    return F.regexp_replace(_c(col), P_LEAD_PUNCT, "")


def unhash(col) -> Column:
    return F.regexp_replace(_c(col), P_HASHTAG, "$1")


def cap_bang(col) -> Column:
    return F.regexp_replace(_c(col), P_BANG, "!!!")


def cap_question(col) -> Column:
    return F.regexp_replace(_c(col), P_QUESTION, "???")


def cap_mixed(col) -> Column:
    """I11. Inside clean_display it follows cap_bang/cap_question and is then a no-op."""
    return F.regexp_replace(_c(col), P_MIXED, "!!!???")


def squash_ws(col) -> Column:
    """tabs/newlines to space, collapse whitespace runs, strip."""
    t = F.regexp_replace(_c(col), P_CRLFTAB, " ")
    return F.trim(F.regexp_replace(t, P_WS_RUN, " "))


def clean_display(col, repair: bool = True, once: bool = False) -> Column:
    """Emotion-preserving display cleaning; null -> ''. ``once``: only one level of double encoding is repaired."""
    t = _c(col)
    if repair:
        t = repair_once(t) if once else repair_fully(t)
    for step in (strip_urls, strip_mentions, strip_rt, strip_lead_punct, unhash,
                 cap_bang, cap_question, cap_mixed, squash_ws):
        t = step(t)
    return F.coalesce(t, F.lit(""))


# --- features (I14..I19) ------------------------------------------------------

def count_char(col, ch: str) -> Column:
    c = _c(col)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("long")


def emoji_count(clean) -> Column:
    """Number of emoji runs (adjacent emoji count once)."""
    return F.regexp_count(_c(clean), F.lit(P_EMOJI_RUN)).cast("long")


def exclamation_count(clean) -> Column:
    return count_char(clean, "!")


def question_count(clean) -> Column:
    return count_char(clean, "?")


def hashtag_count(raw) -> Column:
    """I16: '#' characters in the raw text; null raw -> 0."""
    return F.coalesce(count_char(raw, "#"), F.lit(0).cast("long"))


def uppercase_word_count(raw) -> Column:
    """Whole words of two or more ASCII capitals; null raw -> 0."""
    return F.coalesce(F.regexp_count(_c(raw), F.lit(P_UPPER_WORD)).cast("long"), F.lit(0).cast("long"))


def tweet_length(clean) -> Column:
    return F.length(_c(clean)).cast("long")


def word_count(clean) -> Column:
    """Whitespace-split word count ('' has 0 words, unlike split's size 1)."""
    c = F.trim(F.regexp_replace(_c(clean), P_WS_RUN, " "))
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " "))).cast("long")


def has_min_length(clean, n: int = MIN_CLEAN_LENGTH) -> Column:
    """Keep text strictly longer than n characters."""
    return F.length(_c(clean)) > n


def term_filter(term_col, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Predicate for an exploded term column (Catalyst turns the IN list into a hash set)."""
    t = _c(term_col)
    return (F.length(t) >= 2) & ~t.isin(*stop_words)
