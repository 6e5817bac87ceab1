"""Stateless Column expressions."""

from eventlens.functions.encoding import is_encoding_suspect, repair_encoding, to_mojibake
from eventlens.functions.text import (
    clean_display,
    clean_emotion,
    clean_semantic,
    emoji_count,
    exclamation_count,
    hashtag_count,
    question_count,
    tweet_length,
    uppercase_word_count,
    word_count,
)
from eventlens.functions.timewin import global_window, parse_timestamp, time_window

__all__ = [
    "clean_display", "clean_emotion", "clean_semantic", "emoji_count", "exclamation_count",
    "hashtag_count", "question_count", "tweet_length", "uppercase_word_count",
    "word_count", "is_encoding_suspect", "repair_encoding", "to_mojibake", "global_window",
    "parse_timestamp", "time_window",
]
