"""Streaming use of the stateless text functions.

The reference has no streaming operators (no windows, watermarks or state),
so nothing stateful is built here. Every cleaner and feature in
``eventlens.functions`` is a plain Column expression and the row filters use
a generator instead of a pushed-down filter, so the same code runs on a
``readStream`` DataFrame.
"""

from eventlens.streaming.features import stream_emotion_features, stream_posts

__all__ = ["stream_emotion_features", "stream_posts"]
