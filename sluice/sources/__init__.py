"""Sources: bounded and unbounded inputs as DataFrames."""

from sluice.sources.batch import (
    create_timestamped,
    create_values,
    digit_strings,
    empty,
    impulse,
    read_bounded,
    replay_from,
    sentence_words,
    vector_source,
)
from sluice.sources.sinks import capture_first, file_stream, foreach_batch, memory, write_text
from sluice.sources.stream import ticking, read_unbounded, register_replayable

__all__ = ["capture_first", "create_timestamped", "create_values", "digit_strings", "empty", "file_stream", "foreach_batch", "impulse", "memory", "read_bounded", "read_unbounded", "register_replayable", "replay_from", "sentence_words", "ticking", "vector_source", "write_text"]
