"""Incremental forms of W1 and M1 for turns that arrive over time."""

from turnscore.streaming.history import score_micro_batches, stream_dialogue_context

__all__ = ["stream_dialogue_context", "score_micro_batches"]
