"""Structured Streaming: roll-ups and stateful packet decoding."""
