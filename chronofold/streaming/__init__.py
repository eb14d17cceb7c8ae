"""Structured Streaming: tails of run logs, gaps with state, counts with a watermark."""
