"""Structured Streaming forms of the daily roll-up, the learner and the monitor."""
