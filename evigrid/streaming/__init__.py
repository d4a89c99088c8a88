"""Streams: the summaries of sensor events for events that keep arriving."""
