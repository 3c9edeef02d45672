"""Micro-batch drivers: the reference's one-request-at-a-time write routes as Structured Streaming."""
