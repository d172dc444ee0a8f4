"""Structured Streaming entry points.

The reference has no stream; its labelling and every row-local function are
stateless, so they run unchanged on a streaming DataFrame against a static
publication side (a stream-static join).
"""
