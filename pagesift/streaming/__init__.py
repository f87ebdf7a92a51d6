"""Structured Streaming jobs: incremental pipeline and stateful response correlation."""
