"""Stateful versions of the filters and estimators for Structured Streaming."""
