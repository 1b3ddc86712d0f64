"""Operators for building training corpora at scale. Nothing outside this folder imports it."""
