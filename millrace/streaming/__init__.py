"""Structured Streaming jobs: incremental loads and admission counts."""
