"""Structured Streaming operators and their batch forms."""
