"""Compositions: page ingestion, the ten transformation stages, question answering."""
