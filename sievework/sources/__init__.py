"""Readers, ingest normalisation and sinks."""
