"""Codecs of float columns, the chunked container, and text and binary sources."""
