"""Parsers of feeds, pages and listings, and sinks."""
