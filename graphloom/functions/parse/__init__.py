"""Parsers: source text to facts."""
