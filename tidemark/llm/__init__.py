"""Operators on text corpora for language models. Nothing outside this subpackage imports it."""
