"""Preparation of text for language models. Nothing outside this subpackage imports it."""
