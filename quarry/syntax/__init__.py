"""Pluggable syntax backends: text in, language-neutral facts out."""
