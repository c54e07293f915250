"""Typed Markdown documents as Spark columns."""
