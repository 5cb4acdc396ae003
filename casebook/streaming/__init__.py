"""Streams of arriving reports."""
