"""Readers: call records, dimensions, annotations, stored results."""
