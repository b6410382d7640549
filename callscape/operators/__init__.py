"""Analyses as functions from DataFrame to DataFrame."""
