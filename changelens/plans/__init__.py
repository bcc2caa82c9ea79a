"""Whole runs: from input tables to written result tables."""
