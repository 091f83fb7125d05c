"""Versioned-snapshot analytics and corpus operators on Spark."""
