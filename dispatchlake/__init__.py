"""Incident-feed analytics on Spark."""
