"""Joins, aggregates, metrics, sampling, scoring, tournament and graph operators."""
