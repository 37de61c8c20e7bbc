"""Combination-synergy analytics on Spark."""
