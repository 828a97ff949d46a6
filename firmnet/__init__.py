"""Firm similarity and industry networks as Spark DataFrame operations."""
