"""Spark jobs for quantitative-equity research at scale."""
