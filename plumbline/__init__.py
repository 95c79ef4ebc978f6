"""Declarative data quality on Spark: rules as rows, fused checks, scores, profiles, alerts."""
