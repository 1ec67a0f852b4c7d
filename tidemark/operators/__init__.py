"""Operators from DataFrame to DataFrame: profile, semantic types, anomalies, healing, scores, reports."""
