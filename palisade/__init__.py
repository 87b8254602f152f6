"""Palisade: scanning of untrusted content, and detector evaluation, on Spark DataFrames."""
