"""Structured documents as DataFrames: parse, validate, transform, render and format tagged Markdown on Spark."""
