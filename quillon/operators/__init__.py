"""Expressions, frames and aggregates."""
