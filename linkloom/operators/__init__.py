"""Relational operators: retrieval, fusion, selection, metrics, mining, validation."""
