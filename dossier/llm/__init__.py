"""Operators for training-data pipelines; their queries are collected in ``dossier.llm.queries``."""
