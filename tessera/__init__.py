"""Tessera: conversational product search, retrieval analytics and corpus pipelines on Spark."""
