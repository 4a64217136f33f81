"""Conversation analytics as Spark jobs."""
