"""Civic-incident analytics as DataFrame jobs, and operators for training data in the subpackage llm."""
