"""Recruitment and career-planning analytics as Spark DataFrame operators."""
