"""Spark jobs that prepare business-contact tables for delivery."""
