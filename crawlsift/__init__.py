"""Differential web-crawl analytics as Spark DataFrame jobs."""
