"""Bulk cloud-cost estimation on Spark: price catalogs, cost lines and cost reports as DataFrame jobs."""
