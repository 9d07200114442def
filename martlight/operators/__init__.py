"""Filters, joins, aggregates, cleaning, import, generation, quality and export jobs."""
