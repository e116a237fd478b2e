"""jobsieve: classified listings and job postings as Spark tables, queries and streams."""

__version__ = "0.1.0"
