"""millrace: retrieval, document analytics and incremental loads as Spark jobs."""

__version__ = "0.1.0"
