"""docloom: retrieval, document analytics and data-processing operators as Spark plans."""

__version__ = "0.1.0"
