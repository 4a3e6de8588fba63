"""notemill: retrieval, link analytics and table hygiene for note collections, as Spark plans."""

__version__ = "0.1.0"
FORMAT_VERSION = 3
