"""noteloom: hybrid note retrieval and its analytics as Spark plans."""

__all__ = ["session"]
