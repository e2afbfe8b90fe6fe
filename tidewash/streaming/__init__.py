from .apply import clean_stream

__all__ = ["clean_stream"]
