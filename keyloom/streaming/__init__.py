from .tail import appended, key_counts

__all__ = ["appended", "key_counts"]
