from .cborkv import register

__all__ = ["register"]
