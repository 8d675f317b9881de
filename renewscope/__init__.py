"""Subscription trajectory analytics expressed as Spark DataFrame plans."""

from renewscope.config import StudyConfig

__all__ = ["StudyConfig"]
