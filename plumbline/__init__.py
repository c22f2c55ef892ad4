"""Evaluation analytics for retrieval-augmented question answering, on Spark."""

from plumbline.session import build_session

__all__ = ["build_session"]
