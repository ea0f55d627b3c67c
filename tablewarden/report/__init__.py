"""Renderings of a run's result: pure functions of the result document."""

from .render import html, human, json_text, junit, openlineage

__all__ = ["html", "human", "json_text", "junit", "openlineage"]
