"""Errors that carry a code, so that callers can react without reading the message."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str, **details: object):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details
