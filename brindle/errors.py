"""Errors of the dialect."""

from __future__ import annotations


class EngineError(Exception):
    """A statement that can't be carried out."""


class SyntaxProblem(EngineError):
    """A statement that can't be parsed; shows the line and points at the column."""

    def __init__(self, source: str, at: int, message: str) -> None:
        at = min(at, len(source))
        start = source.rfind("\n", 0, at) + 1
        end = source.find("\n", at)
        self.line, self.column = source.count("\n", 0, at) + 1, at - start + 1
        text = source[start : len(source) if end < 0 else end]
        super().__init__(f"sql syntax error (line {self.line}, col {self.column}): {message}\n  {text}\n  {' ' * (self.column - 1)}^")


class ConstraintViolation(EngineError):
    """A row that a constraint rejects."""
