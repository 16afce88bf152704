"""Errors of the engine: a category and a message."""

from __future__ import annotations


class EngineError(Exception):
    """A diagnostic for the user of the engine. Categories: see the functions below."""

    def __init__(self, category: str, message: str):
        super().__init__(f"{category}: {message}")
        self.category, self.message = category, message


GENERAL, SYNTAX, CONSTRAINT, TYPE, STORAGE, CONFLICT, UNKNOWN = "Error", "Syntax Error", "Constraint Error", "Type Error", "Storage Error", "Transaction Conflict", "Commit Outcome Unknown"


def general(message: str) -> EngineError:
    return EngineError(GENERAL, message)


def syntax(message: str) -> EngineError:
    return EngineError(SYNTAX, message)


def constraint(message: str) -> EngineError:
    return EngineError(CONSTRAINT, message)


def type_error(message: str) -> EngineError:
    return EngineError(TYPE, message)


def storage(message: str) -> EngineError:
    return EngineError(STORAGE, message)


def conflict(message: str) -> EngineError:
    return EngineError(CONFLICT, message)
