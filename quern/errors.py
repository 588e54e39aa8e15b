"""What the engine raises."""

from __future__ import annotations


class QuernError(Exception):
    """The base of all errors of the engine."""


class StorageError(QuernError):
    """A database folder that cannot be read."""


class ParseError(QuernError):
    """Text that is not a statement of the dialect; ``position`` is the offending character's."""

    def __init__(self, message: str, position: int | None = None) -> None:
        super().__init__(message if position is None else f"{message} (at character {position})")
        self.position = position


class SchemaError(QuernError):
    """Unknown or clashing tables, columns and indexes."""


class IntegrityError(QuernError):
    """A violated NOT NULL, UNIQUE or PRIMARY KEY."""


class TypeMismatchError(QuernError):
    """A value that its column's declared type cannot hold."""


class TransactionError(QuernError):
    """BEGIN, COMMIT or ROLLBACK out of place, or a commit that another writer has overtaken."""
