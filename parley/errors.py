"""Exceptions raised by loaders and gates."""


class SchemaError(ValueError):
    """An input table lacks required columns."""


class UploadError(ValueError):
    """An uploaded comment file cannot be used."""


class ValidationError(RuntimeError):
    """A strict quality gate failed."""
