class InsufficientDataError(ValueError):
    """Fewer rows than an operation needs."""


class MissingInputError(FileNotFoundError):
    """No file where one is needed."""
