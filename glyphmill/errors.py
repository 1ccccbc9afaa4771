"""Error classes. In DataFrames they show as an ``error_class`` column with one of these names."""


class DocumentError(Exception):
    """Base of all errors of this package."""


class UnsupportedFormat(DocumentError):
    """The bytes are of no known format."""


class ExtractionError(DocumentError):
    """Every parser of the format failed."""


class EncodingError(DocumentError):
    """A legacy encoding could not be converted."""


class EngineUnavailable(DocumentError):
    """No parser is registered for the format."""


class MissingDependency(DocumentError):
    """A parser's optional library or program is not installed."""


class UnsafeInput(DocumentError):
    """The file is over a safety limit."""


class ConfigError(DocumentError):
    """A setting is invalid."""
