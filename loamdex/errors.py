"""What can go wrong, by kind. Query errors are raised on the driver before any job starts."""


class LoamdexError(Exception):
    """Base of all errors of the engine."""


class IoError(LoamdexError):
    pass


class StorageError(LoamdexError):
    """A snapshot that can't be read, a lost pointer, a second writer."""


class SchemaError(LoamdexError):
    pass


class QueryParse(LoamdexError):
    pass


class QueryRejected(LoamdexError):
    """A query that parses but would have to look at everything."""


class UnknownField(LoamdexError):
    pass


class TypeMismatch(LoamdexError):
    pass


class CursorError(LoamdexError):
    pass


class FeatureMissing(LoamdexError):
    pass


class NotFound(LoamdexError):
    pass


class JsonError(LoamdexError):
    pass


class InternalError(LoamdexError):
    pass


class InvalidArgument(LoamdexError):
    pass
