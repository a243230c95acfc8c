"""Where statements, catalogs and cluster documents come from and go to."""

from .document import DocumentError, MissingSchemaVersion, UnsupportedSchemaVersion, read_document, write_document
from .statements import read_statements

__all__ = ["DocumentError", "MissingSchemaVersion", "UnsupportedSchemaVersion", "read_document", "read_statements", "write_document"]
