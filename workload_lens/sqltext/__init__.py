"""PostgreSQL statement texts: lexer, parser, canonical form, shape, casts."""

from .canon import cast_params, fingerprint, max_param_number, normalize, shape
from .lexer import SqlError

__all__ = ["SqlError", "cast_params", "fingerprint", "max_param_number", "normalize", "shape"]
