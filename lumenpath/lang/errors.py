"""Errors that a path expression can raise, by kind."""


class PathError(Exception):
    """Base of all; `kind` names the kind."""

    kind = "InvalidExpression"


class ParseError(PathError):
    kind = "Parse"


class TypeMismatch(PathError):
    kind = "Type"


class FunctionNotFound(PathError):
    kind = "FunctionNotFound"


class InvalidArguments(PathError):
    kind = "InvalidArguments"


class InvalidPath(PathError):
    kind = "InvalidPath"


class SingletonExpected(PathError):
    kind = "SingletonExpected"


class InvalidOperation(PathError):
    kind = "InvalidOperation"


class DivisionByZero(PathError):
    kind = "DivisionByZero"


class Timeout(PathError):
    kind = "Timeout"
