"""The three kinds of failure."""


class QuernError(Exception):
    """Base of all errors of this library."""


class InvalidInput(QuernError, ValueError):
    """The frame or a setting cannot be used."""


class NotFitted(QuernError, RuntimeError):
    """``transform`` before ``fit``."""


class Computation(QuernError, ArithmeticError):
    """The data do not determine what was asked for."""
