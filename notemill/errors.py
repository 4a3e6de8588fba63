"""Exceptions with the exit codes of the command surface."""


class NotemillError(Exception):
    """1: not found, ambiguous or refused."""

    exit_code = 1


class UsageError(NotemillError):
    exit_code = 2


class NoIndexError(NotemillError):
    """No vault, no index, or an index too old for a mutation."""

    exit_code = 3


class StaleIndexError(NoIndexError):
    pass
