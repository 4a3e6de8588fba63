"""Pieces of the SQL that checks the queries."""

from .common import WHITE

_W = "'" + WHITE + "'"


def sql_trim(x: str) -> str:
    return f"trim({x}, {_W})"


def sql_norm(x: str) -> str:
    return f"lower(trim({x}, {_W}))"


def sql_stem(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '[^/]*$'), '\\.[^.]*$', '')"


def sql_month(x: str) -> str:
    return f"strftime(make_timestamp(epoch_us({x})), '%Y-%m')"
