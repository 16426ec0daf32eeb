"""How queries and their SQL twins are registered, and the pieces of SQL that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocloud.functions.keyed import tidy
from stratocloud.sources.fixtures import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that must give the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def over(sql: str, *views: str) -> str:
    """SQL over some of the fixture views (points if none is named)."""
    made = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in views or ("points",))
    return f"WITH {made}{',' if sql.lstrip().startswith('--') else ''} {sql.lstrip().removeprefix('--')}"


def rounded(df: DataFrame, *columns: str, digits: int = 10) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns})


def r6(*columns: str, digits: int = 10) -> str:
    """SQL that rounds expressions, each given as ``expression AS name`` or a column."""
    out = []
    for c in columns:
        value, _, name = c.rpartition(" AS ")
        out.append(f"round({value or name}, {digits}) + 0::DOUBLE AS {name}")
    return ", ".join(out)


def key_sql(name: str, *keys: str, seed: int = 42) -> str:
    return f"md5(concat_ws(':', '{seed}', '{name}', {', '.join(keys)}))"


def uniform_sql(name: str, *keys: str, seed: int = 42) -> str:
    return f"(('0x' || substr({key_sql(name, *keys, seed=seed)}, 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"


def normal_sql(name: str, *keys: str, seed: int = 42) -> str:
    u, v = uniform_sql(name + "/u", *keys, seed=seed), uniform_sql(name + "/v", *keys, seed=seed)
    return f"(sqrt(-2::DOUBLE * ln(1::DOUBLE - {u})) * cos(2 * pi() * {v}))"
