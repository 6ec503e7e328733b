"""Random draws as SQL expressions of a key: the same in every run, on every executor and in DuckDB.

The generator is counter-based: a draw is a hash of the key and the draw's name,
so no state is carried. Gamma variates come from Marsaglia and Tsang's rejection
(A simple method for generating gamma variables, 2000), tried `TRIES` times;
that all fail has a probability below 10^-10, and then the mode stands in.
Keys and parameters are names of columns or numbers, as they occur many times.
"""

from __future__ import annotations

TRIES = 8
#: Successes and failures of an arm, each on top of a prior of 1.
POSTERIOR = (
    "(qualified * CAST(2.5 AS DOUBLE) + returned * CAST(2 AS DOUBLE) + uniques * CAST(0.04 AS DOUBLE) + 1)",
    "(rescued * CAST(1.25 AS DOUBLE) + duplicates * CAST(0.08 AS DOUBLE) + units * CAST(0.12 AS DOUBLE) + latency_ms / CAST(1000 AS DOUBLE) * CAST(0.002 AS DOUBLE) + 1)",
)


def _double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def uniform_sql(key: str, name: str, duckdb: bool = False) -> str:
    """In (0, 1), with 52 bits; `name` is a text expression that names the draw."""
    digits = f"substr(md5({key} || {name}), 1, 13)"
    whole = f"CAST('0x' || {digits} AS BIGINT)" if duckdb else f"CAST(conv({digits}, 16, 10) AS BIGINT)"
    return f"((CAST({whole} AS DOUBLE) + {_double(0.5)}) / {_double(4503599627370496.0)})"


def gamma_sql(key: str, name: str, alpha: str, duckdb: bool = False) -> str:
    """Gamma(alpha, 1) for alpha > 0: below 1 by a draw of alpha + 1 and a power of a uniform."""
    u = lambda part: uniform_sql(key, f"'#{name}.' || CAST(k AS STRING) || '{part}'", duckdb)
    d = f"({alpha} + CASE WHEN {alpha} < 1 THEN {_double(2 / 3)} ELSE {_double(-1 / 3)} END)"
    normal = f"sqrt({_double(-2.0)} * ln({u('a')})) * cos({_double(6.283185307179586)} * {u('b')})"
    root = f"(t.z / sqrt({d} * 9) + 1)"
    v = f"({root} * {root} * {root})"
    log_v = f"ln(CASE WHEN {root} > 0 THEN {v} ELSE {_double(1.0)} END)"
    tried = f"CASE WHEN {root} > 0 AND ln(t.u) < {_double(0.5)} * t.z * t.z + {d} * ({_double(1.0)} - {v} + {log_v}) THEN {d} * {v} END"
    if duckdb:
        drawn = f"list_transform(range({TRIES}), lambda k: {{'z': {normal}, 'u': {u('c')}}})"
        first = f"list_filter(list_transform({drawn}, lambda t: {tried}), lambda x: x IS NOT NULL)[1]"
    else:
        drawn = f"transform(sequence(0, {TRIES - 1}), k -> named_struct('z', {normal}, 'u', {u('c')}))"
        first = f"get(filter(transform({drawn}, t -> {tried}), x -> x IS NOT NULL), 0)"
    low = uniform_sql(key, f"'#{name}.low'", duckdb)
    return f"(coalesce({first}, {d}) * CASE WHEN {alpha} < 1 THEN power({low}, {_double(1.0)} / {alpha}) ELSE {_double(1.0)} END)"


def ratio_sql(x: str, y: str) -> str:
    """What two gamma draws make a Beta draw."""
    return f"(CASE WHEN {x} + {y} > 0 THEN {x} / ({x} + {y}) ELSE {_double(0.5)} END)"


def least_sql(parameter: str) -> str:
    """A Beta parameter is 0.001 at least."""
    return f"greatest({parameter}, {_double(0.001)})"


def beta_sql(key: str, alpha: str, beta: str, duckdb: bool = False) -> str:
    """Beta(alpha, beta) from two gamma draws."""
    return ratio_sql(gamma_sql(key, "x", least_sql(alpha), duckdb), gamma_sql(key, "y", least_sql(beta), duckdb))
