"""Helpers for the DuckDB oracle texts: exact means and rounding.

Spark's ``round`` on a DOUBLE rounds its shortest decimal form half-up
(``round(1.005, 2) = 1.01``); DuckDB's rounds the binary value (``1.00``).
:func:`spark_rounding` rewrites every two-argument ``round(x, d)`` of an
oracle text to round the shortest decimal form of ``x``, so both engines
apply the same rule. Means of non-integer values are written with
:func:`avg_r`, exact integer arithmetic, so they do not depend on the
summation order either.
"""

from __future__ import annotations


def exact(x: str) -> str:
    """``x`` as a DECIMAL with its own decimals (up to ten), by its shortest text."""
    return f"CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(28,10))"


def tot(x: str) -> str:
    """Exact sum as DOUBLE."""
    return f"CAST(sum({exact(x)}) AS DOUBLE)"


def avg_r(x: str, digits: int, count: str | None = None) -> str:
    """round_half_up(sum(x) / count(x), digits) in integers of 10**-10
    (``count`` overrides the denominator)."""
    units = f"CAST(replace(CAST(sum({exact(x)}) AS VARCHAR), '.', '') AS HUGEINT)"
    n = count or f"count({x})"
    num = f"2 * {units} * {10 ** digits} + CAST({n} AS HUGEINT) * {10 ** 10}"
    den = f"nullif(2 * CAST({n} AS HUGEINT) * {10 ** 10}, 0)"
    return f"(CAST(({num}) // {den} AS DOUBLE) / {10 ** digits})"


def _split_args(s: str, start: int) -> tuple[list[str], int]:
    """Arguments of the call whose '(' is at ``start - 1``; returns (args, end)."""
    depth, i, args, cur = 1, start, [], start
    quote = False
    while depth:
        ch = s[i]
        if ch == "'":
            quote = not quote
        elif not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                args.append(s[cur:i])
                cur = i + 1
        i += 1
    args.append(s[cur:i - 1])
    return args, i


def spark_rounding(sql: str) -> str:
    out, i, k, quote = [], 0, 0, False
    low = sql.lower()
    while k < len(sql):
        ch = sql[k]
        if ch == "'":
            quote = not quote
            k += 1
            continue
        if quote or not low.startswith("round(", k) or (
                k > 0 and (low[k - 1].isalnum() or low[k - 1] == "_")):
            k += 1
            continue
        args, end = _split_args(sql, k + 6)
        if len(args) != 2:
            out.append(sql[i:k] + "round(" + spark_rounding(sql[k + 6:end]))
        else:
            x, d = spark_rounding(args[0]), args[1].strip()
            out.append(sql[i:k]
                       + f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,20)), {d}) AS DOUBLE)")
        i = k = end
    out.append(sql[i:])
    return "".join(out)
