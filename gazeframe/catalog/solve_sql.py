"""Least squares, logistic fits and p-values as SQL text, to check the models of this package with.

A small symmetric system is a flat list. Sweeping its pivots one after the other leaves the solution in its last
column and the negated inverse in front of it; a pivot that earlier ones explain is not swept, its entry
behind the matrix becomes 0, and its term is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

ALIASED = "1e-9"


def _swept(matrix: str, size: int, pivots: int) -> str:
    """``matrix``: size x size entries by row, then the first ``pivots`` diagonal entries once more."""
    at = f"m[CAST((p[1] - 1) * {size} + p[1] AS BIGINT)]"
    row, col = f"((q - 1) // {size} + 1)", f"((q - 1) % {size} + 1)"
    steps = ", ".join(f"[{i}::DOUBLE]" for i in range(1, pivots + 1))
    fit = f"{at} > {ALIASED} * m[CAST({size * size} + p[1] AS BIGINT)]"
    return f"""list_reduce([{matrix}, {steps}], lambda m, p: CASE WHEN NOT ({fit})
        THEN list_transform(range(1, {size * size + pivots + 1}), lambda q: CASE WHEN q = {size * size} + p[1] THEN 0 ELSE m[q] END)
        ELSE list_transform(range(1, {size * size + pivots + 1}), lambda q: CASE
            WHEN q > {size * size} THEN m[q]
            WHEN {row} = p[1] AND {col} = p[1] THEN -1 / {at}
            WHEN {row} = p[1] OR {col} = p[1] THEN m[q] / {at}
            ELSE m[q] - m[CAST(({row} - 1) * {size} + p[1] AS BIGINT)] * m[CAST((p[1] - 1) * {size} + {col} AS BIGINT)] / {at} END) END)"""


def _flat(entry, size: int, pivots: int) -> str:
    cells = [entry(min(i, j), max(i, j)) for i in range(size) for j in range(size)]
    return "[" + ", ".join(cells + [entry(i, i) for i in range(pivots)]) + "]"


def t_p(t: str, dof: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom, by its finite series."""
    angle = f"atan(abs({t}) / sqrt({dof}))"
    even = f"""sin({angle}) * list_sum(list_transform(range(0, CAST({dof} // 2 AS BIGINT)),
        lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) + 2 * j * ln(cos({angle}))))) / sqrt(pi())"""
    odd = f"""2 / pi() * ({angle} + coalesce(sin({angle}) * cos({angle}) * sqrt(pi()) / 2 * list_sum(list_transform(
        range(0, CAST(({dof} - 1) // 2 AS BIGINT)), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5) + 2 * j * ln(cos({angle}))))), 0))"""
    return f"CASE WHEN {dof} > 0 THEN 1 - CASE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END END"


def z_p(z: str) -> str:
    """Two-sided p of a normal ratio, by the series of its distribution; beyond 25 it is 0."""
    term = f"exp((2 * j + 1) * ln(abs({z})) - (j + 1) * ln(2) - lgamma(j + 1.5) + ln(pi()) / 2 - {z} * {z} / 2)"
    return f"""CASE WHEN abs({z}) > 25 THEN 0 WHEN {z} = 0 THEN 1
        ELSE 1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 700), lambda j: {term})) END"""


def ols(source: str, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> str:
    """Rows of keys, term, estimate, std_error, t, dof, n; ``source`` is a table or a query in brackets."""
    names, k = [*xs, y], len(xs)
    size, head = k + 1, "".join(f'"{key}", ' for key in keys)
    group = "GROUP BY " + ", ".join(f'"{key}"' for key in keys) if keys else ""
    quoted = [f'CAST("{name}" AS DOUBLE)' for name in names]
    present = " AND ".join(f'"{name}" IS NOT NULL' for name in names)
    matrix = _flat(lambda i, j: f"covar_pop({quoted[i]}, {quoted[j]})", size, k)
    terms = ", ".join(f"'{t}'" for t in ("(Intercept)", *xs))
    diag, last, swept = f"s[(i - 1) * {size} + i]", f"s[(i - 1) * {size} + {size}]", f"s[{size * size} + i] > 0"
    estimate = f"""CASE WHEN i = 0 THEN mean[{size}] - list_sum(list_transform(range(1, {size}),
            lambda p: CASE WHEN s[{size * size} + p] > 0 THEN mean[p] * s[p * {size}] ELSE 0 END))
        WHEN {swept} THEN {last} END"""
    spread = f"""list_sum(list_transform(range(0, {k * k}), lambda q: CASE
        WHEN s[{size * size} + q // {k} + 1] > 0 AND s[{size * size} + q % {k} + 1] > 0
        THEN -mean[q // {k} + 1] * mean[q % {k} + 1] * s[(q // {k}) * {size} + q % {k} + 1] ELSE 0 END))"""
    error = f"sqrt(CASE WHEN dof > 0 THEN greatest(n * s[{size * size}], 0) / dof END / n * CASE WHEN i = 0 THEN 1 + {spread} WHEN {swept} THEN -{diag} END)"
    return f"""SELECT {head}term, estimate, std_error, estimate / std_error AS t, dof, n FROM (
        SELECT {head}[{terms}][i + 1] AS term, {estimate} AS estimate, {error} AS std_error, dof, n FROM (
            SELECT *, unnest(range(0, {k + 1})) AS i,
                n - 1 - len(list_filter(range(1, {size}), lambda p: s[{size * size} + p] > 0)) AS dof FROM (
                SELECT *, {_swept('m', size, k)} AS s FROM (
                    SELECT {head}count(*) AS n, [{', '.join(f'avg({q})' for q in quoted)}] AS mean, {matrix} AS m
                    FROM {source} WHERE {present} {group}))))"""


def logistic(cells: str, xs: Sequence[str], keys: Sequence[str], p: str = "p", weight: str = "n", rounds: int = 12) -> tuple[str, str]:
    """(CTEs, name of the last one); its rows are the keys, ``n`` and the swept matrix ``s`` of the last round."""
    k, size = len(xs) + 1, len(xs) + 2
    head = "".join(f'"{key}", ' for key in keys)
    x = ["1.0::DOUBLE", *[f'CAST("{name}" AS DOUBLE)' for name in xs]]
    values = [f"x[{i + 1}]" for i in range(k)] + ["1"]

    def entry(i: int, j: int) -> str:
        if j < k:
            return f"sum(v * {values[i]} * {values[j]})"
        return f"sum(g * {values[i]})" if i < k else "0.0::DOUBLE"

    start = "(w * share + 0.5) / (w + 1)"
    made = [
        f"""fit_rows AS MATERIALIZED (SELECT {head}[{', '.join(x)}] AS x, CAST("{p}" AS DOUBLE) AS share,
            CAST("{weight}" AS DOUBLE) AS w FROM {cells})"""
    ]
    same = " AND ".join(f'r."{key}" IS NOT DISTINCT FROM b."{key}"' for key in keys) or "TRUE"
    for number in range(rounds):
        if number:
            eta = f"""list_sum(list_transform(range(1, {k + 1}), lambda i: CASE WHEN b.s[{size * size} + i] > 0 THEN r.x[i] * b.s[i * {size}] ELSE 0 END))"""
            source = f"(SELECT r.*, greatest(least({eta}, 30), -30) AS eta FROM fit_rows r JOIN fit_{number - 1} b ON {same})"
        else:
            source = f"(SELECT *, ln({start} / (1 - {start})) AS eta FROM fit_rows)"
        made.append(
            f"""fit_{number} AS MATERIALIZED (SELECT *, {_swept('m', size, k)} AS s FROM (
                SELECT {head}CAST(sum(w) AS BIGINT) AS n, {_flat(entry, size, k)} AS m FROM (
                    SELECT *, w * mu * (1 - mu) AS v, w * mu * (1 - mu) * eta + w * (share - mu) AS g FROM (
                        SELECT *, 1 / (1 + exp(-eta)) AS mu FROM {source}))
                {'GROUP BY ' + ', '.join(f'"{key}"' for key in keys) if keys else ''}))"""
        )
    return ",\n".join(made), f"fit_{rounds - 1}"


def logistic_terms(fit: str, xs: Sequence[str], keys: Sequence[str] = ()) -> str:
    """Rows of keys, term, estimate, std_error, z from the last table of :func:`logistic`."""
    size, head = len(xs) + 2, "".join(f'"{key}", ' for key in keys)
    terms = ", ".join(f"'{t}'" for t in ("(Intercept)", *xs))
    diag, swept = f"s[(i - 1) * {size} + i]", f"s[{size * size} + i] > 0"
    return f"""SELECT {head}term, estimate, std_error, estimate / std_error AS z FROM (
        SELECT {head}[{terms}][i] AS term, CASE WHEN {swept} THEN s[i * {size}] END AS estimate,
            sqrt(CASE WHEN {swept} THEN -{diag} END) AS std_error
        FROM (SELECT *, unnest(range(1, {size})) AS i FROM {fit}))"""


def inflation(fit: str, xs: Sequence[str], keys: Sequence[str] = ()) -> str:
    """Rows of keys, term, vif from the last table of :func:`logistic`, whose terms must all have estimates."""
    k, size, head = len(xs), len(xs) + 2, "".join(f'"{key}", ' for key in keys)

    def c(i: int, j: int) -> str:
        return f"s[{(i + 1) * size + j + 2}] / sqrt(s[{(i + 1) * size + i + 2}] * s[{(j + 1) * size + j + 2}]) * -1"

    matrix = _flat(lambda i, j: c(i, j) if i != j else "1.0::DOUBLE", k, k)
    terms = ", ".join(f"'{t}'" for t in xs)
    return f"""SELECT {head}[{terms}][i] AS term, -v[(i - 1) * {k} + i] AS vif
        FROM (SELECT *, unnest(range(1, {k + 1})) AS i FROM (SELECT *, {_swept('m2', k, k)} AS v FROM (
            SELECT * EXCLUDE (m), {matrix} AS m2 FROM {fit})))"""
