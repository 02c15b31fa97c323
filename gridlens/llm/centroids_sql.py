"""Lloyd's rounds in SQL, every vector against every centroid: what the clustering by bounds must equal."""

from __future__ import annotations

DISTANCE = "CAST(list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, {dims} + 1)]) AS BIGINT)"


def nearest(centroids: str, dims: int) -> str:
    distance = DISTANCE.format(dims=dims)
    return f"""SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({distance}) AS distance, arg_min(k, struct_pack(d := {distance}, k := k)) AS k
    FROM kept, {centroids} GROUP BY r"""


def means(points: str, before: str, dims: int) -> str:
    return f"""SELECT b.k, coalesce(m.c, b.c) AS c FROM {before} b LEFT JOIN (
      SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
        SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM {points}, range(1, {dims} + 1) t(i) GROUP BY k, i) GROUP BY k) m ON b.k = m.k"""


def lloyd(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
      FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF isfinite(x)]) = {dims})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (
      SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}', dims)})")
        steps.append(f"c{r + 1} AS MATERIALIZED ({means(f'a{r}', f'c{r}', dims)})")
    steps.append(f"a{rounds} AS MATERIALIZED ({nearest(f'c{rounds}', dims)})")
    return f"""WITH {', '.join(steps)}
    SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


ORACLE = lloyd()
