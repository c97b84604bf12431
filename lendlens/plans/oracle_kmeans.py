"""The fixed k-means steps as DuckDB SQL, with its own constants: seeds by a recursive query, then one pair of
queries a step."""

from __future__ import annotations

CANDIDATES, STEPS = 1000, 5
FINE, COARSE = 1048576, 1024


def kmeans_sql(source: str, id_col: str, vector_col: str, k: int, steps: int = STEPS) -> dict[str, str]:
    """The same steps as DuckDB CTEs; the last one, ``km_assigned``, holds the result."""

    def squares(a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    out = {
        "km_fixed": f"SELECT {id_col} AS id, list_transform({vector_col}, lambda x: floor(CAST(x AS DOUBLE) * {FINE} + 0.5)::BIGINT) AS q "
                    f"FROM {source} WHERE {vector_col} IS NOT NULL",
        "km_entries": "SELECT unnest(q) AS q, unnest(range(len(q))) AS i FROM km_fixed",
        "km_moments": "SELECT i, sum(q)::DOUBLE / count(*)::DOUBLE AS m, sqrt((count(*) * sum(q::HUGEINT * q) - sum(q) * sum(q))::DOUBLE "
                      "/ (count(*)::DOUBLE * (count(*) - 1)::DOUBLE)) AS s FROM km_entries GROUP BY i",
        "km_scale": "SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM km_moments",
        "km_rows": "SELECT id, list_transform(list_zip(q, m, s), lambda t: CASE WHEN t[3] > 0 THEN "
                   f"floor((t[1] - t[2]) / t[3] * {COARSE} + 0.5) ELSE 0 END::DOUBLE) AS z FROM km_fixed, km_scale",
        # equal vectors are assigned alike: one row of each, with its count
        "km_distinct": "SELECT z, count(*) AS n FROM km_rows GROUP BY z",
        "km_candidates": f"SELECT row_number() OVER (ORDER BY md5(id::VARCHAR), id::VARCHAR) AS p, z FROM km_rows QUALIFY p <= {CANDIDATES}",
        "km_seeds": "SELECT 0 AS c, p, z, NULL::DOUBLE[] AS seed, 'Infinity'::DOUBLE AS near FROM km_candidates "
                    "UNION ALL SELECT c + 1, p, z, chosen, least(near, " + squares("z", "chosen") + ") FROM ("
                    "SELECT *, first(z) OVER (ORDER BY near DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS chosen, max(near) OVER () AS top FROM km_seeds) "
                    f"WHERE c < {k} AND top > 0",
        "km_c0": "SELECT DISTINCT c - 1 AS c, seed AS v FROM km_seeds WHERE c > 0",
    }
    nearest = "SELECT r.z, any_value(r.n) AS n, arg_min(k.c, {{'d': {d}, 'c': k.c}}) AS c FROM km_distinct r, km_c{s} k GROUP BY r.z"
    for s in range(steps + 1):
        out[f"km_a{s}"] = nearest.format(d=squares("r.z", "k.v"), s=s)
        if s < steps:
            out[f"km_m{s}"] = (
                f"SELECT c, list(v ORDER BY i) AS v FROM (SELECT c, i, floor(sum(x * n) / sum(n)) AS v FROM "
                f"(SELECT c, n, unnest(z) AS x, unnest(range(len(z))) AS i FROM km_a{s}) GROUP BY c, i) GROUP BY c"
            )
            out[f"km_c{s + 1}"] = f"SELECT k.c, coalesce(m.v, k.v) AS v FROM km_c{s} k LEFT JOIN km_m{s} m ON m.c = k.c"
    out["km_assigned"] = f"SELECT r.id AS {id_col}, a.c::INTEGER AS kmeans_cluster FROM km_rows r JOIN km_a{steps} a ON a.z = r.z"
    return out
