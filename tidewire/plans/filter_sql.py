"""SQL twins of the filters and of the alignment: sums over impulse responses and matrices, written out as numbers."""

from __future__ import annotations

import numpy as np

from ..functions.design import settle_length
from ..functions.zero_phase import pad_length


def impulse_response(sos: np.ndarray, n: int) -> list[float]:
    """The first n values of the response to one sample of 1, by the sections' difference equations."""
    x = [1.0] + [0.0] * (n - 1)
    for b0, b1, b2, a0, a1, a2 in (map(float, s) for s in sos):
        y: list[float] = []
        for i in range(n):
            x1, x2 = (x[i - 1] if i else 0.0), (x[i - 2] if i > 1 else 0.0)
            y1, y2 = (y[i - 1] if i else 0.0), (y[i - 2] if i > 1 else 0.0)
            y.append((b0 * x[i] + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2) / a0)
        x = y
    return x


def _numbers(values) -> str:
    return "[" + ", ".join(repr(float(x)) for x in values) + "]::DOUBLE[]"


def _through(name: str, source: str, gain: float) -> str:
    """A filter over lists ``d``: started in the state that its first value, held for ever, would leave."""
    return f"""
        {name} AS (SELECT k, own, stop, list_transform(range(1, len(d) + 1),
            lambda i: {gain!r} * d[1] + list_dot_product(hr[len(hr) - least(i, len(hr)) + 1 : len(hr)], z[i - least(i, len(hr)) + 1 : i])) AS y
          FROM (SELECT *, list_transform(d, lambda v: v - d[1]) AS z FROM {source}), hr)
    """


def filtered_sql(source: str, sos: np.ndarray, buffer_len: int = 1 << 22, overlap: int | None = None, epochs: list[tuple[int, int]] | None = None, as_int16: bool = True) -> str:
    """(ts, value) of a source (ts, value) whose timestamps are 0, 1, 2 and so on: each epoch's chunks, filtered forward and back with odd extension at their ends."""
    overlap = settle_length(sos) if overlap is None else overlap
    pad, gain = pad_length(sos), float(np.prod([s[:3].sum() / s[3:].sum() for s in sos]))
    size = settle_length(sos, 1e-18) + 10
    number = "CAST(trunc(least(greatest(v, -32768.0), 32767.0)) AS SMALLINT)" if as_int16 else "round(v, 6)"
    spans = " UNION ALL ".join(f"SELECT {a} AS a, least({b}, n) AS b FROM sig" for a, b in epochs) if epochs else "SELECT 0 AS a, n AS b FROM sig"
    return f"""
        WITH src AS ({source}), sig AS (SELECT list(CAST(value AS DOUBLE) ORDER BY ts) AS xs, count(*) AS n FROM src),
        hr AS (SELECT {_numbers(reversed(impulse_response(sos, size)))} AS hr), span AS ({spans}),
        chunk AS (SELECT row_number() OVER () AS k, own, least(own + {buffer_len}, b) AS stop, greatest(own - {overlap}, a) AS lo, least(own + {buffer_len + overlap}, b) AS hi
          FROM (SELECT a, b, unnest(range(a, b, {buffer_len})) AS own FROM span)),
        cut AS (SELECT k, own, stop, lo, xs[lo + 1 : hi] AS x FROM chunk, sig),
        ext AS (SELECT k, own, stop, list_concat(list_transform(range({pad}, 0, -1), lambda i: 2 * x[1] - x[i + 1]), x, list_transform(range(1, {pad + 1}), lambda i: 2 * x[len(x)] - x[len(x) - i])) AS d FROM cut),
        {_through("fwd", "ext", gain)}, turned AS (SELECT k, own, stop, list_reverse(y) AS d FROM fwd), {_through("bwd", "turned", gain)},
        done AS (SELECT own, stop, lo, list_reverse(y) AS y FROM bwd JOIN (SELECT k, lo FROM cut) USING (k)),
        flat AS (SELECT unnest(range(own, stop)) AS ts, unnest(y[{pad} + own - lo + 1 : {pad} + stop - lo]) AS v FROM done)
        SELECT src.ts, CASE WHEN v IS NULL THEN 0 ELSE {number} END AS value FROM src LEFT JOIN flat ON flat.ts = src.ts
    """


def spline_matrix(n: int) -> np.ndarray:
    """Cubic B-spline coefficients of n samples with mirrored ends, as a matrix: the inverse of the spline's values at the samples."""
    values = np.zeros((n, n))
    for i in range(n):
        for j, w in ((i - 1, 1 / 6), (i, 2 / 3), (i + 1, 1 / 6)):
            j = abs(j) if j < n else 2 * n - 2 - j
            values[i, j] += w
    return np.linalg.inv(values)


def aligned_sql(samples: int, channels: int, before: int, after: int) -> str:
    """(vec_id, s, ch, v): embeddings as waveforms, moved to the peak of their highest channel by cubic splines."""
    cells = ", ".join(f"({i}, {j}, {float(x)!r}::DOUBLE)" for i, row in enumerate(spline_matrix(samples)) for j, x in enumerate(row))
    span = 2 * samples - 2
    return f"""
        WITH w AS (SELECT vec_id, CAST(p // {channels} AS INT) AS s, CAST(p % {channels} AS INT) AS ch, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(0, {samples * channels})) AS p)),
        tops AS (SELECT vec_id, ch, max(v) AS top FROM w GROUP BY ALL),
        best AS (SELECT vec_id, arg_max(ch, (top, -ch)) AS ch FROM tops GROUP BY vec_id),
        place AS (SELECT w.vec_id, w.ch, arg_max(s, (v, -s)) AS s FROM w JOIN best ON best.vec_id = w.vec_id AND best.ch = w.ch GROUP BY ALL),
        near AS (SELECT p.vec_id, p.s, l.v AS l, m.v AS m, r.v AS r FROM place p JOIN w m ON m.vec_id = p.vec_id AND m.ch = p.ch AND m.s = p.s
          LEFT JOIN w l ON l.vec_id = p.vec_id AND l.ch = p.ch AND l.s = p.s - 1 LEFT JOIN w r ON r.vec_id = p.vec_id AND r.ch = p.ch AND r.s = p.s + 1),
        peak AS (SELECT vec_id, CASE WHEN l IS NULL OR r IS NULL OR l - 2 * m + r = 0 THEN s ELSE s - 0.5::DOUBLE * (r - l) / (l - 2 * m + r) END AS peak FROM near),
        mat(i, j, x) AS (VALUES {cells}),
        coef AS (SELECT vec_id, ch, i, sum(x * v) AS c FROM w JOIN mat ON mat.j = w.s GROUP BY ALL),
        spot AS (SELECT vec_id, k + {before} AS s, peak + k AS x FROM peak, (SELECT unnest(range({-before}, {after})) AS k)),
        tap AS (SELECT vec_id, s, floor(x) + t AS i, abs(x - floor(x) - t) AS d FROM spot, (SELECT unnest([-1, 0, 1, 2]) AS t)),
        held AS (SELECT vec_id, s, CASE WHEN abs(i) % {span} < {samples} THEN abs(i) % {span} ELSE {span} - abs(i) % {span} END AS i,
          CASE WHEN d < 1 THEN 2.0::DOUBLE / 3 - d * d + d * d * d / 2 WHEN d < 2 THEN (2 - d) * (2 - d) * (2 - d) / 6 ELSE 0 END AS weight FROM tap)
        SELECT vec_id, CAST(s AS INT) AS s, ch, round(CAST(CAST(sum(weight * c) AS FLOAT) AS DOUBLE), 4) + 0.0 AS v FROM held JOIN coef USING (vec_id, i) GROUP BY vec_id, s, ch
    """
