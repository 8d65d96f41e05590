"""BLEU arithmetic as SQL expression text.

The per-pair (or per-group) statistics arrive as columns ``num_k``/``den_k``
(clipped matches and denominators of order k, k = 1..N+1), ``hyp_len`` and
``ref_len``. These builders return plain SQL expressions that Spark runs
through ``F.expr`` (JVM side, whole-stage codegen) and that DuckDB runs
unchanged in the oracle, so both engines share one definition.

Smoothing methods 0-7 follow the published definitions (Chen & Cherry 2014);
cases where the arithmetic is undefined (log of zero, division by ln 1,
method 6 without trigram matches) give NULL instead of raising.
"""

from __future__ import annotations

# --- fixed values: smoothing constants and the tiny precision of method 0
EPSILON = "1e-1"
ALPHA = 5
K = 5
TINY = "2.2250738585072014e-308"
DEFAULT_WEIGHTS = (0.25, 0.25, 0.25, 0.25)


def r6(expr: str, digits: int = 6) -> str:
    """Round half up through IEEE arithmetic, identical in Spark and DuckDB
    (``round`` differs between them on half-way doubles)."""
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 5e-1) / {scale})"


def _p(k: int) -> str:
    return f"(CAST(num_{k} AS DOUBLE) / den_{k})"  # literals below are written 1e0-style: DOUBLE in both engines


def smoothed(method: int, n_orders: int, hyp_len: str = "hyp_len") -> list[str]:
    """Smoothed precision expressions p_1..p_n for one smoothing method."""
    num = [f"num_{k}" for k in range(1, n_orders + 2)]
    den = [f"den_{k}" for k in range(1, n_orders + 2)]
    raw = [_p(k) for k in range(1, n_orders + 2)]
    out: list[str] = []
    if method == 0:
        return [f"(CASE WHEN {num[i]} = 0 THEN {TINY} ELSE {raw[i]} END)" for i in range(n_orders)]
    if method == 1:
        return [
            f"(CASE WHEN {num[i]} = 0 THEN (CAST({num[i]} AS DOUBLE) + {EPSILON}) / {den[i]} ELSE {raw[i]} END)"
            for i in range(n_orders)
        ]
    if method == 2:
        return [f"(CAST({num[i]} + 1 AS DOUBLE) / ({den[i]} + 1))" for i in range(n_orders)]
    if method == 3:
        for i in range(n_orders):
            zeros_before = " + ".join([f"(CASE WHEN {num[j]} = 0 THEN 1 ELSE 0 END)" for j in range(i)]) or "0"
            out.append(
                f"(CASE WHEN {num[i]} = 0 THEN 1e0 / (power(2, 1 + {zeros_before}) * {den[i]}) ELSE {raw[i]} END)"
            )
        return out
    if method == 4:
        return _method4(num, den, raw, n_orders, hyp_len)
    if method == 5:
        return _method5(raw[:n_orders], _p(5))
    if method == 6:
        return _method6(num, raw, n_orders, hyp_len)
    if method == 7:
        return _method5(_method4(num, den, raw, n_orders, hyp_len), _p(5))
    raise ValueError(f"unknown smoothing method {method}")


def _method4(num, den, raw, n_orders, hyp_len):
    out = []
    for i in range(n_orders):
        out.append(
            f"(CASE WHEN {num[i]} = 0 AND {hyp_len} <> 0 THEN "
            f"(CASE WHEN {hyp_len} = 1 THEN NULL ELSE ({i} + {K} / ln({hyp_len})) / {den[i]} END) "
            f"ELSE {raw[i]} END)"
        )
    return out


def _method5(p: list[str], p_extra: str) -> list[str]:
    # m_{-1} = p_1 + 1; p'_i = (m_{i-1} + p_i + p_{i+1}) / 3 with the unsmoothed next order
    following = p[1:] + [p_extra]
    out = []
    prev = f"({p[0]} + 1e0)"
    for i in range(len(p)):
        cur = f"(({prev} + {p[i]} + {following[i]}) / 3e0)"
        out.append(cur)
        prev = cur
    return out


def _method6(num, raw, n_orders, hyp_len):
    cur = list(raw[:n_orders])
    for i in range(2, n_orders):
        pi0 = f"(CASE WHEN {cur[i-2]} = 0 THEN 0e0 ELSE power({cur[i-1]}, 2) / {cur[i-2]} END)"
        grams = f"greatest({hyp_len} - {i}, 0)"
        cur[i] = f"(({num[i]} + {ALPHA} * {pi0}) / ({grams} + {ALPHA}))"
    if n_orders >= 3:
        # the method needs a non-zero trigram precision
        cur = [f"(CASE WHEN num_3 = 0 THEN NULL ELSE {c} END)" for c in cur]
    return cur


def _combine(p: list[str], weights: list[str]) -> str:
    """exp(sum w_i ln p_i); NULL when some p_i <= 0 (log undefined)."""
    bad = " OR ".join(f"{x} <= 0" for x in p)
    total = " + ".join(f"{w} * ln({x})" for w, x in zip(weights, p))
    return f"(CASE WHEN {bad} THEN NULL ELSE exp({total}) END)"


def brevity_penalty(hyp_len: str = "hyp_len", ref_len: str = "ref_len") -> str:
    return (
        f"(CASE WHEN {hyp_len} > {ref_len} THEN 1e0 WHEN {hyp_len} = 0 THEN 0e0 "
        f"ELSE exp(1 - CAST({ref_len} AS DOUBLE) / {hyp_len}) END)"
    )


def bleu(
    method: int = 1,
    weights: tuple[float, ...] = DEFAULT_WEIGHTS,
    auto_reweigh: bool = False,
    hyp_len: str = "hyp_len",
    ref_len: str = "ref_len",
    digits: int | None = 6,
) -> str:
    """BLEU from per-row statistics: bp * exp(sum w ln p), 0 without unigram matches."""
    n = len(weights)
    bp = brevity_penalty(hyp_len, ref_len)

    def core(ws: list[str]) -> str:
        p = smoothed(method, len(ws), hyp_len)
        return f"({bp} * {_combine(p, ws)})"

    body = core([f"{float(w)!r}e0" for w in weights])
    if auto_reweigh and tuple(weights) == DEFAULT_WEIGHTS:
        cases = " ".join(
            f"WHEN {hyp_len} = {L} THEN {core([f'(1e0 / {L})'] * L)}" for L in range(1, n)
        )
        body = f"(CASE WHEN {hyp_len} = 0 THEN NULL {cases} ELSE {body} END)"
    expr = f"(CASE WHEN num_1 = 0 THEN 0e0 ELSE {body} END)"
    if digits is not None:
        expr = r6(expr, digits)
    return expr


def orders_needed(method: int, weights=DEFAULT_WEIGHTS) -> int:
    """Orders of statistics to compute: methods 5 and 7 also read order 5."""
    return max(len(weights), 5) if method in (5, 7) else len(weights)
