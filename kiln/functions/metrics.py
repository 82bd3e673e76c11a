"""Scalar formulas as Column expressions: loss, clamp, cost model and
efficiency score (V1, M4, E2-E7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kiln.config import (COST_EXPONENT, EFF_ALPHA, EFF_BETA, EFF_GAMMA, REF_IMAGE_FLOPS, REF_IMAGE_SIZE,
                         TARGET_FLOPS, TARGET_PARAMS)


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def smooth_l1(pred, label, beta: float = 1.0) -> Column:
    """V1: ``0.5 d²/beta`` when ``|d| < beta`` else ``|d| - 0.5 beta``."""
    d = F.abs(_c(pred) - _c(label))
    return F.when(d < beta, F.lit(0.5) * d * d / F.lit(beta)).otherwise(d - F.lit(0.5 * beta))


def clamp_score(s, lo: float = 1.0, hi: float = 5.0) -> Column:
    """M4: clamp to [lo, hi]; null and NaN stay as they are (Spark's ``least``
    and ``greatest`` skip nulls and treat NaN as the largest value)."""
    s = _c(s)
    return F.when(s.isNull() | F.isnan(s), s).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), s)))


def transformer_block_flops(L, d, ffn_mult=4) -> Column:
    """``4 L d² + 2 L² d + 2 L d (m d)`` for one encoder layer."""
    L, d, m = _c(L).cast("double"), _c(d).cast("double"), _c(ffn_mult).cast("double")
    return 4.0 * L * d * d + 2.0 * L * L * d + 2.0 * L * d * (m * d)


def image_branch_flops(h=REF_IMAGE_SIZE[0], w=REF_IMAGE_SIZE[1]) -> Column:
    """390 MFLOPs at 224², scaled by area."""
    return F.lit(REF_IMAGE_FLOPS) * (_c(h).cast("double") * _c(w).cast("double")) / F.lit(
        float(REF_IMAGE_SIZE[0] * REF_IMAGE_SIZE[1]))


def head_flops(fused_dim, hidden_dim, num_outputs=1) -> Column:
    """Head cost: ``2 f h + 2 h (h//2) + 2 (h//2) o``."""
    f, h, o = _c(fused_dim).cast("long"), _c(hidden_dim).cast("long"), _c(num_outputs).cast("long")
    b = F.floor(h / 2).cast("long")
    return (2 * f * h + 2 * h * b + 2 * b * o).cast("double")


def model_flops(text_length, layers=6, hidden=384, intermediate=1536, with_images=True,
                image_h=224, image_w=224, image_dim=1280, hidden_dim=512, num_outputs=1,
                batch_size=1) -> Column:
    """Layers x block cost (FFN multiplier by integer division) + image
    branch when images are used + head, times the batch size."""
    ffn_mult = F.floor(_c(intermediate).cast("long") / _c(hidden).cast("long"))
    text = _c(layers).cast("double") * transformer_block_flops(text_length, hidden, ffn_mult)
    img = F.when(_c(with_images), image_branch_flops(image_h, image_w)).otherwise(F.lit(0.0))
    head = head_flops(_c(image_dim) + _c(hidden), hidden_dim, num_outputs)
    return (text + img + head) * _c(batch_size).cast("double")


def resource_cost(params, flops, p_tgt: float = TARGET_PARAMS, f_tgt: float = TARGET_FLOPS,
                  w: float = COST_EXPONENT) -> Column:
    """E5: ``(P / P_tgt)^w · (F / F_tgt)^w``."""
    return F.pow(_c(params).cast("double") / p_tgt, w) * F.pow(_c(flops).cast("double") / f_tgt, w)


def efficiency_factor(C, alpha: float = EFF_ALPHA, beta: float = EFF_BETA, gamma: float = EFF_GAMMA) -> Column:
    """``min(1 + a ln(1/max(C,1e-12)), 1 + g)`` when C <= 1, else
    ``1 / (1 + b ln C)``."""
    C = _c(C).cast("double")
    low = F.least(F.lit(1.0) + F.lit(alpha) * F.ln(F.lit(1.0) / F.greatest(C, F.lit(1e-12))), F.lit(1.0 + gamma))
    return F.when(C <= 1.0, low).otherwise(F.lit(1.0) / (F.lit(1.0) + F.lit(beta) * F.ln(C)))


def ces_score(plcc, C) -> Column:
    """``max(0, plcc) · E(C)``; an undefined (NaN) correlation counts as 0."""
    r = _c(plcc).cast("double")
    return F.when(F.isnan(r), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), r)) * efficiency_factor(C)
