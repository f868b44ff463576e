"""Fit both lifetime models and value every repeat customer, or fall back to plain spend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallybook.operators import clv as ops
from tallybook.plans.maximum_likelihood import fit_bgnbd, fit_gamma_gamma
from tallybook.sources.staging import stage


@dataclass
class LifetimeValue:
    bgnbd: ops.BgNbd | None
    gamma_gamma: ops.GammaGamma | None
    clv: DataFrame | None
    customer_value: DataFrame | None


def analyse(tx: DataFrame, horizon_days: int = 180, discount: float = 0.01, more_than: int = 10) -> LifetimeValue:
    """The models need more than `more_than` repeat customers; otherwise `customer_value` holds plain spend."""
    base = ops.customer_base(tx)
    if not ops.enough_repeat_customers(base, more_than):
        return LifetimeValue(None, None, None, ops.customer_value(tx))
    inputs = ops.model_inputs(base)
    bgnbd, gamma_gamma = fit_bgnbd(inputs), fit_gamma_gamma(inputs)
    # the reports read the values several times
    clv = stage(ops.lifetime_value(inputs, bgnbd, gamma_gamma, horizon_days, discount))
    return LifetimeValue(bgnbd, gamma_gamma, clv, None)
