"""All registered queries: name -> (callable, SQL or None)."""

from __future__ import annotations

from stratafold.plans import metric_plans, run_plans, spatial_plans, study_plans

PLANS = {**metric_plans.PLANS, **spatial_plans.PLANS, **study_plans.PLANS, **run_plans.PLANS}
