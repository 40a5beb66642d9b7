"""Named queries over the parquet tables."""


def registries():
    """All registries of the core."""
    from chronoloom.plans.audit_plan import audit_plan
    from chronoloom.plans.io_plan import io_plan
    from chronoloom.plans.model_plan import model_plan
    from chronoloom.plans.problems import problems
    from chronoloom.plans.select_plan import select_plan
    from chronoloom.plans.series_plan import series_plan

    return [problems, series_plan, select_plan, audit_plan, io_plan, model_plan]
