"""pagelake: document collections as page tables, on Spark."""

from __future__ import annotations

__version__ = "0.1.0"
__all__ = ["BudgetExceeded", "OCROutput", "OCRPipeline", "PipelineConfig", "__version__"]


def __getattr__(name: str):
    """The public names, loaded when they are asked for, so that Spark's workers import only what they need."""
    if name == "OCRPipeline":
        from pagelake.plans.pipeline import OCRPipeline as found
    elif name in ("OCROutput", "PipelineConfig"):
        from pagelake import schema

        found = getattr(schema, name)
    elif name == "BudgetExceeded":
        from pagelake.operators.budget import BudgetExceeded as found
    else:
        raise AttributeError(name)
    return found
