"""Structured text processing and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Worker functions travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The library's surface: name, and where it is defined.
PUBLIC = {
    "normalize": "inkloom.functions.layout",
    "mask": "inkloom.functions.masking",
    "restore": "inkloom.functions.masking",
    "segments": "inkloom.operators.segments",
    "reassemble": "inkloom.operators.segments",
    "rewrap": "inkloom.operators.segments",
    "placeholder_reason": "inkloom.functions.checks",
    "structure_reason": "inkloom.functions.checks",
    "header": "inkloom.functions.prose",
    "infer": "inkloom.operators.infer",
    "Memo": "inkloom.operators.memo",
    "translate": "inkloom.plans.document",
}
__all__ = sorted(PUBLIC)


def __getattr__(name: str):
    if name in PUBLIC:
        import importlib

        return getattr(importlib.import_module(PUBLIC[name]), name)
    raise AttributeError(name)
