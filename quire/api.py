"""Functional and fluent fronts: `api.rotate(bundle, "right")`, `pipeline(bundle).rotate("right").dump_text()`."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from . import registry
from .registry import Bundle


def __getattr__(name: str):
    if name not in registry.OPERATIONS:
        raise AttributeError(name)

    def operation(bundle: Bundle, *args: Any, full_result: bool = False, **kw: Any) -> Bundle | DataFrame:
        out = registry.call(name, bundle, *args, **kw)
        return out.report if out.report is not bundle.report and not full_result else out

    operation.__name__, operation.__doc__ = name, registry.OPERATIONS[name].description
    return operation


class Pipeline:
    """Every operation as a method; one that reports ends the chain with its table."""

    def __init__(self, bundle: Bundle):
        self.bundle = bundle

    def __getattr__(self, name: str):
        if name not in registry.OPERATIONS:
            raise AttributeError(name)

        def method(*args: Any, **kw: Any) -> Pipeline | DataFrame:
            out = registry.call(name, self.bundle, *args, **kw)
            return out.report if out.report is not self.bundle.report else Pipeline(out)

        return method

    def save(self, path: str) -> None:
        from .sources.bundles import write

        write(self.bundle, path)


def pipeline(bundle: Bundle) -> Pipeline:
    return Pipeline(bundle)
