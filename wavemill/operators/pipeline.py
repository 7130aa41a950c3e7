"""Composition of operators, and guards of driver resources."""

from __future__ import annotations

import inspect
import os
import pickle
from functools import partial


class Pipeline:
    """Steps applied in turn; each is a function with all arguments bound but its first."""

    def __init__(self, *steps):
        self.steps: list = []
        for s in steps:
            self.append(s)

    @staticmethod
    def validate(fn, *args, **kwargs) -> partial:
        bound = partial(fn, *args, **kwargs)
        free = [p for p in inspect.signature(bound).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
        if len(free) != 1:
            raise TypeError(f"{getattr(fn, '__name__', fn)} has {len(free)} unbound arguments, not 1")
        return bound

    def append(self, fn, **kwargs) -> Pipeline:
        self.steps.append(self.validate(fn, **kwargs))
        return self

    def __contains__(self, fn) -> bool:
        return any(s is fn or getattr(s, "func", None) is fn for s in self.steps)

    def __call__(self, signal):
        for s in self.steps:
            signal = s(signal)
        return signal

    def __repr__(self) -> str:
        return "Pipeline(" + ", ".join(getattr(s.func, "__name__", repr(s)) for s in self.steps) + ")"


def assignable(shape, itemsize: int = 8, limit: int | None = None, slack: int = 50_000_000) -> bool:
    """Whether an array of that shape fits into `limit` bytes (by default the memory that is free) with some to spare."""
    if limit is None:
        limit = os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
    size = itemsize
    for n in shape:
        size *= int(n)
    return size < limit - slack


def allocate(jobs: int, requested: int | None = None, spark=None) -> int:
    """Parallel jobs to run: no more than there are, are asked for, and the cluster has cores."""
    cores = spark.sparkContext.defaultParallelism if spark else os.cpu_count()
    return max(1, min(jobs, requested or cores, cores))


def pickleable(obj) -> bool:
    """Whether an object can be sent to executors."""
    try:
        from pyspark import cloudpickle

        cloudpickle.dumps(obj)
    except (pickle.PicklingError, TypeError, AttributeError):
        return False
    return True
