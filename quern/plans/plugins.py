"""Jobs from modules that users write."""

from __future__ import annotations

import importlib
import importlib.util
import sys
from pathlib import Path
from types import ModuleType

from pyspark import cloudpickle

from . import JOBS, Job

#: What a module must define.
NAME = "JOB"
_from: dict[str, str] = {}


def _open(plugin: str) -> tuple[str, ModuleType]:
    if plugin.endswith(".py"):
        name = Path(plugin).stem
        spec = importlib.util.spec_from_file_location(f"quern_plugin_{name}", plugin)
        module = importlib.util.module_from_spec(spec)
        sys.modules[module.__name__] = module
        try:
            spec.loader.exec_module(module)
        except BaseException:
            del sys.modules[module.__name__]
            raise
        return name, module
    return plugin.rpartition(".")[2], importlib.import_module(plugin)


def load(plugin: str) -> str:
    """Register the job that a module defines as JOB, and return its name: the module's. plugin is the module's dotted
    name or a path that ends in .py.

    A module that cannot be opened is an ImportError, one without JOB an AttributeError, and one whose JOB is no Job a
    TypeError. A plugin may be loaded again, and replaces itself, but no other job. Its functions travel to executors by
    value, so they need not have the module."""
    try:
        name, module = _open(plugin)
    except Exception as e:
        raise ImportError(f"cannot open plugin {plugin}: {e or type(e).__name__}") from e
    if not hasattr(module, NAME):
        raise AttributeError(f"plugin {plugin} defines no {NAME}")
    job = getattr(module, NAME)
    if not isinstance(job, Job):
        raise TypeError(f"{NAME} of plugin {plugin} is a {type(job).__name__}, not a Job")
    if name in JOBS and _from.get(name) != plugin:
        raise ValueError(f"job {name} exists already")
    cloudpickle.register_pickle_by_value(module)
    JOBS[name], _from[name] = job, plugin
    return name
