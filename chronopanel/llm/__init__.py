"""Operators of a training-data pipeline. `load()` maps query names to (function, oracle SQL or None)."""

from importlib import import_module

MODULES = "mixing secrets vectors simhash quality toxicity windows encoding repeats counts negatives spots manifest".split()


def load() -> dict:
    out = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        out[module.QUERY] = (module.query, module.SQL)
    return out
