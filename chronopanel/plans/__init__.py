"""Query catalogue: one Spark plan and, where SQL can say it, one oracle per operator."""

from importlib import import_module

MODULES = (
    "landing imports proxies filters joins aggregates windows features tops sets scalars portfolios "
    "inference families replication validation quality models contracts advisory ledgers"
).split()


def load():
    from .catalog import CATALOG

    for name in MODULES:
        try:
            import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"{__name__}.{name}":
                raise
    return CATALOG
