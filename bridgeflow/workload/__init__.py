"""The registered queries, by family."""

from importlib import import_module

FAMILIES = ["sources", "transform", "mapping", "contracts", "matching", "policy", "registry", "resilience",
            "topology", "metrics", "lifecycle", "jobs"]


def collect(kind: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out.update(getattr(import_module(f"{__name__}.{family}").suite, kind))
    return out
