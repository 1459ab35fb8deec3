"""Named operators: the driver-side surface that lists tools and calls them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Registry:
    """Functions by name, with a line of description each."""

    tools: dict[str, tuple[Callable, str]] = field(default_factory=dict)

    def add(self, name: str, call: Callable, description: str = "") -> None:
        self.tools[name] = (call, description or (call.__doc__ or "").strip().split("\n")[0])

    def names(self) -> list[str]:
        return sorted(self.tools)

    def describe(self) -> dict[str, str]:
        return {n: d for n, (_, d) in sorted(self.tools.items())}

    def call(self, name: str, *args, retries: int = 2, **options):
        """Call a tool; failures are tried again ``retries`` times."""
        if name not in self.tools:
            raise KeyError(f"no tool {name!r}")
        for turn in range(retries + 1):
            try:
                return self.tools[name][0](*args, **options)
            except Exception:  # noqa: BLE001
                if turn == retries:
                    raise


def standard() -> Registry:
    from siltstone.operators import chunk, classify, extract, fusion, graph, reasoning, retrieval, rules, telemetry

    out = Registry()
    for module in (chunk, classify, extract, fusion, graph, reasoning, retrieval, rules, telemetry):
        for name, value in vars(module).items():
            if callable(value) and getattr(value, "__module__", "") == module.__name__ and not name.startswith("_"):
                out.add(f"{module.__name__.rsplit('.', 1)[-1]}.{name}", value)
    return out
