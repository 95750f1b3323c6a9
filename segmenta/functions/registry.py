"""Extension points: engines, translators, embedders and callbacks by name.

An engine is a function over iterators of pandas frames, as mapInPandas takes them, so
that it can load its model once a task. Names are tried in the order asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

Engine = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass
class Provider:
    """A named engine with what it can do and whether it is there."""

    name: str
    make: Callable[[], Engine]
    kind: str = "asr"
    languages: frozenset[str] = frozenset()
    available: Callable[[], bool] = lambda: True


@dataclass
class Registry:
    """Providers by name; engines are made when first asked for."""

    providers: dict[str, Provider] = field(default_factory=dict)
    _made: dict[str, Engine] = field(default_factory=dict)

    def register(self, provider: Provider) -> None:
        self.providers[provider.name] = provider
        self._made.pop(provider.name, None)

    def names(self, kind: str | None = None, language: str | None = None) -> list[str]:
        """Available providers of a kind that know a language."""
        some = (p for p in self.providers.values() if (kind is None or p.kind == kind) and (language is None or not p.languages or language in p.languages))
        return sorted(p.name for p in some if p.available())

    def get(self, *names: str) -> Engine:
        """The first of names that is available; ValueError if none is."""
        for n in names:
            if n in self.providers and self.providers[n].available():
                if n not in self._made:
                    self._made[n] = self.providers[n].make()
                return self._made[n]
        raise ValueError(f"none of {', '.join(names)} is available; there are: {', '.join(self.names())}")


def run(df: DataFrame, engine: Engine, schema: str) -> DataFrame:
    """A frame through an engine, partition by partition."""
    ship(SparkSession.active())
    return df.mapInPandas(engine, schema)


def run_with_fallback(df: DataFrame, engines: Sequence[Engine], schema: str) -> DataFrame:
    """A frame through the first engine that does not fail on a batch; the last one's failure is the task's."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, engine in enumerate(engines):
                try:
                    made = list(engine(iter([batch])))
                except Exception:
                    if i == len(engines) - 1:
                        raise
                else:
                    yield from made
                    break

    return run(df, chain, schema)
