"""Providers of corpora. A provider says what it makes from its settings; keeping the corpus on disk is the same for all."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import ClassVar

from pyspark.sql import SparkSession


class Provider(ABC):
    """A class with a ``kind`` is known by it from its definition on."""

    kinds: ClassVar[dict[str, type[Provider]]] = {}
    kind: ClassVar[str] = ""

    def __init_subclass__(cls, **rest):
        super().__init_subclass__(**rest)
        if cls.kind:
            Provider.kinds[cls.kind] = cls

    def __init__(self, settings: dict | None = None):
        self.settings = {k: v for k, v in (settings or {}).items() if k != "out_dir"}
        self.out_dir = (settings or {}).get("out_dir")

    @abstractmethod
    def make(self, spark: SparkSession):
        """The corpus of ``settings``, not yet written."""

    def recorded(self) -> dict:
        """What the manifest keeps of the settings."""
        return self.settings

    def __call__(self, spark: SparkSession):
        made = self.make(spark)
        if not self.out_dir:
            return made
        from . import files

        files.save(made, self.out_dir, self.kind, self.recorded())
        return files.load(spark, self.out_dir)


def provide(spark: SparkSession, kind: str, settings: dict | None = None):
    """The corpus of a kind of provider; a KeyError names the kinds there are."""
    if (cls := Provider.kinds.get(kind)) is None:
        raise KeyError(f"{kind!r} is no provider; known are: {', '.join(sorted(Provider.kinds))}")
    return cls(settings)(spark)
