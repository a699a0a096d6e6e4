"""One tree as an object, for use on the driver; tables of trees are what the rest of the package works on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from ..plans import stages
from . import kernels


@dataclass
class TreeVec:
    """A vector with branch lengths and taxa, if it has them; changes of the tree drop lengths, which they don't define."""

    data: list[int]
    branch_lengths: list[tuple[float, float]] | None = None
    taxa: list[str] | None = None
    is_rooted: bool = True

    @property
    def n_leaf(self) -> int:
        """The length of the vector."""
        return len(self.data)

    @classmethod
    def from_sample(cls, n_leaves: int, ordering: bool = False, seed: int | None = None) -> TreeVec:
        """A random tree: v[i] is uniform on 0..2i, or on 0..i for ordered ones."""
        draw = np.random.default_rng(seed)
        return cls([int(draw.integers(0, (i if ordering else 2 * i) + 1)) for i in range(n_leaves - 1)])

    def to_newick(self) -> str:
        return kernels.newick(self.data, self.branch_lengths)

    def get_ancestry(self) -> list[tuple[int, int, int]]:
        return kernels.ancestry(self.data)

    def get_edges(self) -> list[tuple[int, int]]:
        return [(child, p) for a, b, p in kernels.ancestry(self.data) for child in (a, b)]

    def _edited(self, spark: SparkSession, stage, **columns: int) -> dict:
        row = spark.createDataFrame([(self.data, *columns.values())], ", ".join(["v array<int>", *(f"{c} int" for c in columns)]))
        return stage(row).first().asDict()

    def add_leaf(self, spark: SparkSession, leaf: int, branch: int) -> None:
        self.data, self.branch_lengths = self._edited(spark, stages.with_leaf, leaf=leaf, branch=branch)["v"], None

    def remove_leaf(self, spark: SparkSession, leaf: int) -> int:
        """Takes the leaf away; returns its sister."""
        found = self._edited(spark, stages.without_leaf, leaf=leaf)
        self.data, self.branch_lengths = found["v"], None
        return found["sister"]


def reorder_v(method: str, v: list[int], labels: dict[int, str], shuffle_columns: bool = False, seed: int = 0) -> tuple[list[int], dict[int, str]]:
    """The vector with leaves renamed as ``queue_shuffle`` does ("birth_death"), and the names by new leaf."""
    if method != "birth_death":
        raise ValueError(f"unsupported method: {method}")
    new, mapping = kernels.shuffle(list(v), shuffle_columns, seed)
    return new, {i: labels[old] for i, old in enumerate(mapping)}
