"""Source manifests: typed records, merged by precedence, filtered by coverage and described by role."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS, TIERS = ("live", "baked", "model"), ("empirical", "modeled", "proxy", "synthetic", None)
#: Later layers stand above earlier ones, but a federal source does not replace a region's own.
LAYERS = {"base": 0, "federal": -1, "user": 1, "environment": 2}


@dataclass(frozen=True)
class Manifest:
    """One data source. Unknown keys and bad ids are refused."""

    id: str
    title: str
    kind: str
    role: str
    adapter: str
    tier: str | None = None
    doc_id: str | None = None
    scope: str | None = None
    order: int | None = None
    config: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.id):
            raise ValueError(f"bad source id: {self.id!r}")
        if self.kind not in KINDS or self.tier not in TIERS:
            raise ValueError(f"{self.id}: unknown kind or tier")

    @classmethod
    def parse(cls, record: dict) -> "Manifest":
        unknown = set(record) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return cls(**record)


def table(spark: SparkSession, layers: dict[str, list[Manifest]]) -> DataFrame:
    """All manifests with their layer; an id twice in one layer is refused."""
    rows = []
    for layer, manifests in layers.items():
        ids = [m.id for m in manifests]
        if len(ids) != len(set(ids)):
            raise ValueError(f"{layer}: an id occurs twice")
        rows += [(layer, LAYERS[layer], i, m.id, m.title, m.kind, m.role, m.adapter, m.tier, m.doc_id, m.scope, m.order, m.config) for i, m in enumerate(manifests)]
    schema = "layer string, rank int, ord int, id string, title string, kind string, role string, adapter string, tier string, doc_id string, scope string, order int, config map<string,string>"
    return spark.createDataFrame(rows, schema)


def merged(manifests: DataFrame) -> DataFrame:
    """One manifest of each id: that of the highest layer."""
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("rank"), "ord"))
    return manifests.withColumn("_n", best).where("_n = 1").drop("_n")


def described(manifests: DataFrame, roles: DataFrame) -> DataFrame:
    """Sources by the order of their role, then their own (999 where they have none), then id."""
    joined = manifests.join(roles, "role")
    place = F.row_number().over(Window.orderBy("role_order", F.coalesce("order", F.lit(999)), "id"))
    return joined.select(place.cast("long").alias("place"), "role", "id", "title", F.coalesce("doc_id", "id").alias("doc_id"))
