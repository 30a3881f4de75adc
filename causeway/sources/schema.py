"""The data model: memories with typed parts, edges, and the shape of a recall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = (
    "struct<kind:string,content:string,file:string,mimetype:string,think_id:string,signature:string,"
    "name:string,args:string,result:string,call_id:string>"
)
MEMORY = f"rowid bigint, uuid string, kind string, metadata string, parts array<{PART}>"
EDGE = "src_id bigint, dst_id bigint"
#: What a stored row carries as JSON text; args and result stay JSON text.
DATA = f"struct<metadata:string,kind:string,parts:array<{PART}>>"
PART_FIELDS = [f.split(":")[0] for f in PART[7:-1].split(",")]


@dataclass(frozen=True)
class RecallConfig:
    """Depth of references and dependencies (0: unbounded, negative: off) and node budget.

    A depth d of 1 or more reaches nodes d + 1 steps away.
    """

    refs: int = 5
    deps: int = 5
    memories: int = 5

    @staticmethod
    def reach(depth: int) -> float:
        return float("inf") if depth == 0 else 0 if depth < 0 else depth + 1


def part(kind: str, **fields: Column) -> Column:
    """A part struct with all fields; those not given are null."""
    return F.struct(
        *[(F.lit(kind) if n == "kind" else fields.get(n, F.lit(None))).cast("string").alias(n) for n in PART_FIELDS]
    )


def encode(metadata: Column, kind: Column, parts: Column) -> Column:
    """A memory as JSON text, without its identifiers."""
    return F.to_json(F.struct(metadata.alias("metadata"), kind.alias("kind"), parts.alias("parts")))


def decode(data: Column) -> Column:
    return F.from_json(data, DATA)


def valid(kind: Column, parts: Column) -> Column:
    """The discriminated union: who may have which parts, and the fields each part needs."""
    allowed = (
        F.when(kind == "self", F.array(*map(F.lit, ("text", "file", "think", "tool"))))
        .when(kind == "other", F.array(*map(F.lit, ("text", "file"))))
    )

    def complete(p: Column) -> Column:
        return (
            F.when(p["kind"].isin("text", "think"), p["content"].isNotNull())
            .when(p["kind"] == "file", p["file"].isNotNull() & p["mimetype"].isNotNull())
            .when(p["kind"] == "tool", p["name"].isNotNull() & p["call_id"].isNotNull())
            .otherwise(F.lit(False))
        )

    good = F.forall(parts, lambda p: F.array_contains(allowed, p["kind"]) & complete(p))
    return F.coalesce(good, F.lit(False))


def memory(uuid: Column, kind: str, parts: Column, metadata: Column | None = None, targets: Column | None = None) -> list[Column]:
    """The columns of a new memory of kind "self" or "other", as a batch for an append has them."""
    if kind not in ("self", "other"):
        raise ValueError(f"unknown kind {kind!r}")
    return [
        uuid.alias("uuid"), F.lit(kind).alias("kind"), (metadata if metadata is not None else F.lit("{}")).alias("metadata"), parts.alias("parts"),
        (targets if targets is not None else F.array().cast("array<string>")).alias("targets"),
    ]


def create_other(uuid: Column, text: Column, targets: Column, metadata: Column | None = None) -> list[Column]:
    return memory(uuid, "other", F.array(part("text", content=text)), metadata, targets)


def create_self(uuid: Column, parts: Column, targets: Column, metadata: Column | None = None) -> list[Column]:
    return memory(uuid, "self", parts, metadata, targets)
