"""Task profiles: the camera, how many objects of what kind a task expects, which side goes first, what waits for what. A small table that plans join."""

from __future__ import annotations

from dataclasses import astuple, dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Profile:
    name: str
    camera: str
    expected_objects: int
    object_kind: str
    priority: str | None = None
    dependencies: tuple[str, ...] = ()


#: Fixed values of the known tasks.
PROFILES = (
    Profile("drawer", "observation.images.top", 1, "saturated", None, ("open_before_insert", "withdraw_before_close")),
    Profile("letters", "observation.images.top", 4, "saturated", "left"),
    Profile("workpiece", "observation.images.right_environment_1", 4, "dark", "alternating_pickups"),
)


def profile(name: str, **overrides: object) -> Profile:
    """A known task with some fields changed; an error if the task or a field isn't known."""
    found = {p.name: p for p in PROFILES}
    if name not in found:
        raise KeyError(f"no task {name}")
    return replace(found[name], **overrides)


def table(spark: SparkSession, *profiles: Profile) -> DataFrame:
    """The rows of ``profiles``, or of all known tasks."""
    rows = [(*astuple(p)[:-1], list(p.dependencies)) for p in profiles or PROFILES]
    return spark.createDataFrame(rows, "name string, camera string, expected_objects long, object_kind string, priority string, dependencies array<string>")
