"""Declared pipelines: a registry of operators by name, and a list of steps that compiles to one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from stratocloud.operators import affine, color, normalize, schema, select, views, voxel

Operator = Callable[..., DataFrame]


class Registry:
    """Operators by name. A name can be taken once unless ``force`` is given."""

    def __init__(self, name: str):
        self.name, self.known = name, {}

    def register(self, operator: Operator | None = None, *, name: str | None = None, force: bool = False):
        if operator is None:
            return lambda f: self.register(f, name=name, force=force)
        name = name or operator.__name__
        if name in self.known and not force:
            raise KeyError(f"{name} is already registered in {self.name}")
        self.known[name] = operator
        return operator

    def get(self, name: str) -> Operator:
        """By name; a prefix ``registry.`` is allowed."""
        name = name.removeprefix(f"{self.name}.")
        if name not in self.known:
            raise KeyError(f"{name} is not in {self.name}")
        return self.known[name]

    def build(self, step: dict) -> Callable[[DataFrame], DataFrame]:
        """A step is the operator's name under ``type`` and its arguments."""
        if "type" not in step:
            raise KeyError(f"a step needs a type: {step}")
        operator, options = self.get(step["type"]), {k: v for k, v in step.items() if k != "type"}

        def apply(df: DataFrame) -> DataFrame:
            try:
                return operator(df, **options)
            except TypeError as e:
                raise TypeError(f"{step['type']}: {e}") from e

        return apply


OPERATORS = Registry("operators")
for _module, _names in (
    (
        affine,
        "center_shift positive_shift normalize_coord random_shift point_clip rotate random_rotate random_rotate_target random_scale random_flip random_jitter clip_gaussian_jitter scale_by scale_to_volume grid_coord layout_offset",
    ),
    (
        color,
        "normalize_color auto_contrast color_translation color_jitter_noise grayscale brightness contrast saturation hue color_jitter hue_saturation_translation color_drop",
    ),
    (schema, "collect copy update to_tensor_types"),
    (select, "random_dropout sphere_crop nearest_to shuffle_points crop_boundary pre_downsample adjust_density"),
    (voxel, "with_cells voxel_pick voxel_fragments voxel_inverse spatial_sample spacing_sample voxel_centroids spatial_grid"),
    (normalize, "elastic_distortion gentle_upsample"),
    (views, "multi_views"),
):
    for _name in _names.split():
        OPERATORS.register(getattr(_module, _name))


@dataclass
class Plan:
    """Steps that are applied in order. Nothing runs before an action on the result."""

    steps: list[dict] = field(default_factory=list)
    registry: Registry = OPERATORS

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(self.registry.build(step))
        return df

    def explain(self, df: DataFrame) -> str:
        """The plan without running it."""
        return self.apply(df)._jdf.queryExecution().toString()


def default(size: float = 0.02, keys: Iterable[str] = ("scene_id", "pid", "gx", "gy", "gz", "segment", "x", "y", "z", "r", "g", "b")) -> Plan:
    """Centre, one point a cell, colours to 0..1, tensor types, the columns asked for."""
    return Plan([{"type": "center_shift"}, {"type": "voxel_pick", "size": size}, {"type": "normalize_color"}, {"type": "to_tensor_types"}, {"type": "collect", "keys": list(keys)}])


def pretraining(size: float = 0.02, most: int = 65_536) -> Plan:
    """One point a cell, the original coordinates kept beside, two global and four local views."""
    return Plan([{"type": "voxel_pick", "size": size}, {"type": "copy"}, {"type": "multi_views", "most": most}, {"type": "update", "values": {"grid_size": size}}])


#: The augmentations of fine-tuning.
AUGMENTATIONS = (
    {"type": "random_dropout", "ratio": 0.2, "application_ratio": 0.2},
    {"type": "random_rotate", "angle": (-1, 1), "axis": "z", "center": (0, 0, 0)},
    {"type": "random_rotate", "angle": (-1 / 64, 1 / 64), "axis": "x"},
    {"type": "random_rotate", "angle": (-1 / 64, 1 / 64), "axis": "y"},
    {"type": "random_scale", "scale": (0.9, 1.1)},
    {"type": "random_flip"},
    {"type": "random_jitter", "sigma": 0.005, "clip": 0.02},
    {"type": "auto_contrast"},
    {"type": "color_translation"},
    {"type": "color_jitter_noise"},
)


def training(size: float = 0.02, most: int = 102_400) -> Plan:
    """The augmentations of fine-tuning, then a crop and colours to 0..1."""
    last = [
        {"type": "voxel_pick", "size": size}, {"type": "sphere_crop", "point_max": most},
        {"type": "center_shift", "apply_z": False}, {"type": "normalize_color"}, {"type": "to_tensor_types"},
    ]
    return Plan([{"type": "center_shift"}, *AUGMENTATIONS, *last])
