"""A chain of operators as one logical plan.

Steps are looked up by name, validated against their option schema and folded
over the DataFrame, so Catalyst sees the whole chain at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import aggregate, folds, nearest, pixel, remap, spectral, stencil, temporal

Transform = Callable[..., DataFrame]


@dataclass(frozen=True)
class Option:
    """One option: its kind and what it may hold."""
    kind: str                       # RANGE, BOOL, ENUM, COLOR, COLOR_ARRAY, PALETTE, STRING, CURVE, ...
    default: object = None
    low: float | None = None
    high: float | None = None
    step: float | None = None
    values: tuple = ()

    def check(self, name: str, v):
        if self.kind == "RANGE":
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not self.low <= v <= self.high:
                raise ValueError(f"{name} must be a number in [{self.low}, {self.high}], not {v!r}")
        elif self.kind == "BOOL" and not isinstance(v, bool):
            raise ValueError(f"{name} must be true or false, not {v!r}")
        elif self.kind == "ENUM" and v not in self.values:
            raise ValueError(f"{name} must be one of {self.values}, not {v!r}")
        elif self.kind == "COLOR" and (len(v) < 3 or any(not 0 <= c <= 255 for c in v)):
            raise ValueError(f"{name} must be a colour, not {v!r}")
        return v


def rng(low, high, default, step=None) -> Option:
    return Option("RANGE", default, low, high, step)


@dataclass(frozen=True)
class Operator:
    name: str
    fn: Transform
    options: dict[str, Option] = field(default_factory=dict)
    sized: bool = False             # needs the frame's width and height
    temporal: bool = False

    def validate(self, params: dict) -> dict:
        known = dict(params)
        for k, o in self.options.items():
            if k in known:
                o.check(f"{self.name}.{k}", known[k])
        return known


REGISTRY: dict[str, Operator] = {}


def register(name: str, fn: Transform, options: dict | None = None, *, sized=False, temporal=False) -> None:
    """Add an operator; also the way to plug in a user's own DataFrame function."""
    REGISTRY[name] = Operator(name, fn, options or {}, sized, temporal)


U8 = (0, 255)
for _n, _f, _o in [
    ("none", pixel.identity, {}),
    ("grayscale", pixel.grayscale, {}),
    ("invert", pixel.invert, {k: Option("BOOL") for k in ("invertR", "invertG", "invertB", "invertA")}),
    ("binarize", pixel.binarize, {f"threshold{c}": rng(*U8, 127.5) for c in "RGBA"}),
    ("brightness_contrast", pixel.brightness_contrast, {
        "brightness": rng(-255, 255, 0), "contrast": rng(-40, 40, 0), "exposure": rng(-4, 4, 1), "gamma": rng(-1.5, 7.5, 1)}),
    ("levels", pixel.levels, {"blackPoint": rng(*U8, 0), "whitePoint": rng(*U8, 255), "gamma": rng(0.1, 3, 1),
                              "outputBlack": rng(*U8, 0), "outputWhite": rng(*U8, 255)}),
    ("channel_mixer", pixel.channel_mixer, {a + b: rng(-1, 2, float(a == b)) for a, b in product("rgb", "rgb")}),
    ("color_balance", pixel.color_balance, {f"{z}{c}": rng(-100, 100, 0) for z in ("shadow", "midtone", "highlight") for c in "RGB"}),
    ("color_shift", pixel.color_shift, {"hue": rng(-180, 180, 0), "saturation": rng(-1, 1, 0), "value": rng(-1, 1, 0)}),
    ("color_threshold", pixel.color_threshold, {"hueCenter": rng(0, 360, 0), "hueRange": rng(5, 180, 30), "saturationMin": rng(0, 1, 0.2)}),
    ("duotone", pixel.duotone, {"shadowColor": Option("COLOR"), "highlightColor": Option("COLOR")}),
    ("gradient_map", pixel.gradient_map, {"mix": rng(0, 1, 1), **{f"color{k}": Option("COLOR") for k in (1, 2, 3)}}),
    ("luma_matte", pixel.luma_matte, {"threshold": rng(*U8, 128), "feather": rng(0, 80, 16),
                                      "backgroundMode": Option("ENUM", "BLACK", values=("BLACK", "WHITE", "TRANSPARENT"))}),
    ("posterize", pixel.posterize, {"levels": rng(2, 32, 4)}),
    ("chromatic_posterize", pixel.chromatic_posterize, {f"levels{c}": rng(2, 32, 4) for c in "RGB"}),
    ("bit_crush", pixel.bit_crush, {"bits": rng(1, 8, 3)}),
    ("sepia", pixel.sepia, {"intensity": rng(0, 1, 0.8)}),
    ("solarize", pixel.solarize, {"threshold": rng(*U8, 96)}),
    ("blend", pixel.blend, {"opacity": rng(0, 1, 0.5), "color": Option("COLOR"), "mode": Option("ENUM", "MULTIPLY", values=(
        "MULTIPLY", "SCREEN", "OVERLAY", "SOFT_LIGHT", "HARD_LIGHT", "DIFFERENCE", "EXCLUSION"))}),
    ("contour_map", pixel.contour_map, {"bands": rng(3, 20, 8)}),
    ("thermal_camera", pixel.thermal_camera, {"contrast": rng(0.5, 3, 1.2)}),
    ("lut", pixel.lut, {"strength": rng(0, 1.5, 1), "exposure": rng(-5, 5, 0)}),
    ("curves", pixel.curves, {"channel": Option("ENUM", "RGB", values=("RGB", "R", "G", "B", "LUMA")), "points": Option("CURVE")}),
    ("palette_mapper", pixel.palette_mapper, {"bandCount": rng(3, 16, 6), "hueOffset": rng(0, 360, 0), "saturationBoost": rng(0, 2, 1)}),
    ("ordered", pixel.ordered, {"thresholdMapScaleX": rng(1, 5, 1), "thresholdMapScaleY": rng(1, 5, 1),
                                "thresholdPolarity": Option("ENUM", "SHADOW", values=("SHADOW", "CLASSIC"))}),
    ("threshold_map", pixel.threshold_map, {"scale": rng(1, 8, 1)}),
    ("posterize_dither", pixel.posterize_dither, {f"levels{c}": rng(2, 16, 4) for c in "RGB"}),
    ("program", pixel.program, {c: Option("STRING", c) for c in "rgba"}),
    ("quantize", nearest.nearest_palette, {"palette": Option("PALETTE")}),
    ("histogram_equalization", aggregate.histogram_equalization, {}),
]:
    register(_n, _f, _o)
for _n, _f, _o in [
    ("vignette", pixel.vignette, {"strength": rng(0, 1, 0.5), "radius": rng(0.2, 1.5, 0.8), "softness": rng(0.1, 1, 0.4)}),
    ("clahe", aggregate.clahe, {"tileSize": rng(1, 64, 32), "clipLimit": rng(1, 10, 3)}),
    ("pixelate", aggregate.pixelate, {"scale": rng(0.01, 1, 0.25)}),
    ("hex_pixelate", aggregate.hex_pixelate, {}), ("triangle_pixelate", aggregate.triangle_pixelate, {}),
    ("convolve", stencil.convolve, {"strength": rng(-10, 10, 1)}),
    ("gaussian_blur", stencil.gaussian_blur, {"sigma": rng(0.5, 20, 3)}),
    ("sharpen", stencil.sharpen, {"strength": rng(0, 5, 1.5), "radius": rng(1, 20, 3), "threshold": rng(0, 50, 0)}),
    ("median_filter", stencil.median_filter, {"radius": rng(1, 8, 2)}),
    ("dilate_erode", stencil.dilate_erode, {"radius": rng(1, 10, 2), "mode": Option("ENUM", "DILATE", values=("DILATE", "ERODE"))}),
    ("despeckle", stencil.despeckle, {"threshold": rng(0, 50, 15), "radius": rng(1, 5, 2)}),
    ("kuwahara", stencil.kuwahara, {"radius": rng(1, 16, 3)}),
    ("oil_painting", stencil.oil_painting, {"radius": rng(1, 12, 4), "levels": rng(4, 30, 20)}),
    ("bilateral_blur", stencil.bilateral_blur, {"sigmaSpatial": rng(1, 20, 5), "sigmaRange": rng(5, 100, 30)}),
    ("anisotropic_diffusion", stencil.anisotropic_diffusion, {"iterations": rng(1, 50, 10), "kappa": rng(1, 200, 30), "lam": rng(0.05, 0.25, 0.2)}),
    ("emboss", stencil.emboss, {"angle": rng(0, 360, 135), "strength": rng(0, 3, 1), "blend": rng(0, 1, 0)}),
    ("edge_trace", stencil.edge_trace, {"threshold": rng(10, 100, 30), "lineWidth": rng(0.1, 3, 1)}),
    ("contour_lines", stencil.contour_lines, {"levels": rng(3, 30, 10), "lineWidth": rng(0.1, 4, 1)}),
    ("frequency_filter", stencil.frequency_filter, {"radius": rng(1, 24, 6), "bandWidth": rng(1, 24, 6), "gain": rng(0, 4, 1.5)}),
    ("relief_map", stencil.relief_map, {"lightAngle": rng(0, 360, 135), "height_scale": rng(0.1, 8, 2), "specular": rng(0, 1, 0.25)}),
    ("flip", remap.flip, {"mode": Option("ENUM", "HORIZONTAL", values=("HORIZONTAL", "VERTICAL", "BOTH"))}),
    ("rotate", remap.rotate, {"angle": rng(-180, 180, 15), "spinPerFrame": rng(-45, 45, 0)}),
    ("stretch", remap.stretch, {"scaleX": rng(0.1, 4, 1.5), "scaleY": rng(0.1, 4, 1)}),
    ("lens_distortion", remap.lens_distortion, {"k1": rng(-2, 2, 0.3), "k2": rng(-1, 1, 0), "zoom": rng(0.1, 3, 1)}),
    ("polar_transform", remap.polar_transform, {"angle": rng(-180, 180, 0)}),
    ("mirror", remap.mirror, {"segments": rng(2, 16, 6)}),
    ("displacement_map_xy", remap.displacement_map_xy, {"strength": rng(0, 200, 30), "blurRadius": rng(0, 20, 0)}),
    ("channel_separation", remap.channel_separation, {}),
    ("fft_bandpass", spectral.fft_bandpass, {"cutoff": rng(0.01, 1, 0.15), "gain": rng(0, 4, 1)}),
    ("fft_radial_notch", spectral.fft_radial_notch, {}), ("fft_angular_wedge", spectral.fft_angular_wedge, {}),
    ("fft_spectral_gate", spectral.fft_spectral_gate, {"threshold": rng(0, 0.2, 0.02)}),
    ("fft_dephase", spectral.fft_dephase, {"amount": rng(0, 1, 1)}),
    ("fft_phase_only", spectral.fft_phase_only, {"amount": rng(0, 1, 1), "gain": rng(0.1, 50, 10)}),
    ("fft_homomorphic", spectral.fft_homomorphic, {}), ("fft_deconvolve", spectral.fft_deconvolve, {}),
]:
    register(_n, _f, _o, sized=True)
for _n, _f, _o in [
    ("motion_analysis", temporal.motion_analysis, {"threshold": rng(0, 50, 10), "sensitivity": rng(1, 10, 3)}),
    ("scene_separation", temporal.scene_separation, {"threshold": rng(5, 80, 20), "feather": rng(0, 20, 5)}),
    ("temporal_edge", temporal.temporal_edge, {"threshold": rng(5, 80, 15), "sensitivity": rng(1, 10, 3), "decayRate": rng(0.01, 0.3, 0.08)}),
    ("long_exposure", temporal.long_exposure, {"blendFactor": rng(0.1, 0.95, 0.7), "windowSize": rng(2, 30, 8), "decay": rng(0.01, 0.3, 0.05)}),
    ("phosphor_decay", temporal.phosphor_decay, {f"{c}Decay": rng(0.01, 0.3, 0.1) for c in ("red", "green", "blue")}),
    ("echo_combiner", temporal.echo_combiner, {"gain": rng(0.5, 5, 2)}),
    ("chronophotography", temporal.chronophotography, {"exposures": rng(2, 16, 8), "interval": rng(1, 10, 2)}),
    ("time_median", temporal.time_median, {"windowSize": rng(3, 9, 5)}),
    ("stop_motion", temporal.stop_motion, {"holdFrames": rng(2, 30, 6)}),
    ("keyframe_smear", temporal.keyframe_smear, {"keyframeInterval": rng(2, 30, 8), "smear": rng(0, 1, 0.65)}),
    ("motion_pixelate", temporal.motion_pixelate, {"blockSize": rng(1, 32, 12), "threshold": rng(1, 50, 5)}),
    ("poster_hold", folds.poster_hold, {"levels": rng(2, 16, 5), "holdThreshold": rng(0, 96, 18), "releaseSpeed": rng(0.05, 1, 0.25)}),
]:
    register(_n, _f, _o, temporal=True)


@dataclass(frozen=True)
class Step:
    name: str
    params: dict = field(default_factory=dict)
    enabled: bool = True


def steps_of(chain) -> list[Step]:
    """Accept names, (name, params) pairs or Steps; at most 16."""
    out = [s if isinstance(s, Step) else Step(s) if isinstance(s, str) else Step(s[0], dict(s[1])) for s in chain]
    if len(out) > 16:
        raise ValueError("a chain holds at most 16 steps")
    return out


def apply_chain(df: DataFrame, chain, *, width: int | None = None, height: int | None = None,
                keep: dict[str, DataFrame] | None = None) -> DataFrame:
    """Fold the enabled steps into one plan.

    Unknown names and bad options fail here, before anything runs.  A `palette`
    parameter (except where the operator takes one itself) quantises the step's
    result.  Names in `keep` get that step's DataFrame, persisted for reuse.
    """
    plan = []
    for s in steps_of(chain):
        if not s.enabled:
            continue
        op = REGISTRY.get(s.name)
        if op is None:
            raise KeyError(f"unknown operator {s.name!r}")
        params = dict(s.params)
        post = params.pop("palette", None) if s.name not in ("quantize", "ordered") else None
        params = op.validate(params)
        if op.sized:
            if width is None or height is None:
                raise ValueError(f"{s.name} needs the frame size")
            params |= {"width": width, "height": height}
        plan.append((s.name, op.fn, params, post))

    def step(d: DataFrame, item) -> DataFrame:
        name, fn, params, post = item
        d = fn(d, **params)
        if post is not None:
            d = nearest.nearest_palette(d, post)
        if keep is not None and name in keep:
            d = keep[name] = d.persist()
        return d
    return reduce(step, plan, df)


def option_grid(spec: dict[str, tuple[float, float, float]]) -> list[dict[str, float]]:
    """All option combinations inside `(low, high, step)` ranges."""
    axes = []
    for name, (low, high, stp) in spec.items():
        n = int(round((high - low) / stp)) + 1
        axes.append([(name, low + k * stp) for k in range(n)])
    return [dict(c) for c in product(*axes)]


def sweep(df: DataFrame, chain_of: Callable[[dict], list], grid: list[dict], **kw) -> DataFrame:
    """Run a chain once per option set and tag the rows (`variant`)."""
    parts = [apply_chain(df, chain_of(p), **kw).withColumn("variant", F.lit(i)) for i, p in enumerate(grid)]
    return reduce(DataFrame.unionByName, parts)
