"""Pixel filters on exploded planes ``(clip, frame_no, plane, y, x, v)``.

Every filter is a DataFrame transformation; geometry travels beside it on the
driver, so a chain is planned before any row is read.  Flips, crops and value
maps are projections (no shuffle); scaling is one partial aggregate per axis.
For whole frames see :mod:`reelspark.operators.packed`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: horizontal and vertical chroma subsampling
SUBSAMPLING = {"yuv420p": (2, 2), "yuv422p": (2, 1), "yuv444p": (1, 1)}
PIXEL = ["clip", "frame_no", "plane", "y", "x", "v"]


class FilterError(ValueError):
    """A filter was asked for something it cannot do."""


@dataclass(frozen=True)
class Geometry:
    width: int
    height: int
    pixfmt: str = "yuv420p"
    color_range: str | None = None

    @property
    def sub(self) -> tuple[int, int]:
        if self.pixfmt not in SUBSAMPLING:
            raise FilterError(f"{self.pixfmt} is not planar 8-bit YUV")
        return SUBSAMPLING[self.pixfmt]

    def plane(self, index: int) -> tuple[int, int]:
        """Width and height of a plane; chroma rounds up."""
        if index == 0:
            return self.width, self.height
        sx, sy = self.sub
        return -(-self.width // sx), -(-self.height // sy)


Framed = tuple[DataFrame, Geometry]


def _by_plane(g: Geometry, axis: int) -> Column:
    """Plane width (axis 0) or height (1) of each row."""
    return F.when(F.col("plane") == 0, F.lit(g.plane(0)[axis])).otherwise(F.lit(g.plane(1)[axis])).cast("bigint")


def hflip(df: DataFrame, g: Geometry) -> Framed:
    return df.withColumn("x", _by_plane(g, 0) - 1 - F.col("x")), g


def vflip(df: DataFrame, g: Geometry) -> Framed:
    return df.withColumn("y", _by_plane(g, 1) - 1 - F.col("y")), g


def transpose(df: DataFrame, g: Geometry, direction: int) -> Framed:
    """0 counter-clockwise and flipped, 1 clockwise, 2 counter-clockwise, 3
    clockwise and flipped.  Needs equal subsampling on both axes."""
    if direction not in (0, 1, 2, 3):
        raise FilterError(f"transpose: bad direction {direction}")
    sx, sy = g.sub
    if sx != sy:
        raise FilterError("transpose: chroma is not square")
    w, h = _by_plane(g, 0), _by_plane(g, 1)
    nx = F.col("y") if direction in (0, 2) else h - 1 - F.col("y")
    ny = F.col("x") if direction in (0, 1) else w - 1 - F.col("x")
    out = df.select("clip", "frame_no", "plane", ny.alias("y"), nx.alias("x"), "v")
    return out, replace(g, width=g.height, height=g.width)


def _aligned(g: Geometry, name: str, *values: tuple[int, int]) -> None:
    sx, sy = g.sub
    if any(a % sx or b % sy for a, b in values):
        raise FilterError(f"{name}: offset and size must align to the chroma grid")


def crop(df: DataFrame, g: Geometry, w: int, h: int, x: int, y: int) -> Framed:
    if x + w > g.width or y + h > g.height:
        raise FilterError("crop: rectangle exceeds the frame")
    _aligned(g, "crop", (x, y), (w, h))
    sx, sy = g.sub
    at = lambda full, sub: F.when(F.col("plane") == 0, F.lit(full)).otherwise(F.lit(full // sub)).cast("bigint")
    px, py, pw, ph = at(x, sx), at(y, sy), at(w, sx), at(h, sy)
    inside = (F.col("x") >= px) & (F.col("x") < px + pw) & (F.col("y") >= py) & (F.col("y") < py + ph)
    out = df.where(inside).withColumns({"x": F.col("x") - px, "y": F.col("y") - py})
    return out, replace(g, width=w, height=h)


def canvas(frames: DataFrame, g: Geometry) -> DataFrame:
    """Every pixel position of each ``(clip, frame_no)``, without values."""
    planes = F.array(*[F.struct(F.lit(p).cast("bigint").alias("plane"), *[F.lit(v).cast("bigint").alias(n) for n, v in zip("wh", g.plane(p))]) for p in range(3)])
    return (
        frames.select("clip", "frame_no").distinct()
        .select("clip", "frame_no", F.explode(planes).alias("p"))
        .select("clip", "frame_no", "p.plane", F.col("p.w").alias("w"), F.explode(F.expr("sequence(0L, p.h - 1)")).alias("y"))
        .select("clip", "frame_no", "plane", "y", F.explode(F.expr("sequence(0L, w - 1)")).alias("x"))
    )


def pad(df: DataFrame, g: Geometry, w: int, h: int, x: int, y: int) -> Framed:
    """Canvas of luma 0 and chroma 128 with the frame at (x, y)."""
    if x + g.width > w or y + g.height > h:
        raise FilterError("pad: frame does not fit the canvas")
    _aligned(g, "pad", (x, y), (w, h))
    sx, sy = g.sub
    big = replace(g, width=w, height=h)
    dx = F.when(F.col("plane") == 0, F.lit(x)).otherwise(F.lit(x // sx))
    dy = F.when(F.col("plane") == 0, F.lit(y)).otherwise(F.lit(y // sy))
    moved = df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    out = canvas(df, big).join(moved, ["clip", "frame_no", "plane", "y", "x"], "left")
    return out.select(*PIXEL[:5], F.coalesce("v", F.when(F.col("plane") == 0, 0).otherwise(128)).cast("bigint").alias("v")), big


def overlay(df: DataFrame, g: Geometry, over: DataFrame, og: Geometry, x: int, y: int) -> Framed:
    """A still picture ``over(plane, y, x, v)`` on every frame, offset snapped
    down to the chroma grid, clipped to the frame.  The picture is broadcast:
    its size is its geometry, checked here."""
    if og.pixfmt != g.pixfmt:
        raise FilterError("overlay: pixel formats differ")
    if og.width * og.height > 1 << 22:
        raise FilterError("overlay: picture is larger than 4 megapixels")
    sx, sy = g.sub
    x, y = x // sx * sx, y // sy * sy
    dx = F.when(F.col("plane") == 0, F.lit(x)).otherwise(F.lit(x // sx))
    dy = F.when(F.col("plane") == 0, F.lit(y)).otherwise(F.lit(y // sy))
    top = over.select("plane", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("v").alias("top"))
    out = df.join(F.broadcast(top), ["plane", "y", "x"], "left")
    return out.select("clip", "frame_no", "plane", "y", "x", F.coalesce("top", "v").alias("v")), g


def first_frame(df: DataFrame) -> DataFrame:
    """The first frame of each clip, as an overlay source."""
    low = df.groupBy("clip").agg(F.min("frame_no").alias("frame_no"))
    return df.join(low, ["clip", "frame_no"], "left_semi")


def scale_size(w: int, h: int, in_w: int, in_h: int) -> tuple[int, int]:
    """Output size; -1 keeps the aspect (integer division, then up to even, at
    least 2)."""
    even = lambda v: max(v, 2) + max(v, 2) % 2
    for v in (w, h):
        if v != -1 and v <= 0:
            raise FilterError(f"scale: bad dimension {v}")
    if w == h == -1:
        raise FilterError("scale: one dimension must be given")
    if w == -1:
        return even(in_w * h // max(in_h, 1)), h
    if h == -1:
        return w, even(in_h * w // max(in_w, 1))
    return w, h


def axis_table(df: DataFrame, planes: list[tuple[int, int, int]], names: tuple[str, str]) -> DataFrame:
    """Source index and weight of each destination index along one axis, in
    single precision: ``plane, <src>, <dst>, second, weight``.

    ``planes`` lists (plane, source length, destination length); two rows per
    destination index, so the table is as small as a frame's edge.
    """
    src, dst = names
    spec = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("plane", "s", "d"), p)]) for p in planes])
    f = lambda c: c.cast("float")
    half = f(F.lit(0.5))
    one = df.sparkSession.range(1)
    t = (
        one.select(F.explode(spec).alias("p")).select("p.*", F.explode(F.expr("sequence(0L, p.d - 1)")).alias(dst))
        .withColumn("ratio", f(F.col("s").cast("double") / F.col("d").cast("double")))
        .withColumn("pos", F.greatest(f((f(F.col(dst)) + half) * F.col("ratio")) - half, f(F.lit(0.0))))
        .withColumn("lo", F.floor("pos"))
        .withColumn("weight", F.col("pos") - f(F.col("lo")))
    )
    hi = F.least(F.col("lo") + 1, F.col("s") - 1)
    both = F.explode(F.array(F.struct(F.col("lo").alias("i"), F.lit(False).alias("second")), F.struct(hi.alias("i"), F.lit(True).alias("second"))))
    return t.select("plane", dst, "weight", both.alias("e")).select("plane", F.col("e.i").alias(src), dst, "e.second", "weight")


def _blend(value: str, weight: str = "weight") -> Column:
    """Weighted mean of the two samples of a group, in single precision."""
    one = F.lit(1.0).cast("float")
    lo = F.max(F.when(~F.col("second"), F.col(value)))
    hi = F.max(F.when(F.col("second"), F.col(value)))
    w = F.max(weight)
    return lo * (one - w) + hi * w


def scale(df: DataFrame, g: Geometry, w: int, h: int) -> Framed:
    """Bilinear resize, half-pixel centres, edges clamped, rounded once."""
    w, h = scale_size(w, h, g.width, g.height)
    big = replace(g, width=w, height=h)
    planes = range(3)
    tx = axis_table(df, [(p, g.plane(p)[0], big.plane(p)[0]) for p in planes], ("x", "dx"))
    ty = axis_table(df, [(p, g.plane(p)[1], big.plane(p)[1]) for p in planes], ("y", "dy"))
    rows = (
        df.withColumn("v", F.col("v").cast("float")).join(F.broadcast(tx), ["plane", "x"])
        .groupBy("clip", "frame_no", "plane", "y", "dx").agg(_blend("v").alias("v"))
    )
    out = rows.join(F.broadcast(ty), ["plane", "y"]).groupBy("clip", "frame_no", "plane", "dy", "dx").agg(_blend("v").alias("v"))
    return out.select("clip", "frame_no", "plane", F.col("dy").alias("y"), F.col("dx").alias("x"), _to_byte(F.col("v")).alias("v")), big


def _to_byte(v: Column) -> Column:
    """Round half away from zero and clamp to 0..255."""
    v = v.cast("double")
    r = F.when(v < 0, F.ceil(v - 0.5)).otherwise(F.floor(v + 0.5))
    return F.greatest(F.least(r, F.lit(255)), F.lit(0)).cast("bigint")


def negate(df: DataFrame, g: Geometry) -> Framed:
    return df.withColumn("v", 255 - F.col("v")), g


def gray(df: DataFrame, g: Geometry) -> Framed:
    return df.withColumn("v", F.when(F.col("plane") > 0, F.lit(128)).otherwise(F.col("v")).cast("bigint")), g


def setrange(df: DataFrame, g: Geometry, target: str) -> Framed:
    """Rescale between limited and full range; RGB passes through."""
    if target not in ("full", "limited"):
        raise FilterError(f"setrange: {target}")
    if g.pixfmt not in SUBSAMPLING:
        return df, g
    span = F.when(F.col("plane") == 0, F.lit(219.0)).otherwise(F.lit(224.0)).cast("float")
    v = F.col("v").cast("float")
    lo, top = F.lit(16.0).cast("float"), F.lit(255.0).cast("float")
    mapped = (((v - lo) * top) / span).cast("float") if target == "full" else ((v * span) / top).cast("float") + lo
    return df.withColumn("v", _to_byte(mapped)), replace(g, color_range=target)


@dataclass(frozen=True)
class ColorSpec:
    """Luma weights and range of a YUV/RGB conversion."""

    kr: float = 0.299
    kb: float = 0.114
    limited: bool = False

    @property
    def kg(self) -> float:
        return 1.0 - self.kr - self.kb

    @classmethod
    def parse(cls, *options: str) -> ColorSpec:
        matrices = {"bt601": (0.299, 0.114), "601": (0.299, 0.114), "smpte170m": (0.299, 0.114), "bt709": (0.2126, 0.0722), "709": (0.2126, 0.0722)}
        ranges = {"full": False, "pc": False, "jpeg": False, "limited": True, "tv": True, "mpeg": True}
        kr, kb, limited = 0.299, 0.114, False
        for o in options:
            if o in matrices:
                kr, kb = matrices[o]
            elif o in ranges:
                limited = ranges[o]
            elif o:
                raise FilterError(f"format: option {o}")
        return cls(kr, kb, limited)

    def forward(self) -> dict[str, float]:
        """RGB to YUV: offset, scales, and the chroma weights of r, g and b."""
        kr, kg, kb = self.kr, self.kg, self.kb
        return {
            "yoff": 16.0 if self.limited else 0.0, "yscale": 219 / 255 if self.limited else 1.0, "cscale": 224 / 255 if self.limited else 1.0,
            "ur": -0.5 * kr / (1 - kb), "ug": -0.5 * kg / (1 - kb), "vg": -0.5 * kg / (1 - kr), "vb": -0.5 * kb / (1 - kr),
        }

    def inverse(self) -> dict[str, float]:
        """YUV to RGB: offset, luma scale, and the weights of the chroma planes."""
        c = 255 / 224 if self.limited else 1.0
        return {
            "yoff": 16.0 if self.limited else 0.0, "yscale": 255 / 219 if self.limited else 1.0,
            "rv": 2 * (1 - self.kr) * c, "gu": -2 * self.kb * (1 - self.kb) / self.kg * c,
            "gv": -2 * self.kr * (1 - self.kr) / self.kg * c, "bu": 2 * (1 - self.kb) * c,
        }


def rgb_to_yuv420(rgb: DataFrame, spec: ColorSpec = ColorSpec()) -> DataFrame:
    """``rgb(clip, frame_no, y, x, r, g, b)`` to 4:2:0 planes; chroma from the
    mean of each block of up to 2 x 2 pixels."""
    k = spec.forward()
    luma = rgb.select(
        "clip", "frame_no", F.lit(0).cast("bigint").alias("plane"), "y", "x",
        _to_byte(k["yoff"] + k["yscale"] * (spec.kr * F.col("r") + spec.kg * F.col("g") + spec.kb * F.col("b"))).alias("v"),
    )
    block = rgb.groupBy("clip", "frame_no", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(*[F.avg(c).alias(c) for c in "rgb"])
    u = 128 + k["cscale"] * (k["ur"] * F.col("r") + k["ug"] * F.col("g") + 0.5 * F.col("b"))
    v = 128 + k["cscale"] * (0.5 * F.col("r") + k["vg"] * F.col("g") + k["vb"] * F.col("b"))
    both = F.explode(F.array(F.struct(F.lit(1).cast("bigint").alias("plane"), _to_byte(u).alias("v")), F.struct(F.lit(2).cast("bigint").alias("plane"), _to_byte(v).alias("v"))))
    chroma = block.select("clip", "frame_no", "y", "x", both.alias("e")).select("clip", "frame_no", "e.plane", "y", "x", "e.v")
    return luma.unionByName(chroma)


def yuv_to_rgb(df: DataFrame, g: Geometry, spec: ColorSpec = ColorSpec()) -> DataFrame:
    """Planes to ``clip, frame_no, y, x, r, g, b``; chroma is replicated.

    One join of luma with the pivoted chroma on the chroma position."""
    k, (sx, sy) = spec.inverse(), g.sub
    luma = df.where("plane = 0").select("clip", "frame_no", "y", "x", F.expr(f"y div {sy}").alias("cy"), F.expr(f"x div {sx}").alias("cx"), F.col("v").alias("l"))
    chroma = (
        df.where("plane > 0").groupBy("clip", "frame_no", F.col("y").alias("cy"), F.col("x").alias("cx"))
        .agg(F.max(F.when(F.col("plane") == 1, F.col("v"))).alias("u"), F.max(F.when(F.col("plane") == 2, F.col("v"))).alias("w"))
    )
    j = luma.join(chroma, ["clip", "frame_no", "cy", "cx"])
    a, u, w = k["yscale"] * (F.col("l") - k["yoff"]), F.col("u") - 128, F.col("w") - 128
    return j.select(
        "clip", "frame_no", "y", "x",
        _to_byte(a + k["rv"] * w).alias("r"), _to_byte(a + k["gu"] * u + k["gv"] * w).alias("g"), _to_byte(a + k["bu"] * u).alias("b"),
    )


def to_420(df: DataFrame, g: Geometry) -> Framed:
    """4:2:2 or 4:4:4 to 4:2:0: rounded mean of the chroma that is dropped, the
    edge sample repeated where a block is cut off."""
    sx, sy = g.sub
    if (sx, sy) == (2, 2):
        return df, g
    fx, fy = 2 // sx, 2 // sy
    cw, ch = g.plane(1)
    out = replace(g, pixfmt="yuv420p")
    # a source sample at the edge counts once more for each position past it
    repeat = lambda c, f, n: F.when(F.col(c) == n - 1, F.lit(f - (n - 1) % f)).otherwise(F.lit(1))
    times = repeat("x", fx, cw) * repeat("y", fy, ch)
    chroma = (
        df.where("plane > 0").groupBy("clip", "frame_no", "plane", F.expr(f"y div {fy}").alias("y"), F.expr(f"x div {fx}").alias("x"))
        .agg(F.sum(F.col("v") * times).alias("s"), F.sum(times).alias("n"))
        .select("clip", "frame_no", "plane", "y", "x", F.expr("(s + n div 2) div n").alias("v"))
    )
    return df.where("plane = 0").select(*PIXEL).unionByName(chroma), out


def rgba_to_rgb(df: DataFrame) -> DataFrame:
    """Interleaved ``(clip, frame_no, y, x, ch, v)`` without its alpha channel."""
    return df.where("ch < 3")


_RANGES = {"full": "full", "pc": "full", "jpeg": "full", "limited": "limited", "tv": "limited", "mpeg": "limited"}


def parse_chain(spec: str) -> list[tuple[str, list[str]]]:
    """``a=1:2,b`` as names and arguments, left to right; blanks are skipped."""
    out = []
    for part in spec.split(","):
        if part.strip():
            name, _, args = part.strip().partition("=")
            out.append((name.strip(), [a.strip() for a in args.split(":")] if args else []))
    return out


def apply_chain(df: DataFrame, g: Geometry, spec: str) -> Framed:
    """Fold a filter specification over exploded planes; unknown names raise."""
    for name, args in parse_chain(spec):
        try:
            n = [int(a) for a in args] if name in ("scale", "crop", "pad", "transpose") else []
        except ValueError as e:
            raise FilterError(f"{name}: {e}") from None
        if name == "scale" and len(n) == 2:
            df, g = scale(df, g, *n)
        elif name == "crop" and len(n) == 4:
            df, g = crop(df, g, *n)
        elif name == "pad" and len(n) == 4:
            df, g = pad(df, g, *n)
        elif name == "transpose" and len(n) == 1:
            df, g = transpose(df, g, *n)
        elif name == "hflip":
            df, g = hflip(df, g)
        elif name == "vflip":
            df, g = vflip(df, g)
        elif name == "negate":
            df, g = negate(df, g)
        elif name in ("gray", "grayscale"):
            df, g = gray(df, g)
        elif name == "setrange" and args and args[0] in _RANGES:
            df, g = setrange(df, g, _RANGES[args[0]])
        elif name == "format" and args == ["yuv420p"]:
            df, g = to_420(df, g)
        else:
            raise FilterError(f"unknown or malformed filter {name}={':'.join(args)}")
    return df, g
