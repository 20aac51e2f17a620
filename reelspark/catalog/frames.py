"""Pixel filter queries over frames made of the vectors of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as ops
from ..operators.frames import ColorSpec, Geometry

W, H = 32, 24
G420 = Geometry(W, H, "yuv420p")


#: Elements of a vector of ``embeddings``, and whole pixels of three among them.
ELEMENTS, PIXELS = 64, 21
_VALUE = "cast(greatest(0, least(255, floor(cast({0} as double) * 400 + 128))) as bigint)"


def _vectors(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    """The vectors that fill whole groups of ``each``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return e.where(F.col("vec_id") < e.select(F.expr(f"(max(vec_id) + 1) div {each} * {each}")).scalar())


def planes(spark: SparkSession, sf_dir: str, w: int = W, h: int = H, pixfmt: str = "yuv420p") -> DataFrame:
    """Two clips whose frames are runs of vectors of ``embeddings``, by turns;
    each element is a pixel, found by its place without a shuffle."""
    g = Geometry(w, h, pixfmt)
    cw, ch = g.plane(1)
    n = -(-(w * h + 2 * cw * ch) // ELEMENTS)
    px = _vectors(spark, sf_dir, 2 * n).select("vec_id", F.posexplode("embedding").alias("i", "e"))
    px = px.selectExpr(
        f"if(vec_id % {2 * n} < {n}, 'A', 'B') as clip", f"vec_id div {2 * n} as frame_no", f"vec_id % {n} * {ELEMENTS} + i as p", f"{_VALUE.format('e')} as v"
    ).where(f"p < {w * h + 2 * cw * ch}")
    px = px.selectExpr("*", f"case when p < {w * h} then 0L when p < {w * h + cw * ch} then 1L else 2L end as plane")
    px = px.selectExpr("*", f"if(plane = 0, p, (p - {w * h}) % {cw * ch}) as q", f"if(plane = 0, {w}, {cw}) as pw")
    return px.selectExpr("clip", "frame_no", "plane", "q div pw as y", "q % pw as x", "v")


def rgb(spark: SparkSession, sf_dir: str, w: int = 31, h: int = 23) -> DataFrame:
    """One RGB clip of an odd size, three elements of a vector a pixel."""
    n = -(-w * h // PIXELS)
    px = _vectors(spark, sf_dir, n).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(PIXELS - 1))).alias("k")).where(f"vec_id % {n} * {PIXELS} + k < {w * h}")
    return px.selectExpr(
        "'A' as clip", f"vec_id div {n} as frame_no", f"(vec_id % {n} * {PIXELS} + k) div {w} as y", f"(vec_id % {n} * {PIXELS} + k) % {w} as x",
        *[f"{_VALUE.format(f'embedding[3 * k + {c}]')} as {name}" for c, name in enumerate("rgb")],
    )


def _pix_sql(w: int = W, h: int = H, pixfmt: str = "yuv420p") -> str:
    cw, ch = Geometry(w, h, pixfmt).plane(1)
    n = -(-(w * h + 2 * cw * ch) // ELEMENTS)
    return f"""
pix as (select clip, frame_no, plane, q // pw as y, q % pw as x, v from (
  select *, case when plane = 0 then p else (p - {w * h}) % {cw * ch} end as q, case when plane = 0 then {w} else {cw} end as pw from (
  select case when vec_id % {2 * n} < {n} then 'A' else 'B' end as clip, vec_id // {2 * n} as frame_no, vec_id % {n} * {ELEMENTS} + i as p, {_VALUE.format('e')} as v,
    case when p < {w * h} then 0 when p < {w * h + cw * ch} then 1 else 2 end::bigint as plane
  from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as i from embeddings
    where vec_id < (select (max(vec_id) + 1) // {2 * n} * {2 * n} from embeddings)))
  where p < {w * h + 2 * cw * ch}))"""


_RGB_N = -(-31 * 23 // PIXELS)
_RGB_SQL = f"""
rgb as (select 'A' as clip, vec_id // {_RGB_N} as frame_no, (vec_id % {_RGB_N} * {PIXELS} + k) // 31 as y, (vec_id % {_RGB_N} * {PIXELS} + k) % 31 as x,
  {_VALUE.format('embedding[3 * k + 1]')} as r, {_VALUE.format('embedding[3 * k + 2]')} as g, {_VALUE.format('embedding[3 * k + 3]')} as b
  from embeddings, range({PIXELS}) t(k) where vec_id % {_RGB_N} * {PIXELS} + k < {31 * 23} and vec_id < (select (max(vec_id) + 1) // {_RGB_N} * {_RGB_N} from embeddings))"""
_BYTE = "cast(greatest(0, least(255, case when {0} < 0 then ceil({0} - 0.5) else floor({0} + 0.5) end)) as bigint)"


def _byte(e: str) -> str:
    return _BYTE.format(f"({e})")


_PW, _PH = f"(case when plane = 0 then {W} else {W // 2} end)", f"(case when plane = 0 then {H} else {H // 2} end)"
_ALL = "clip, frame_no, plane, y, x, v"


def _transposed(spark, sf_dir):
    out = None
    for d in range(4):
        t = ops.transpose(planes(spark, sf_dir), G420, d)[0].select(F.lit(d).cast("bigint").alias("direction"), "*")
        out = t if out is None else out.unionByName(t)
    return out


def _scaled(spark, sf_dir):
    return ops.scale(planes(spark, sf_dir), G420, 20, -1)[0]


def _scale_sql(dw: int, dh: int) -> str:
    d = Geometry(dw, dh)
    ax = lambda i, n: " union all ".join(
        f"select {p}::bigint as plane, d, {G420.plane(p)[i]} as s, cast({G420.plane(p)[i]}::double / {d.plane(p)[i]} as float) as r from range({d.plane(p)[i]}) t(d)" for p in range(3)
    )
    tab = lambda name, i: (
        f"{name}0 as (select plane, d, s, greatest(cast((d::float + 0.5::float) * r as float) - 0.5::float, 0::float) as f from ({ax(i, name)})),"
        f"{name} as (select plane, d, cast(floor(f) as bigint) as lo, least(cast(floor(f) as bigint) + 1, s - 1) as hi, f - floor(f)::float as w from {name}0)"
    )
    mix = lambda a, b, w: f"cast(cast({a} * (1::float - {w}) as float) + cast({b} * {w} as float) as float)"
    return f"""with {_pix_sql()}, {tab('tx', 0)}, {tab('ty', 1)},
h as (select a.clip, a.frame_no, a.plane, a.y, tx.d as x, {mix('a.v::float', 'b.v::float', 'tx.w')} as v
      from tx join pix a on a.plane = tx.plane and a.x = tx.lo
      join pix b on b.clip = a.clip and b.frame_no = a.frame_no and b.plane = a.plane and b.y = a.y and b.x = tx.hi),
o as (select a.clip, a.frame_no, a.plane, ty.d as y, a.x, {mix('a.v', 'b.v', 'ty.w')}::double as v
      from ty join h a on a.plane = ty.plane and a.y = ty.lo
      join h b on b.clip = a.clip and b.frame_no = a.frame_no and b.plane = a.plane and b.x = a.x and b.y = ty.hi)
select clip, frame_no, plane, y, x, {_byte('v')} as v from o"""


def _overlay(spark, sf_dir):
    top = ops.first_frame(planes(spark, sf_dir, 8, 8).where("clip = 'B'")).select("plane", "y", "x", "v")
    return ops.overlay(planes(spark, sf_dir), G420, top, Geometry(8, 8), 27, 5)[0]


def _overlay_source(spark, sf_dir):
    return ops.first_frame(planes(spark, sf_dir, 8, 8).where("frame_no > 0 or clip = 'A'"))


def _ranges(spark, sf_dir):
    out = None
    for t in ("full", "limited"):
        r = ops.setrange(planes(spark, sf_dir), G420, t)[0].select(F.lit(t).alias("target"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def _yuv2rgb(spark, sf_dir):
    out = None
    for fmt in ("yuv420p", "yuv422p", "yuv444p"):
        for name, spec in (("601full", ColorSpec()), ("709limited", ColorSpec.parse("bt709", "limited"))):
            r = ops.yuv_to_rgb(planes(spark, sf_dir, 16, 12, fmt), Geometry(16, 12, fmt), spec).select(F.lit(fmt).alias("pixfmt"), F.lit(name).alias("spec"), "*")
            out = r if out is None else out.unionByName(r)
    return out


def _yuv2rgb_sql() -> str:
    parts = []
    for fmt in ("yuv420p", "yuv422p", "yuv444p"):
        sx, sy = ops.SUBSAMPLING[fmt]
        for name, s in (("601full", ColorSpec()), ("709limited", ColorSpec.parse("bt709", "limited"))):
            k = s.inverse()
            a = f"{k['yscale']!r}::double * (l.v - {k['yoff']!r}::double)"
            parts.append(
                f"(with {_pix_sql(16, 12, fmt)} select '{fmt}' as pixfmt, '{name}' as spec, l.clip, l.frame_no, l.y, l.x,"
                f" {_byte(f'{a} + {k['rv']!r}::double * (w.v - 128)')} as r, {_byte(f'{a} + {k['gu']!r}::double * (u.v - 128) + {k['gv']!r}::double * (w.v - 128)')} as g,"
                f" {_byte(f'{a} + {k['bu']!r}::double * (u.v - 128)')} as b"
                f" from pix l join pix u on u.plane = 1 and u.clip = l.clip and u.frame_no = l.frame_no and u.y = l.y // {sy} and u.x = l.x // {sx}"
                f" join pix w on w.plane = 2 and w.clip = l.clip and w.frame_no = l.frame_no and w.y = l.y // {sy} and w.x = l.x // {sx} where l.plane = 0)"
            )
    return " union all ".join(parts)


def _rgb2yuv(spark, sf_dir):
    out = None
    for name, spec in (("601full", ColorSpec()), ("709limited", ColorSpec.parse("bt709", "limited"))):
        r = ops.rgb_to_yuv420(rgb(spark, sf_dir), spec).select(F.lit(name).alias("spec"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def _rgb2yuv_sql() -> str:
    parts = []
    for name, s in (("601full", ColorSpec()), ("709limited", ColorSpec.parse("bt709", "limited"))):
        k = s.forward()
        d = lambda v: f"{v!r}::double"
        y = f"{d(k['yoff'])} + {d(k['yscale'])} * ({d(s.kr)} * r + {d(s.kg)} * g + {d(s.kb)} * b)"
        u = f"128 + {d(k['cscale'])} * ({d(k['ur'])} * r + {d(k['ug'])} * g + 0.5::double * b)"
        v = f"128 + {d(k['cscale'])} * (0.5::double * r + {d(k['vg'])} * g + {d(k['vb'])} * b)"
        parts.append(f"select '{name}' as spec, clip, frame_no, 0::bigint as plane, y, x, {_byte(y)} as v from rgb")
        for p, e in ((1, u), (2, v)):
            parts.append(f"select '{name}', clip, frame_no, {p}::bigint, y, x, {_byte(e)} from block")
    return f"with {_RGB_SQL}, block as (select clip, frame_no, y // 2 as y, x // 2 as x, avg(r) as r, avg(g) as g, avg(b) as b from rgb group by 1, 2, 3, 4) " + " union all ".join(parts)


def _to420(spark, sf_dir):
    out = None
    for fmt in ("yuv422p", "yuv444p"):
        r = ops.to_420(planes(spark, sf_dir, 15, 11, fmt), Geometry(15, 11, fmt))[0].select(F.lit(fmt).alias("pixfmt"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def _to420_sql() -> str:
    parts = []
    for fmt in ("yuv422p", "yuv444p"):
        sx, sy = ops.SUBSAMPLING[fmt]
        fx, fy = 2 // sx, 2 // sy
        cw, ch = Geometry(15, 11, fmt).plane(1)
        parts.append(
            f"(with {_pix_sql(15, 11, fmt)}, o as (select p as plane, j, i, dy, dx from range(1, 3) q(p), range(6) a(j), range(8) b(i), range({fy}) c(dy), range({fx}) d(dx))"
            f" select '{fmt}' as pixfmt, clip, frame_no, plane, y, x, v from pix where plane = 0 union all"
            f" select '{fmt}', s.clip, s.frame_no, o.plane, j, i, cast((sum(v) + count(*) // 2) // count(*) as bigint) from o join pix s on s.plane = o.plane"
            f" and s.y = least(j * {fy} + dy, {ch - 1}) and s.x = least(i * {fx} + dx, {cw - 1}) group by 2, 3, 4, 5, 6)"
        )
    return " union all ".join(parts)


def _rgba(spark, sf_dir):
    ch = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("ch"), e.alias("v")) for i, e in enumerate((F.col("r"), F.col("g"), F.col("b"), F.lit(255).cast("bigint")))])).alias("e")
    return ops.rgba_to_rgb(rgb(spark, sf_dir).select("clip", "frame_no", "y", "x", ch).select("clip", "frame_no", "y", "x", "e.*"))


def _dims(spark, sf_dir):
    rows = []
    for spec in ("scale=20:-1", "scale=-1:17", "crop=16:8:2:4,hflip", "pad=40:40:4:4,transpose=1", "transpose=2,vflip"):
        g = ops.apply_chain(planes(spark, sf_dir), G420, spec)[1]
        rows.append((spec, g.width, g.height))
    return spark.createDataFrame(rows, "spec string, width bigint, height bigint")


def _chain(spark, sf_dir):
    return ops.apply_chain(planes(spark, sf_dir), G420, "crop=16:12:4:2, hflip,,negate,pad=24:16:4:2,transpose=1")[0]


def _colorspec(spark, sf_dir):
    rows = []
    for m in ("bt601", "bt709"):
        for r in ("full", "limited"):
            s = ColorSpec.parse(m, r)
            rows += [(m, r, k, round(v, 9)) for k, v in s.inverse().items()]
    return spark.createDataFrame(rows, "matrix string, color_range string, name string, value double")


_COLOR_SQL = """
with m(matrix, kr, kb) as (values ('bt601', 0.299::double, 0.114::double), ('bt709', 0.2126::double, 0.0722::double)),
r(color_range, ys, cs, off) as (values ('full', 1.0::double, 1.0::double, 0.0::double), ('limited', 255.0::double / 219, 255.0::double / 224, 16.0::double)),
k as (select *, 1 - kr - kb as kg from m, r)
select matrix, color_range, name, round(value, 9) as value from (
 select matrix, color_range, 'yoff' as name, off as value from k union all select matrix, color_range, 'yscale', ys from k
 union all select matrix, color_range, 'rv', 2 * (1 - kr) * cs from k union all select matrix, color_range, 'bu', 2 * (1 - kb) * cs from k
 union all select matrix, color_range, 'gu', -2 * kb * (1 - kb) / kg * cs from k union all select matrix, color_range, 'gv', -2 * kr * (1 - kr) / kg * cs from k)"""

QUERIES = {
    "vf_hflip": lambda s, d: ops.hflip(planes(s, d), G420)[0],
    "vf_vflip": lambda s, d: ops.vflip(planes(s, d), G420)[0],
    "vf_negate": lambda s, d: ops.negate(planes(s, d), G420)[0],
    "vf_gray": lambda s, d: ops.gray(planes(s, d), G420)[0],
    "vf_crop": lambda s, d: ops.crop(planes(s, d), G420, 16, 10, 6, 4)[0],
    "vf_pad": lambda s, d: ops.pad(planes(s, d), G420, 44, 36, 6, 8)[0],
    "vf_transpose": _transposed,
    "vf_scale": _scaled,
    "vf_setrange": _ranges,
    "vf_overlay": _overlay,
    "vf_overlay_decode": _overlay_source,
    "vf_format_rgb2yuv": _rgb2yuv,
    "vf_format_yuv2rgb": _yuv2rgb,
    "vf_format_to420": _to420,
    "vf_format_rgba2rgb": _rgba,
    "vf_colorspec": _colorspec,
    "vf_dims": _dims,
    "vf_chain": _chain,
}

_P = f"with {_pix_sql()} "
SQL = {
    "vf_hflip": _P + f"select clip, frame_no, plane, y, {_PW} - 1 - x as x, v from pix",
    "vf_vflip": _P + f"select clip, frame_no, plane, {_PH} - 1 - y as y, x, v from pix",
    "vf_negate": _P + "select clip, frame_no, plane, y, x, 255 - v as v from pix",
    "vf_gray": _P + "select clip, frame_no, plane, y, x, case when plane > 0 then 128 else v end as v from pix",
    "vf_crop": _P + "select clip, frame_no, plane, y - 4 // k as y, x - 6 // k as x, v from (select *, case when plane = 0 then 1 else 2 end as k from pix)"
    " where x >= 6 // k and x < 22 // k and y >= 4 // k and y < 14 // k",
    "vf_pad": _P + ", big as (select clip, frame_no, plane, y, x from (select distinct clip, frame_no from pix),"
    " (select 0::bigint as plane, y, x from range(36) a(y), range(44) b(x) union all select p, y, x from range(1, 3) q(p), range(18) a(y), range(22) b(x)))"
    " select b.clip, b.frame_no, b.plane, b.y, b.x, coalesce(p.v, case when b.plane = 0 then 0 else 128 end) as v from big b left join pix p"
    " on p.clip = b.clip and p.frame_no = b.frame_no and p.plane = b.plane and p.y = b.y - (case when b.plane = 0 then 8 else 4 end) and p.x = b.x - (case when b.plane = 0 then 6 else 3 end)",
    "vf_transpose": _P + f"select d as direction, clip, frame_no, plane, case when d in (0, 1) then x else {_PW} - 1 - x end as y, case when d in (0, 2) then y else {_PH} - 1 - y end as x, v from pix, range(4) t(d)",
    "vf_scale": _scale_sql(20, 16),
    "vf_setrange": _P + "select target, clip, frame_no, plane, y, x, "
    + _byte("case when target = 'full' then cast((v::float - 16::float) * 255::float as float)::double / span else cast(v::float * span as float)::double / 255 + 16 end")
    + " as v from (select *, case when plane = 0 then 219::float else 224::float end as span from pix), (values ('full'), ('limited')) t(target)",
    "vf_overlay": _P.replace("pix as", "pix as", 1).rstrip() + f", small as (select * from (with {_pix_sql(8, 8)} select * from pix) where clip = 'B' and frame_no = 0)"
    " select p.clip, p.frame_no, p.plane, p.y, p.x, coalesce(s.v, p.v) as v from pix p left join small s on s.plane = p.plane"
    " and s.x = p.x - (case when p.plane = 0 then 26 else 13 end) and s.y = p.y - (case when p.plane = 0 then 4 else 2 end)",
    "vf_overlay_decode": f"with {_pix_sql(8, 8)} select clip, frame_no, plane, y, x, v from (select *, min(frame_no) over (partition by clip) as m from pix where frame_no > 0 or clip = 'A') where frame_no = m",
    "vf_format_rgb2yuv": _rgb2yuv_sql(),
    "vf_format_yuv2rgb": _yuv2rgb_sql(),
    "vf_format_to420": _to420_sql(),
    "vf_format_rgba2rgb": f"with {_RGB_SQL} select clip, frame_no, y, x, 0::bigint as ch, r as v from rgb union all select clip, frame_no, y, x, 1, g from rgb union all select clip, frame_no, y, x, 2, b from rgb",
    "vf_colorspec": _COLOR_SQL,
    "vf_dims": "select spec, width::bigint as width, height::bigint as height from (values ('scale=20:-1', 20, 16), ('scale=-1:17', 22, 17), ('crop=16:8:2:4,hflip', 16, 8), ('pad=40:40:4:4,transpose=1', 40, 40), ('transpose=2,vflip', 24, 32)) t(spec, width, height)",
    "vf_chain": _P + ", c as (select clip, frame_no, plane, y - 2 // k as y, (case when plane = 0 then 16 else 8 end) - 1 - (x - 4 // k) as x, 255 - v as v from (select *, case when plane = 0 then 1 else 2 end as k from pix)"
    " where x >= 4 // k and x < 20 // k and y >= 2 // k and y < 14 // k),"
    " big as (select clip, frame_no, plane, y, x from (select distinct clip, frame_no from pix),"
    " (select 0::bigint as plane, y, x from range(16) a(y), range(24) b(x) union all select p, y, x from range(1, 3) q(p), range(8) a(y), range(12) b(x)))"
    " select b.clip, b.frame_no, b.plane, b.x as y, (case when b.plane = 0 then 16 else 8 end) - 1 - b.y as x, coalesce(c.v, case when b.plane = 0 then 0 else 128 end) as v from big b left join c"
    " on c.clip = b.clip and c.frame_no = b.frame_no and c.plane = b.plane and c.y = b.y - (case when b.plane = 0 then 2 else 1 end) and c.x = b.x - (case when b.plane = 0 then 4 else 2 end)",
}
