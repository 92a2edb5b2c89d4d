"""SQL for DuckDB that states each query's result independently of the operators."""

from __future__ import annotations

from fractions import Fraction

Matrix = list[list[Fraction]]

# Published white points, primaries (red, green, blue) and the Bradford matrix, restated here so that the SQL rests on nothing it checks.
D50, D60, D65 = ("0.3457", "0.3585"), ("0.32168", "0.33767"), ("0.3127", "0.3290")
SRGB = (("0.64", "0.33"), ("0.30", "0.60"), ("0.15", "0.06"))
DISPLAY_P3 = (("0.680", "0.320"), ("0.265", "0.690"), ("0.150", "0.060"))
AP1 = (("0.713", "0.293"), ("0.165", "0.830"), ("0.128", "0.044"))
CONES = (("0.8951", "0.2664", "-0.1614"), ("-0.7502", "1.7135", "0.0367"), ("0.0389", "-0.0685", "1.0296"))
#: Primaries, white, then wx wy rx ry gx gy bx by of the spaces that files are matched to, in order.
FILE_SPACES = [
    ("Bt709", "D65", (0.3127, 0.3290, 0.640, 0.330, 0.300, 0.600, 0.150, 0.060)),
    ("Adobe1998", "D65", (0.3127, 0.3290, 0.640, 0.330, 0.210, 0.710, 0.150, 0.060)),
    ("P3", "D65", (0.3127, 0.3290, 0.680, 0.320, 0.265, 0.690, 0.150, 0.060)),
    ("Bt2020", "D65", (0.3127, 0.3290, 0.708, 0.292, 0.170, 0.797, 0.131, 0.046)),
    ("Ap0", "D60", (0.32168, 0.33767, 0.7347, 0.2653, 0.0, 1.0, 0.0001, -0.077)),
    ("Ap1", "D60", (0.32168, 0.33767, 0.713, 0.293, 0.165, 0.830, 0.128, 0.044)),
    ("ProPhoto", "D50", (0.3457, 0.3585, 0.7347, 0.2653, 0.1596, 0.8404, 0.0366, 0.0001)),
]


def exact(rows) -> Matrix:
    return [[Fraction(v) for v in row] for row in rows]


def times(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(x * y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)] for row in a]


def inverse(m: Matrix) -> Matrix:
    """By cofactors."""
    minor = lambda i, j: [[m[r][c] for c in range(3) if c != j] for r in range(3) if r != i]
    cofactor = [[(-1) ** (i + j) * (k[0][0] * k[1][1] - k[0][1] * k[1][0]) for j in range(3) for k in [minor(i, j)]] for i in range(3)]
    whole = sum(m[0][j] * cofactor[0][j] for j in range(3))
    return [[cofactor[j][i] / whole for j in range(3)] for i in range(3)]


def light(xy) -> Matrix:
    """The column of X, Y, Z of a chromaticity at luminance 1."""
    x, y = map(Fraction, xy)
    return [[x / y], [Fraction(1)], [(1 - x - y) / y]]


def to_xyz(primaries, white) -> Matrix:
    columns = [list(row) for row in zip(*([c[0] for c in light(p)] for p in primaries), strict=True)]
    scale = times(inverse(columns), light(white))
    return [[v * scale[j][0] for j, v in enumerate(row)] for row in columns]


def adapted(source, target) -> Matrix:
    cones = exact(CONES)
    gains = [t[0] / f[0] for t, f in zip(times(cones, light(target)), times(cones, light(source)), strict=True)]
    return times(inverse(cones), [[g * v for v in row] for g, row in zip(gains, cones, strict=True)])

A = """SELECT CAST(floor(o_orderkey/50e0) AS INT) AS y, CAST(o_orderkey % 50 AS INT) AS x,
 o_totalprice/524287e0 AS r, (o_custkey % 256)/255e0 AS g, CAST(substr(o_orderpriority,1,1) AS DOUBLE)/5e0 AS b,
 CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 0.5e0 ELSE 0e0 END AS a FROM orders"""
B = """SELECT CAST(floor(event_id/50e0) AS INT) AS y, CAST(event_id % 50 AS INT) AS x,
 least(value/613e0, 1e0) AS r, (user_id % 256)/255e0 AS g, length(event_type)/8e0 AS b,
 CASE event_type WHEN 'view' THEN 1e0 WHEN 'click' THEN 0.75e0 WHEN 'error' THEN 0e0 ELSE 0.5e0 END AS a FROM events"""
A8 = "SELECT CAST(floor(o_orderkey/50e0) AS INT) AS y, CAST(o_orderkey % 50 AS INT) AS x, CAST(o_custkey % 256 AS INT) AS v FROM orders"
VERSIONS = """SELECT CAST(user_id % 8 AS INT) AS tx, CAST(event_id % 4 AS INT) AS ty, event_id AS arrival,
 event_id - CASE event_type WHEN 'error' THEN 40 WHEN 'signup' THEN 12 ELSE 0 END AS version, value AS payload FROM events"""
EDITS = """SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'SetLayerOpacity' WHEN 'view' THEN 'SetLayerVisible'
 WHEN 'purchase' THEN 'SetLayerBlend' WHEN 'signup' THEN 'Redo' ELSE 'Undo' END AS action, CAST(user_id % 3 AS INT) AS layer_id, least(value/613e0, 1e0) AS arg FROM events"""
LATEST = f"SELECT * FROM ({VERSIONS}) QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY version DESC, arrival DESC) = 1"


def n(value: float) -> str:
    text = repr(float(value))
    return f"({text if 'e' in text else text + 'e0'})"


def q(expression: str) -> str:
    return f"floor(({expression})*1e6 + 0.5e0)/1e6"


def qs(columns: str) -> str:
    return ", ".join(f"{q(c)} AS {c}" for c in columns.split())


def power(x: str, e: float) -> str:
    return f"pow(greatest({x}, 0e0), {n(e)})"


def decoded(curve: str, x: str) -> str:
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    return {
        "srgb": f"CASE WHEN {x} <= 0.04045e0 THEN {x}/12.92e0 ELSE {power(f'({x}+0.055e0)/1.055e0', 2.4)} END",
        "rec709": f"CASE WHEN {x} < 0.081e0 THEN {x}/4.5e0 ELSE {power(f'({x}+0.099e0)/1.099e0', 1 / 0.45)} END",
        "gamma22": power(x, 2.2),
        "gamma24": power(x, 2.4),
        "gamma26": power(x, 2.6),
        "prophoto": f"CASE WHEN {x} <= 0.03125e0 THEN {x}/16e0 ELSE {power(x, 1.8)} END",
        "pq": power(f"greatest({power(x, 1 / m2)} - {n(c1)}, 0e0) / ({n(c2)} - {n(c3)} * {power(x, 1 / m2)})", 1 / m1),
        "hlg": f"CASE WHEN {x} <= 0.5e0 THEN {x}*{x}/3e0 ELSE (exp(({x} - 0.5599107e0)/0.17883277e0) + 0.28466892e0)/12e0 END",
    }[curve]


def encoded(curve: str, y: str) -> str:
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    return {
        "srgb": f"CASE WHEN {y} <= 0.0031308e0 THEN 12.92e0*{y} ELSE 1.055e0*{power(y, 1 / 2.4)} - 0.055e0 END",
        "rec709": f"CASE WHEN {y} < 0.018e0 THEN 4.5e0*{y} ELSE 1.099e0*{power(y, 0.45)} - 0.099e0 END",
        "gamma22": power(y, 1 / 2.2),
        "gamma24": power(y, 1 / 2.4),
        "gamma26": power(y, 1 / 2.6),
        "prophoto": f"CASE WHEN {y} <= 0.001953125e0 THEN 16e0*{y} ELSE {power(y, 1 / 1.8)} END",
        "pq": power(f"({n(c1)} + {n(c2)}*{power(y, m1)}) / (1e0 + {n(c3)}*{power(y, m1)})", m2),
        "hlg": f"CASE WHEN {y} <= {n(1 / 12)} THEN sqrt(3e0*greatest({y},0e0)) ELSE 0.17883277e0*ln(greatest(12e0*{y} - 0.28466892e0, 1e-12)) + 0.5599107e0 END",
    }[curve]


def curves(*names: str) -> str:
    made = ", ".join(f"{q(decoded(c, 'g'))} AS {c}_decoded, {q(encoded(c, 'g'))} AS {c}_encoded" for c in names)
    return f"SELECT y, x, {made} FROM ({A})"


def product(matrix, r: str, g: str, b: str) -> list[str]:
    return [f"{n(m[0])}*{r} + {n(m[1])}*{g} + {n(m[2])}*{b}" for m in matrix]


def three(source: str, made: list[str]) -> str:
    return f"SELECT y, x, {', '.join(f'{q(e)} AS {c}' for e, c in zip(made, 'rgb', strict=True))} FROM ({source})"


def over(bottom: str, top: str, opacity: float, mode: str = "Normal") -> str:
    """SELECT list of two joined pixels blended."""
    at, ab = f"({top}.a*{n(opacity)})", f"{bottom}.a"
    out = f"({at} + {ab}*(1e0-{at}))"
    cells = []
    for c in "rgb":
        s, d = f"{top}.{c}", f"{bottom}.{c}"
        if mode == "Normal":
            mixed = f"{s}*{at} + {d}*{ab}*(1e0-{at})"
        else:
            mixed = f"(1e0-{ab})*{s}*{at} + (1e0-{at})*{d}*{ab} + {at}*{ab}*({d}*{s})"
        cells.append(f"CASE WHEN {out} <= 0 THEN 0e0 ELSE ({mixed})/{out} END AS {c}")
    return ", ".join(cells) + f", {out} AS a"


def blur(source: str, radius: int, columns: str) -> str:
    frame = f"RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    means = lambda by, order: ", ".join(f"avg({c}) OVER (PARTITION BY {by} ORDER BY {order} {frame}) AS {c}" for c in columns.split())
    return f"SELECT y, x, {means('x', 'y')} FROM (SELECT y, x, {means('y', 'x')} FROM ({source}))"


def halved(source: str, width: str, height: str, columns: str, whole: bool = False) -> str:
    mean = (lambda c: f"CAST(floor(avg({c})) AS INT) AS {c}") if whole else (lambda c: f"avg({c}) AS {c}")
    return f"""SELECT * FROM (SELECT CAST(floor(y/2e0) AS INT) AS y, CAST(floor(x/2e0) AS INT) AS x, {', '.join(mean(c) for c in columns.split())}
 FROM ({source}) GROUP BY 1, 2) WHERE x < greatest(CAST(floor({width}/2e0) AS INT), 1) AND y < greatest(CAST(floor({height}/2e0) AS INT), 1)"""


HEIGHT = "(SELECT CAST(ceil(count(*)/50e0) AS INT) FROM orders)"


def pyramid(columns: str, levels: int = 24, tile: int = 128) -> str:
    """Levels 1 and on while the level before doesn't fit a tile, each from the one before."""
    parts = [f"WITH RECURSIVE l0 AS (SELECT y, x, {', '.join(columns.split())} FROM ({A}))", f"h AS (SELECT {HEIGHT} AS h)"]
    union = [f"SELECT y, x, {columns.replace(' ', ', ')}, 0 AS mip FROM l0"]
    for m in range(1, levels):
        w = f"greatest(CAST(floor(50/pow(2e0, {m - 1})) AS INT), 1)"
        hh = f"(SELECT greatest(CAST(floor(h/pow(2e0, {m - 1})) AS INT), 1) FROM h)"
        need = "" if m == 1 else f" AND ({w} > {tile} OR {hh} > {tile})"
        parts.append(f"l{m} AS ({halved(f'l{m - 1}', w, hh, columns).replace(f'(l{m - 1})', f'l{m - 1}')}{need})")
        union.append(f"SELECT y, x, {columns.replace(' ', ', ')}, {m} AS mip FROM l{m}")
    return ", ".join(parts) + f" SELECT y, x, mip, {qs(columns)} FROM ({' UNION ALL '.join(union)})"


def tile_ranges(padding: int, lookahead: float, level: str = "k%4", lead: str = "event_id", where: str = "true") -> str:
    cells = []
    for axis, pan, view, whole, vel in (("x", "(k*37%3000) - 500e0", "800e0", "4000e0", "(k%400) - 200e0"), ("y", "(k*53%2000) - 300e0", "600e0", "3000e0", "(k%300) - 150e0")):
        p = f"(({pan}) - ({vel})*{n(lookahead)})"
        low, high = f"greatest({p}, 0e0)", f"greatest(least({p} + {view}/pow(2e0, -(k%6)), {whole}), 0e0)"
        scale = f"pow(2e0, {level})"
        cells.append(f"CAST(greatest(floor({low}/{scale}/256e0) - {padding}, 0) AS INT) AS t{axis}0")
        cells.append(f"CAST(least(ceil({high}/{scale}/256e0) + {padding}, ceil(floor({whole}/{scale})/256e0)) AS INT) AS t{axis}1")
    return f"SELECT {lead}, {', '.join(cells)} FROM (SELECT event_id, event_id AS k FROM events) WHERE {where}"


def prefetch_plan() -> str:
    fast = "(((k%400) - 200e0)*((k%400) - 200e0) + ((k%300) - 150e0)*((k%300) - 150e0)) > 2500e0"
    target = "(CASE WHEN k%3 = 2 THEN greatest(k%4 - 1, 0) ELSE least(k%4 + 1, 3) END)"
    pan = tile_ranges(2, 0.25, "k%4", "event_id, 'pan' AS reason, CAST(k%4 AS INT) AS mip", f"k%10 < 5 AND {fast}")
    zoom = tile_ranges(4, 0.0, target, f"event_id, 'zoom' AS reason, CAST({target} AS INT) AS mip", f"k%10 < 5 AND k%3 <> 1 AND {target} <> k%4")
    return f"{pan} UNION ALL {zoom}"


def pixel_formats() -> dict[str, str]:
    """SQL of pack_ and unpack_ for each format."""
    out = {}
    wide = {c: f"({c}*1.25e0 - 0.125e0)" for c in "rgba"}
    unit = lambda e: f"least(greatest({e}, 0e0), 1e0)"
    gray = f"({wide['r']}*0.2126e0 + {wide['g']}*0.7152e0 + {wide['b']}*0.0722e0)"
    for model, bits, top, half in (("gray", 8, 255, 128), ("graya", 8, 255, 128), ("rgb", 16, 65535, 32768), ("rgba", 8, 255, 128), ("ycbcr", 8, 255, 128), ("lab", 8, 255, 128), ("lab", 16, 65535, 32768), ("cmyk", 8, 255, 128), ("cmyk", 16, 65535, 32768), ("cmyka", 8, 255, 128)):
        full = lambda e, top=top: f"CAST(floor({unit(e)}*{top}e0 + 0.5e0) AS BIGINT)"
        side = lambda e, top=top, half=half: f"CAST(least(floor(least(greatest({e}, -1e0), 1e0)*{half}e0 + {half}e0 + 0.5e0), {top}) AS BIGINT)"
        samples = {
            "gray": [full(gray)], "graya": [full(gray), full(wide["a"])], "rgb": [full(wide[c]) for c in "rgb"], "rgba": [full(wide[c]) for c in "rgba"], "ycbcr": [full(wide[c]) for c in "rgb"],
            "lab": [full(wide["r"]), side(wide["g"]), side(wide["b"])], "cmyk": [f"CAST(floor(least(greatest({wide[c]}*255e0, 0e0), {top}e0) + 0.5e0) AS BIGINT)" for c in "rgba"],
            "cmyka": [*(full(wide[c]) for c in "rgba"), f"CAST({top} AS BIGINT)"],
        }[model]
        out[f"pack_{model}{bits}"] = f"SELECT y, x, {', '.join(f'{e} AS s{i}' for i, e in enumerate(samples))} FROM ({A})"
        v = [f"((CAST(v AS BIGINT)*{1 if bits == 8 else 257}*{2 * i + 1} + {31 * i}) % {top + 1})" for i in range(len(samples))]
        share, centred = [f"{e}/{top}e0" for e in v], [f"({e} - {half}e0)/{half}e0" for e in v]
        channels = {
            "gray": [share[0]] * 3 + ["1e0"], "graya": [share[0]] * 3 + share[1:], "rgb": [*share, "1e0"], "rgba": share, "ycbcr": [*share, "1e0"],
            "lab": [share[0], *centred[1:], "1e0"], "cmyk": share, "cmyka": share[:4],
        }[model]
        out[f"unpack_{model}{bits}"] = f"SELECT y, x, {', '.join(f'{q(e)} AS {c}' for e, c in zip(channels, 'rgba', strict=True))} FROM ({A8})"
    alpha = "CASE WHEN a > 1e-6 THEN {} ELSE 0e0 END"
    out["unpack_float"] = f"SELECT y, x, {', '.join(f'{q(alpha.format(e))} AS {c}' for c, e in zip('rgba', ('r/a', 'g/a', 'b/a', 'a'), strict=True))} FROM ({A})"
    return out


BLENDS = {
    "multiply": "s*t",
    "screen": "1e0-(1e0-s)*(1e0-t)",
    "overlay": "CASE WHEN s < 0.5e0 THEN 2e0*s*t ELSE 1e0-2e0*(1e0-s)*(1e0-t) END",
    "hardlight": "CASE WHEN t < 0.5e0 THEN 2e0*s*t ELSE 1e0-2e0*(1e0-s)*(1e0-t) END",
    "softlight": "(1e0-2e0*t)*s*s + 2e0*t*s",
    "colordodge": "CASE WHEN t >= 1 THEN 1e0 ELSE least(1e0, s/greatest(1e0-t, 1e-12)) END",
    "colorburn": "CASE WHEN t <= 0 THEN 0e0 ELSE 1e0 - least(1e0, (1e0-s)/greatest(t, 1e-12)) END",
    "difference": "abs(s-t)",
    "exclusion": "s + t - 2e0*s*t",
}


def more() -> dict[str, str]:
    """Files, previews, cameras and layers that read other layers."""
    whole = f"SELECT y, x, {', '.join(f'CAST(floor(least(greatest({c},0e0),1e0)*255e0 + 0.5e0) AS INT) AS {c}' for c in 'rgba')} FROM ({A})"
    files = f"""WITH p AS ({whole}), s AS (SELECT y // 512 AS s, max(y) AS last, max(x) AS side FROM p GROUP BY 1),
 g AS (SELECT CAST(s*512 + dy AS INT) AS y, CAST(dx AS INT) AS x FROM s, range(512) AS a(dy), range(50) AS b(dx) WHERE s*512 + dy <= last AND dx <= side)
 SELECT y, x, {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'rgba')} FROM g LEFT JOIN p USING (y, x)"""
    writes = f"SELECT *, CAST(arrival % 3 AS INT) AS mip, CASE WHEN arrival % 4 = 3 THEN arrival % 3 + 7 ELSE 0 END AS generation FROM ({VERSIONS})"
    shown = f"""WITH w AS ({writes}), b AS (SELECT * FROM w WHERE generation = 0 QUALIFY row_number() OVER (PARTITION BY mip, tx, ty ORDER BY version DESC, arrival DESC) = 1),
 o AS (SELECT * FROM w WHERE generation = 8 QUALIFY row_number() OVER (PARTITION BY mip, tx, ty ORDER BY arrival DESC) = 1)
 SELECT mip, tx, ty, {q('coalesce(o.payload, b.payload)')} AS payload FROM b FULL JOIN o USING (mip, tx, ty)"""
    views = "SELECT event_id, event_id AS k, (event_id*37%3000) - 500e0 AS pan_x, (event_id*53%2000) - 300e0 AS pan_y, pow(2e0, -(event_id%6)) AS zoom FROM events"
    closer = "greatest(least(zoom*pow(2e0, k%25 - 12), 64e0), 0.04e0)"
    layers = f"a AS ({A}), b AS ({B})"
    brighter = f"t AS (SELECT y, x, {', '.join(f'{c}*{n(2**0.5)} AS {c}' for c in 'rgb')}, a FROM a)"
    darker = f"u AS (SELECT y, x, {', '.join(f'{c}*0.5e0 AS {c}' for c in 'rgb')}, a FROM (SELECT y, x, {', '.join(f'{c}*0.5e0 AS {c}' for c in 'rgb')}, a FROM b))"
    return {
        "png_round_trip": files,
        "tiff_round_trip": files,
        "file_space": "SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'linear_srgb' WHEN 3 THEN 'Bt709/D65/gamma22' ELSE 'srgb' END AS space, 1 AS width, 1 AS height, 3 AS channels FROM events",
        "overlay_generation": shown,
        "pending_tiles": f"SELECT DISTINCT tx, ty FROM ({writes}) WHERE generation = 0 AND payload > 100 AND mip = 1 AND arrival > 500",
        "camera_fit": f"SELECT event_id, {q('(4000e0 - 800e0/0.19e0)/2e0')} AS pan_x, {q('(3000e0 - 600e0/0.19e0)/2e0')} AS pan_y, {q('0.2e0*0.95e0')} AS zoom FROM events",
        "camera_pan": f"SELECT event_id, {q('pan_x - ((k%400) - 200e0)/zoom')} AS pan_x, {q('pan_y - ((k%300) - 150e0)/zoom')} AS pan_y FROM ({views})",
        "camera_zoom": f"SELECT event_id, {q('pan_x + 400e0/zoom - 400e0/z')} AS pan_x, {q('pan_y + 150e0/zoom - 150e0/z')} AS pan_y, {q('z')} AS zoom FROM (SELECT *, {closer} AS z FROM ({views}))",
        "solid_colour": f"SELECT y, x, 0.25e0 AS r, 0.5e0 AS g, 0.75e0 AS b, 1e0 AS a FROM ({A8})",
        "render_upto": f"WITH {layers}, m AS (SELECT a.y, a.x, {over('a', 'b', 0.7)} FROM a JOIN b USING (y, x)) SELECT y, x, {qs('r g b a')} FROM m",
        "render_below": f"""WITH {layers}, {brighter}, {darker}, m AS (SELECT a.y, a.x, {over('a', 't', 0.7)} FROM a JOIN t USING (y, x)),
 f AS (SELECT m.y, m.x, {over('m', 'u', 0.4)} FROM m JOIN u USING (y, x)) SELECT y, x, {qs('r g b a')} FROM f""",
    }


def all_sql() -> dict[str, str]:
    srgb_to_p3 = product(times(inverse(to_xyz(DISPLAY_P3, D65)), to_xyz(SRGB, D65)), "r", "g", "b")
    cube = lambda f: f"CASE WHEN ({f}) > {n(6 / 29)} THEN ({f})*({f})*({f}) ELSE {n(3 * (6 / 29) ** 2)}*(({f}) - {n(4 / 29)}) END"
    fy = "((g*100e0 + 16e0)/116e0)"
    lab = [f"({cube(f)})*{n(w)}" for f, w in zip((f"({fy} + (b-0.5e0)*128e0/500e0)", fy, f"({fy} - (a-0.5e0)*128e0/200e0)"), (v[0] for v in light(D50)), strict=True)]
    lut = lambda i: encoded("srgb", f"({i}/4095e0)")
    at = "(least(greatest(r,0e0),1e0)*4095e0)"
    low, high = f"floor({at})", f"least(floor({at})+1e0, 4095e0)"
    boxes = " ".join(f"WHEN {' AND '.join(f'abs({c} - {n(v)}) < 0.002e0' for c, v in zip(('wx', 'wy', 'rx', 'ry', 'gx', 'gy', 'bx', '"by"'), values, strict=True))} THEN {i}" for i, (_, _, values) in enumerate(FILE_SPACES))
    chroma = " UNION ALL ".join(f"SELECT {i} AS i, '{p}' AS p, '{w}' AS w, " + ", ".join(f"{n(v)} AS {c}" for c, v in zip(("wx", "wy", "rx", "ry", "gx", "gy", "bx", '"by"'), values, strict=True)) for i, (p, w, values) in enumerate(FILE_SPACES))
    names = ("wx", "wy", "rx", "ry", "gx", "gy", "bx", '"by"')
    tiled = f"SELECT *, CAST(floor(y/16e0) AS INT) AS ty, CAST(floor(x/16e0) AS INT) AS tx FROM ({A8})"
    grid = lambda m: f"SELECT {m} AS mip, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty FROM range(CAST(ceil(greatest(50 >> {m}, 1)/16e0) AS BIGINT)) AS a(tx), range(CAST(ceil(greatest({HEIGHT} >> {m}, 1)/16e0) AS BIGINT)) AS b(ty)"
    third = f"SELECT y, x, b AS r, r AS g, g AS b, a*0.5e0 AS a FROM ({A})"
    return {
        "scan_raster": f"SELECT y, x, {qs('r g b a')} FROM ({A})",
        "scan_signed": f"SELECT CAST(vec_id AS INT) AS y, CAST(pos AS INT) AS x, {q('CAST(v AS DOUBLE)')} AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)",
        "cache_range_scan": f"SELECT * FROM (SELECT y, x, CAST(floor(x/16e0) AS INT) AS tx, CAST(floor(y/16e0) AS INT) AS ty, {q('r')} AS r FROM ({A})) WHERE tx BETWEEN 1 AND 2 AND ty BETWEEN 0 AND 1",
        "normalize_int": f"SELECT y, x, {q('v/255e0')} AS u8, {q('v*257/65535e0')} AS u16, {q('CAST(v AS DOUBLE)*16843009e0/4294967295e0')} AS u32, {q('(v-128+128e0)/255e0')} AS i8, {q('((v-128)*256 + 32768e0)/65535e0')} AS i16, {q('(v-128)*16777216e0/2147483647e0*0.5e0 + 0.5e0')} AS i32, {q('(v-128)*36028797018963968e0/9223372036854775807e0*0.5e0 + 0.5e0')} AS i64 FROM ({A8})",
        "to_tiles": f"SELECT ty, tx, tx*16 AS px, ty*16 AS py, CAST(max(x)-min(x)+1 AS INT) AS width, CAST(max(y)-min(y)+1 AS INT) AS height, string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS samples FROM ({tiled}) GROUP BY ty, tx",
        "to_scanlines": f"SELECT y, string_agg(CAST(coalesce(v, 0) AS VARCHAR), ',' ORDER BY x) AS samples FROM (SELECT l.y, CAST(c.x AS INT) AS x FROM (SELECT DISTINCT y FROM ({A8})) l, range(50) AS c(x)) g LEFT JOIN ({A8}) p USING (y, x) GROUP BY y",
        "tile_round_trip": A8,
        "tile_len_check": f"SELECT ty, tx, count(*) = (max(x)-min(x)+1)*(max(y)-min(y)+1) AS ok FROM ({tiled}) GROUP BY ty, tx",
        "tile_coords": " UNION ALL ".join(f"SELECT mip, tx, ty, tx*16 AS px, ty*16 AS py, CAST(greatest(least(greatest(50 >> {m},1) - tx*16, 16), 0) AS INT) AS width, CAST(greatest(least(greatest({HEIGHT} >> {m},1) - ty*16, 16), 0) AS INT) AS height FROM ({grid(m)})" for m in (0, 1, 2)),
        "tile_grid": grid(1),
        "halo_join": f"""WITH t AS (SELECT ty, tx, sum(v) AS total FROM ({tiled}) GROUP BY ty, tx), m AS (SELECT max(ty) AS my, max(tx) AS mx FROM t)
 SELECT c.ty, c.tx, CAST(sum(s.total) AS BIGINT) AS around, count(*) AS tiles FROM t c, m, range(-1, 2) AS a(dy), range(-1, 2) AS b(dx)
 JOIN t s ON s.ty = least(greatest(c.ty + dy, 0), my) AND s.tx = least(greatest(c.tx + dx, 0), mx) GROUP BY c.ty, c.tx""",
        "raster_extent": f"SELECT CAST(max(x)+1 AS INT) AS width, CAST(max(y)+1 AS INT) AS height FROM ({A8})",
        "assemble_raster": f"SELECT y, string_agg(printf('%02X', v), '' ORDER BY x) AS line FROM ({A8}) GROUP BY y",
        "mip_filter": f"SELECT y, x, {qs('r')} FROM ({halved(A, '50', HEIGHT, 'r')})",
        "visible_layers": "SELECT CAST(i AS INT) AS layer_id, 'layer ' || i AS name FROM range(8) AS l(i) WHERE i % 3 <> 1 AND i IN (SELECT user_id % 8 FROM events)",
        "png_text_map": "SELECT event_id, CASE lower(key) WHEN 'author' THEN 'Artist' WHEN 'artist' THEN 'Artist' WHEN 'title' THEN 'Description' WHEN 'description' THEN 'Description' WHEN 'copyright' THEN 'Copyright' WHEN 'software' THEN 'Software' ELSE 'Custom' END AS field, key, value FROM (SELECT event_id, ['Author','artist','TITLE','Description','Copyright','software','Comment'][event_id % 7 + 1] AS key, event_type AS value FROM events)",
        "exif_rational": "SELECT o_orderkey, o_custkey || '/' || (o_orderkey % 7) AS text, CASE WHEN o_orderkey % 7 <> 0 THEN printf('%.6f', CAST(o_custkey AS DOUBLE)/CAST(o_orderkey % 7 AS DOUBLE)) END AS value FROM orders",
        "detect_space": "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'rec2020' WHEN event_id % 7 = 0 THEN 'display_p3' WHEN event_id % 5 = 0 THEN 'srgb' WHEN event_id % 3 = 0 THEN 'adobe_rgb' WHEN event_id % 2 = 0 THEN 'gamma22' ELSE 'srgb' END AS space FROM events",
        "match_chroma": f"WITH k AS ({chroma}), f AS (SELECT event_id, {', '.join(f'{c} + (event_id % 5)*0.0006e0 AS {c}' for c in names)} FROM events JOIN k ON k.i = event_id % 7), m AS (SELECT event_id, CASE {boxes} END AS hit FROM f) SELECT event_id, p AS primaries, w AS white FROM m LEFT JOIN k ON k.i = m.hit",
        "icc_name_norm": r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS name FROM documents",
        "tf_srgb": curves("srgb"),
        "tf_rec709": curves("rec709"),
        "tf_gamma": curves("gamma22", "gamma24", "gamma26"),
        "tf_prophoto": curves("prophoto"),
        "tf_pq": curves("pq"),
        "tf_hlg": curves("hlg"),
        "gamma_lookup": f"SELECT event_id, CASE WHEN abs(g-{n(1 / 2.2)}) < 0.01e0 THEN 'gamma22' WHEN abs(g-{n(1 / 2.4)}) < 0.01e0 THEN 'gamma24' WHEN abs(g-{n(1 / 2.2)}) < 0.05e0 THEN 'gamma22' WHEN abs(g-1e0) < 0.01e0 THEN 'linear' END AS curve FROM (SELECT event_id, (event_id % 120)/100e0 AS g FROM events)",
        "color_convert": "SELECT y, x, " + ", ".join(f"{q(encoded('srgb', f'(({e})*a)'))} AS {c}" for e, c in zip(srgb_to_p3, "rgb", strict=True)) + f", {q('a')} AS a FROM (SELECT y, x, {', '.join(f'{decoded("srgb", c)} AS {c}' for c in 'rgb')}, a FROM ({A}))",
        "matrix_apply": three(A, product(times(inverse(to_xyz(AP1, D60)), times(adapted(D65, D60), to_xyz(SRGB, D65))), "r", "g", "b")),
        "cmyk_to_rgb": three(A, [f"(1e0-{c})*(1e0-a)" for c in "rgb"]),
        "ycbcr_to_rgb": three(A, ["r + 1.402e0*(b-0.5e0)", "r - 0.344136e0*(g-0.5e0) - 0.714136e0*(b-0.5e0)", "r + 1.772e0*(g-0.5e0)"]),
        "lab_to_rgb": three(A, product(times(inverse(to_xyz(SRGB, D65)), adapted(D50, D65)), *(f"({e})" for e in lab))),
        "lab_unpack": three(A8, ["v/255e0", "(255-v-128)/128e0", "((v*7)%256-128)/128e0"]),
        "premultiply": f"SELECT y, x, {q('r*a')} AS pre, {q('r*a/greatest(a, 1e-8)')} AS back FROM ({A})",
        "encode_lut": f"SELECT y, x, {q(f'({lut(low)}) + (({lut(high)}) - ({lut(low)}))*({at} - {low})')} AS r FROM ({A})",
        "decode_lut": f"SELECT y, x, {q(decoded('srgb', 'e'))} AS v FROM (SELECT y, x, v/255e0 AS e FROM ({A8}))",
        "xyz_xyy": f"SELECT y, x, {qs('cx cy')}, {q('CASE WHEN cy = 0 THEN 0e0 ELSE cx*g/cy END')} AS bx, {q('CASE WHEN cy = 0 THEN 0e0 ELSE g END')} AS by, {q('CASE WHEN cy = 0 THEN 0e0 ELSE (1e0-cx-cy)*g/cy END')} AS bz FROM (SELECT y, x, g, CASE WHEN r+g+b = 0 THEN 0e0 ELSE r/(r+g+b) END AS cx, CASE WHEN r+g+b = 0 THEN 0e0 ELSE g/(r+g+b) END AS cy FROM ({A}))",
        "luma": f"SELECT y, x, {q('0.2126e0*r + 0.7152e0*g + 0.0722e0*b')} AS luma FROM ({A})",
        "quantize_u8": f"SELECT y, x, {', '.join(f'CAST(floor(least(greatest({c},0e0),1e0)*255e0 + 0.5e0) AS INT) AS {c}' for c in 'rgba')} FROM ({A})",
        "quantize_u16": f"SELECT y, x, {', '.join(f'CAST(floor(least(greatest({c},0e0),1e0)*65535e0 + 0.5e0) AS INT) AS {c}' for c in 'rgba')} FROM ({A})",
        "exposure": f"SELECT y, x, {q(f'r*{n(2**1.5)}')} AS r FROM ({A})",
        "compose_join": f"SELECT y, x, {q('l.r')} AS bottom, {q('t.r')} AS top FROM ({A}) l JOIN ({B}) t USING (y, x)",
        "compose_over": f"SELECT y, x, {qs('r g b a')} FROM (SELECT l.y, l.x, {over('l', 't', 0.7)} FROM ({A}) l JOIN ({B}) t USING (y, x))",
        "compose_three": f"WITH m AS (SELECT l.y, l.x, {over('l', 't', 0.7, 'Multiply')} FROM ({A}) l JOIN ({B}) t USING (y, x)) SELECT y, x, {qs('r g b a')} FROM (SELECT m.y, m.x, {over('m', 'u', 0.4)} FROM m JOIN ({third}) u USING (y, x))",
        "compose_source": f"SELECT y, x, {', '.join(f'{q("t." + c)} AS {c}' for c in 'rgba')} FROM ({A}) l JOIN ({B}) t USING (y, x)",
        "blend_modes": "SELECT y, x, " + ", ".join(f"{q(e)} AS {m}" for m, e in BLENDS.items()) + f" FROM (SELECT y, x, least(l.r, 1e0) AS s, u.r AS t FROM ({A}) l JOIN ({B}) u USING (y, x))",
        "overlay_base": f"WITH w AS ({LATEST}) SELECT tx, ty, {q('CASE WHEN tx > 3 THEN payload*2 ELSE payload END')} AS payload FROM w",
        "missing_tiles": "SELECT CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty FROM range(10) AS a(tx), range(5) AS b(ty) WHERE (tx, ty) NOT IN (SELECT user_id % 8, event_id % 4 FROM events)",
        "palette_lookup": f"SELECT y, x, CAST(i*3%256 AS INT) AS r, CAST(i*5%256 AS INT) AS g, CAST(i*7%256 AS INT) AS b FROM (SELECT y, x, least(greatest(v, 0), 199) AS i FROM ({A8}))",
        "union_layers": f"SELECT 0 AS port, count(*) AS n, {q('max(r)')} AS r FROM ({A}) UNION ALL SELECT 1, count(*), {q('max(r)')} FROM ({B})",
        "mip_1": f"SELECT y, x, {qs('r g b a')} FROM ({halved(A, '50', HEIGHT, 'r g b a')})",
        "mip_u8": halved(A8, "50", HEIGHT, "v", whole=True),
        "mip_pyramid": pyramid("r a"),
        "max_mip": "SELECT o_orderkey, CAST(CASE WHEN m <= 256 THEN 0 ELSE least(floor(log2(m/256e0)), 8) END AS INT) AS max_mip FROM (SELECT o_orderkey, greatest(o_custkey*7+1, o_orderkey+1) AS m FROM orders)",
        "thumbnail_mip": "SELECT o_orderkey, CAST(min(k) AS INT) AS mip FROM (SELECT o_orderkey, greatest(o_custkey*7+1, o_orderkey+1) AS m FROM orders), range(32) AS r(k) WHERE floor(m/pow(2e0, k)) <= 512 GROUP BY o_orderkey",
        "box_blur": f"SELECT y, x, {qs('r g b a')} FROM ({blur(A, 3, 'r g b a')})",
        "box_blur_wide": f"SELECT y, x, {qs('r')} FROM ({blur(A, 16, 'r')})",
        "histogram": f"SELECT CAST(least(greatest(floor(r*256), 0), 255) AS INT) AS bin, count(*) AS n FROM ({A}) GROUP BY 1",
        "latest_version": f"SELECT tx, ty, version, arrival, {q('payload')} AS payload FROM ({LATEST})",
        "lru_survivors": "SELECT key, pool, CAST(held AS BIGINT) AS held FROM (SELECT key, pool, sum(size) OVER (PARTITION BY pool ORDER BY used DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM (SELECT event_id AS key, event_id*7919%100003 AS used, length(event_type)*100 AS size, CASE WHEN user_id % 5 = 0 THEN 'full' ELSE 'small' END AS pool FROM events)) WHERE held <= 100000",
        "undo_redo": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM ({EDITS})),
 s AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS past, CAST(0 AS BIGINT) AS cur FROM (SELECT DISTINCT doc_id FROM e)
  UNION ALL SELECT s.doc_id, e.i, CASE WHEN action IN ('Undo','Redo') THEN past ELSE list_append(list_slice(past, 1, cur), seq) END,
   CASE action WHEN 'Undo' THEN greatest(cur-1, 0) WHEN 'Redo' THEN least(cur+1, len(past)) ELSE cur+1 END FROM s JOIN e ON e.doc_id = s.doc_id AND e.i = s.i + 1)
 SELECT doc_id, unnest(list_slice(past, 1, cur)) AS seq FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)""",
        "replay_scalar": f"SELECT doc_id, layer_id, action, {q('arg')} AS arg, seq FROM (SELECT * FROM ({EDITS}) WHERE action NOT IN ('Undo','Redo') QUALIFY row_number() OVER (PARTITION BY doc_id, layer_id, action ORDER BY seq DESC) = 1)",
        "ema": f"""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 0e0 AS v FROM e UNION ALL SELECT e.user_id, e.i, 0.7e0*value + 0.30000000000000004e0*v FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
 SELECT user_id, {q('v')} AS ema FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
        "visible_mip": "SELECT event_id, CAST(CASE WHEN z >= 0.5e0 THEN 0 ELSE least(-floor(log2(z)) - 1, 4) END AS INT) AS mip FROM (SELECT event_id, (event_id % 997 + 1)/997e0 AS z FROM events)",
        "viewport_tiles": tile_ranges(1, 0.0),
        "prefetch_tiles": tile_ranges(2, 0.25),
        "prefetch_plan": prefetch_plan(),
        "texture_mip": "SELECT o_orderkey, CAST(CASE WHEN m <= 64 THEN 0 ELSE least(ceil(log2(m/64e0)), 6) END AS INT) AS mip FROM (SELECT o_orderkey, o_custkey*7+1 AS m FROM orders)",
        **pixel_formats(),
        **more(),
        "empty_canvas": f"SELECT y, x, 0e0 AS r, 0e0 AS g, 0e0 AS b, 0e0 AS a FROM ({A8})",
        "render_document": f"WITH l AS ({blur(A, 3, 'r g b a')}), t AS (SELECT y, x, {', '.join(f'{c}*{n(2**0.5)} AS {c}' for c in 'rgb')}, a FROM ({B})), m AS (SELECT l.y, l.x, {over('l', 't', 0.7)} FROM l JOIN t USING (y, x)) SELECT y, x, {', '.join(f'{q(encoded("srgb", c))} AS {c}' for c in 'rgb')}, {q('a')} AS a FROM m",
    }
