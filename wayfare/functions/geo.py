"""Geofences and approximate cells on the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8  # mean radius


def has_fix(lat: str = "loc_lat", lon: str = "loc_lon") -> Column:
    """(0, 0) stands for no fix."""
    return (F.col(lat) != 0) | (F.col(lon) != 0)


def distance_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance by the haversine formula."""
    p, q = F.sin(F.radians(lat - lat0) / 2), F.sin(F.radians(lon - lon0) / 2)
    h = p * p + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * q * q
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within_circle(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float) -> Column:
    return distance_m(lat, lon, lat0, lon0) <= radius_km * 1000


def within_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a ray to the east crosses an odd number of the edges of the ring of (lat, lon)."""
    if len(ring) < 3:
        raise ValueError("a polygon has at least three corners")
    crossings = []
    for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if a != c:
            crossings.append(F.when(((lat < a) != (lat < c)) & (lon < (lat - a) * ((d - b) / (c - a)) + b), 1).otherwise(0))
    return reduce(lambda x, y: x + y, crossings) % 2 == 1


#: Fixed values of the public hexagonal grid H3, in radians: latitude and longitude of the middle of each face of its
#: icosahedron, and the azimuth of the face's first axis.
FACES = [
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882), (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055), (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400), (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874), (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154), (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562), (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361), (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535), (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316), (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436), (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
]
#: The length of a resolution-0 step on the plane of a face, and the turn of the odd resolutions.
STEP, TURN = 0.38196601125010500003, 0.333473172251832115336


def _snapped(point: Column, resolution: int) -> Column:
    """The middle of the cell that holds the point (lat, lon in radians), by the lattice of the nearest face."""
    lat, lon = point["lat"], point["lon"]
    scale = 7 ** (resolution / 2) / STEP
    turn = TURN if resolution % 2 else 0.0
    lit = lambda **v: F.struct(*[F.lit(x).alias(k) for k, x in v.items()])
    faces = F.array(*[lit(x=math.cos(a) * math.cos(b), y=math.cos(a) * math.sin(b), z=math.sin(a), lat=a, lon=b, axis=c) for a, b, c in FACES])

    def near(f: Column) -> Column:
        dot = F.cos(lat) * F.cos(lon) * f["x"] + F.cos(lat) * F.sin(lon) * f["y"] + F.sin(lat) * f["z"]
        return F.struct(dot.alias("dot"), f["lat"].alias("lat"), f["lon"].alias("lon"), f["axis"].alias("axis"))

    def on_plane(f: Column) -> Column:
        azimuth = F.atan2(F.cos(lat) * F.sin(lon - f["lon"]), F.cos(f["lat"]) * F.sin(lat) - F.sin(f["lat"]) * F.cos(lat) * F.cos(lon - f["lon"]))
        far = F.sqrt(F.greatest(F.lit(0.0), 1 / (f["dot"] * f["dot"]) - 1)) * scale  # the tangent of the angle
        angle = f["axis"] - azimuth - turn
        j = far * F.sin(angle) / (math.sqrt(3) / 2)
        return F.struct(f.alias("f"), (far * F.cos(angle) + j / 2).alias("i"), j.alias("j"))

    def corner(p: Column) -> Column:
        """Of the four lattice points around, the nearest: axes at 120 degrees."""
        tried = []
        for a in (0, 1):
            for b in (0, 1):
                i, j = F.floor(p["i"]) + a, F.floor(p["j"]) + b
                di, dj = p["i"] - i, p["j"] - j
                tried.append(F.struct((di * di - di * dj + dj * dj).alias("d"), i.alias("i"), j.alias("j")))
        best = F.array_min(F.array(*tried))
        return F.struct(p["f"].alias("f"), (best["i"] - best["j"] / 2).alias("x"), (best["j"] * (math.sqrt(3) / 2)).alias("y"))

    def back(p: Column) -> Column:
        f = p["f"]
        angle, azimuth = F.atan(F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]) / scale), f["axis"] - F.atan2(p["y"], p["x"]) - turn
        to = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(f["lat"]) * F.cos(angle) + F.cos(f["lat"]) * F.sin(angle) * F.cos(azimuth))))
        return F.struct(to.alias("lat"), (f["lon"] + F.atan2(F.sin(azimuth) * F.sin(angle) * F.cos(f["lat"]), F.cos(angle) - F.sin(f["lat"]) * F.sin(to))).alias("lon"))

    out = F.array(F.array_max(F.transform(faces, near)))
    for step in (on_plane, corner, back):
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def approximate(lat: Column, lon: Column, resolution: int = 6) -> Column:
    """(lat, lon) of the middle of the H3 cell that holds a point: gnomonic projection to the nearest face of an
    icosahedron, the nearest point of the face's hexagonal lattice, and back. A cell over an edge of two faces is
    told by the face that its middle lies on, so that the middle is looked for twice."""
    point = F.array(F.struct(F.radians(lat).alias("lat"), F.radians(lon).alias("lon")))
    for _ in range(2):
        point = F.transform(point, lambda p: _snapped(p, resolution))
    east = lambda x: x - 360 * F.floor((x + 180) / 360)
    return F.get(F.transform(point, lambda p: F.struct(F.degrees(p["lat"]).alias("lat"), east(F.degrees(p["lon"])).alias("lon"))), F.lit(0))
