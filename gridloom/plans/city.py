"""The city query: configuration, layer order, export and canopy re-application."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codes
from gridloom.functions.frames import GridFrame, LocalMetres, VoxelFrame, buffered, create_rectangle, projections, rectangle_metres, to_geographic, to_projected, voxel_frame
from gridloom.operators import meshes as mesh_ops
from gridloom.operators import raster, topology, voxel
from gridloom.sources import citygml, model
from gridloom.sources.scratch import settled


@dataclass(frozen=True)
class Resolved:
    shell_threshold: float
    occupancy_threshold: float
    anchor: str


#: Voxel modes: shell threshold, occupancy threshold and anchor (fixed values).
MODES = {"inclusive": Resolved(0.0, 0.0, "connected"), "tight": Resolved(0.5, 0.0, "adjacent")}


@dataclass
class CityConfig:
    """What to build. A threshold that is given wins over its mode's; the anchor always follows the mode."""

    citygml_path: str | list[str] = ""
    center_lon: float | None = None
    center_lat: float | None = None
    size_meters: float = 500.0
    rectangle_vertices: list[tuple[float, float]] | None = None
    buffer_meters: float = 0.0
    voxel_size: float = 2.0
    building_lod: int | None = None
    include_bridges: bool = True
    dem_source: str | None = None
    land_cover_source: str = "CityGML"
    canopy_source: str = "Static"
    static_tree_height: float = 10.0
    trunk_height_ratio: float | None = None
    voxel_mode: str = "inclusive"
    building_shell_threshold: float | None = None
    occupancy_threshold: float | None = None
    occupancy_subdivisions: int = 3
    underground_depth: float = 0.0
    max_cells: int = 10**12
    cache_root: str | None = None
    feature_types: tuple[str, ...] = ("building", "bridge", "terrain", "vegetation")
    tree_codes: list[int] = field(default_factory=lambda: [5])
    terrain_solid: bool = True
    max_files: int | None = None

    def __post_init__(self) -> None:
        if self.voxel_mode not in MODES:
            raise ValueError(f"voxel_mode {self.voxel_mode!r}; one of {sorted(MODES)}")
        if self.buffer_meters < 0:
            raise ValueError("buffer_meters must not be negative")

    def resolved(self) -> Resolved:
        m = MODES[self.voxel_mode]
        pick = lambda own, mode: mode if own is None else own
        return Resolved(pick(self.building_shell_threshold, m.shell_threshold), pick(self.occupancy_threshold, m.occupancy_threshold), m.anchor)

    def rectangles(self) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
        """(target, buffered) rectangles as [SW, NW, NE, SE]."""
        if self.rectangle_vertices:
            core = list(self.rectangle_vertices)
        elif self.center_lon is not None and self.center_lat is not None:
            core = create_rectangle(self.center_lon, self.center_lat, self.size_meters)
        else:
            raise ValueError("give rectangle_vertices, or center_lon and center_lat")
        return core, buffered(core, self.buffer_meters) if self.buffer_meters else core


def build_voxels(frame: VoxelFrame, dem: DataFrame, terrain: DataFrame | None, buildings: DataFrame | None, bridges: DataFrame | None = None,
                 vegetation: DataFrame | None = None, cover: DataFrame | None = None, canopy: DataFrame | None = None, plus_one: bool = False) -> DataFrame:
    """Layers in order: terrain, DEM fill of its gaps, buildings and bridges (overwrite), vegetation (air only),
    land cover on the top ground, canopy (air only)."""
    ground = voxel.fill_terrain(dem, frame) if terrain is None else voxel.fill_terrain_gaps(terrain, dem, frame)
    layers = [(ground, True), *[(x, True) for x in (buildings, bridges) if x is not None], *[(x, False) for x in [vegetation] if x is not None]]
    out = voxel.merge_layers(layers)
    if cover is not None:
        out = voxel.overlay_land_cover(out, cover, dem, frame, plus_one)
    if canopy is not None:
        out = voxel.apply_canopy(out, canopy, dem, frame)
    return out


def _grid(tri: DataFrame, frame: GridFrame) -> DataFrame:
    """Triangles x = latitude, y = longitude in grid coordinates. Kept, so that the frame's arithmetic isn't written out in every use."""
    out = tri
    for i in range(3):
        r, c = frame.rowcol(F.col(f"y{i}"), F.col(f"x{i}"))
        out = out.withColumns({f"__r{i}": r, f"__c{i}": c})
    return settled(out.select("seq", *[x for i in range(3) for x in (F.col(f"__c{i}").alias(f"x{i}"), F.col(f"__r{i}").alias(f"y{i}"), F.col(f"z{i}"))]))


def _metres(tri: DataFrame, local: LocalMetres) -> DataFrame:
    out = tri
    for i in range(3):
        x, y = local.project(F.col(f"y{i}"), F.col(f"x{i}"))
        out = out.withColumns({f"__x{i}": x, f"__y{i}": y})
    return settled(out.select("seq", *[e for i in range(3) for e in (F.col(f"__x{i}").alias(f"x{i}"), F.col(f"__y{i}").alias(f"y{i}"), F.col(f"z{i}"))]))


def run_core(spark: SparkSession, cfg: CityConfig) -> dict[str, DataFrame]:
    """The model's tables: dem, cover, building (r, c, h, id), segments, canopy, voxels, mesh_trees and one row of meta."""
    core, rect = cfg.rectangles()
    sw, nw, ne, se = rect
    cx, cy = sum(p[0] for p in rect) / 4, sum(p[1] for p in rect) / 4
    frame, local = GridFrame.of(rect, cfg.voxel_size), rectangle_metres(rect, cx, cy, spark)
    paths = [p for q in ([cfg.citygml_path] if isinstance(cfg.citygml_path, str) else cfg.citygml_path) for p in citygml.discover(spark, q)]
    files = citygml.read_files(spark, paths).where(codes.in_rectangle_by_name(F.col("path"), rect))
    if cfg.max_files is not None:
        files = files.join(files.select("path").orderBy("path").limit(cfg.max_files), "path", "left_semi")
    systems = [r[0] for r in files.where("epsg is not null").select("epsg").distinct().orderBy("epsg").collect()]
    if unknown := sorted(set(systems) - set(projections())):
        raise ValueError(f"no projection for {', '.join(unknown)}")
    for code in systems:
        files = files.where((F.coalesce(F.col("epsg"), F.lit("")) != code) | codes.tile_in_range(F.col("path"), *_bounds(spark, rect, code)))
    if cfg.cache_root:
        from gridloom.sources.cache import refresh

        # The cache holds every file of the dataset; those that the rectangle leaves out are dropped by path.
        parsed = refresh(spark, paths, cfg.cache_root, cfg.building_lod).join(files.select("path"), "path", "left_semi")
    else:
        parsed = citygml.meshes(files, cfg.building_lod)
    parsed = parsed.where(F.col("failure").isNull() & F.col("feature_type").isin(*cfg.feature_types))
    near = mesh_ops.in_rectangle(parsed, [sw, nw, ne, se], x="y", y="x")
    near = settled(near.withColumn("seq", F.xxhash64("path", "feature_type", "k")))  # XML is parsed once, not once for each table
    ids = mesh_ops.renumber(near.where(F.lit(cfg.include_bridges) | (F.col("feature_type") != "bridge")))
    if near.where("feature_type = 'building'").isEmpty():
        raise ValueError("no buildings in the rectangle")
    numbered = near.join(ids, ["path", "k"])
    solid_tri = lambda kind: mesh_ops.triangles(numbered.where(F.col("feature_type") == kind).withColumn("seq", F.col("id")))
    plain = lambda kind: mesh_ops.triangles(near.where(F.col("feature_type") == kind))
    cells = frame.centres(spark).select("r", "c")
    dem = settled(raster.terrain_heights(_grid(plain("terrain"), frame), cells, frame.n_rows, frame.n_cols))
    tri, plants = solid_tri, plain("vegetation")
    if cfg.dem_source:
        # Another ground: every mesh is lifted as a whole onto it.
        old, dem = dem, settled(cells.withColumn("dem", F.lit(0.0)) if cfg.dem_source == "Flat" else model.named_source(spark, cfg.dem_source))
        known = None if near.where("feature_type = 'terrain'").isEmpty() else old
        tri = lambda kind: _lifted(solid_tri(kind), known, dem, frame)
        plants = _lifted(plants, known, dem, frame)
    objects = tri("building").unionByName(tri("bridge"))
    over = settled(raster.mesh_cells(_grid(objects, frame), frame.n_rows, frame.n_cols))
    heights, segments = settled(raster.building_heights(over, dem)), raster.building_segments(over, dem)
    cover = land_use_grid(files, frame, cells, rect, systems) if cfg.land_cover_source == "CityGML" else model.named_source(spark, cfg.land_cover_source)
    tall = near.where("feature_type = 'vegetation'").select("seq", F.element_at("attrs", "height").try_cast("double").alias("height"))
    own = raster.vegetation_tops(raster.mesh_cells(_grid(plants, frame), frame.n_rows, frame.n_cols).join(tall, "seq", "left"), dem)
    other = raster.static_canopy(cover, cfg.tree_codes, cfg.static_tree_height) if cfg.canopy_source == "Static" else model.named_source(spark, cfg.canopy_source)
    cover = settled(cover)
    canopy = raster.merge_canopy(own, other).withColumn("bottom", raster.canopy_base(F.col("top"), F.lit(None).cast("double"), cfg.trunk_height_ratio or raster.TRUNK_RATIO))
    span = objects.agg(F.min(F.least("z0", "z1", "z2")), F.max(F.greatest("z0", "z1", "z2"))).first()
    ground = dem.agg(F.min("dem"), F.max("dem")).first()
    lo, hi = min(span[0], ground[0]), max(span[1], ground[1])
    vf = voxel_frame(frame.n_cols * cfg.voxel_size, frame.n_rows * cfg.voxel_size, lo, hi, cfg.voxel_size, cfg.underground_depth)
    if vf.n_rows * vf.n_cols * vf.n_z > cfg.max_cells:
        raise MemoryError(f"{vf.n_rows} x {vf.n_cols} x {vf.n_z} cells; at most {cfg.max_cells}")
    knobs = cfg.resolved()
    solid = voxel.building_solid(_metres(tri("building"), local), vf, knobs.occupancy_threshold, cfg.occupancy_subdivisions, knobs.anchor, knobs.shell_threshold)
    solid = settled(solid)
    stamp = lambda df, code: df.select("r", "c", "z", F.lit(code).alias("code"))
    bridge = stamp(voxel.surface_solid(_metres(tri("bridge"), local), vf, knobs.occupancy_threshold), voxel.BUILDING) if cfg.include_bridges else None
    trees = settled(stamp(voxel.surface_solid(_metres(plants, local), vf, knobs.occupancy_threshold), voxel.TREE))
    terrain = _metres(plain("terrain"), local)
    solid_ground = None if cfg.dem_source or not cfg.terrain_solid else settled(stamp(terrain_voxels(terrain, vf), voxel.GROUND))
    voxels = build_voxels(vf, dem, solid_ground, stamp(solid, voxel.BUILDING), bridge, trees, cover, canopy)
    voxels = settled(voxels)
    layers = stamp(solid, voxel.BUILDING).unionByName(trees).unionByName(voxel.fill_terrain(dem, vf))
    if bridge is not None:
        layers = layers.unionByName(stamp(bridge, voxel.BRIDGE))
    roofed = voxels.where(F.col("code") == voxel.BUILDING).select("r", "c").distinct()
    filled = heights.select("r", "c", "h", "id").unionByName(
        raster.fill_ids(roofed, heights.select("r", "c", "id"), frame.n_rows, frame.n_cols).withColumn("h", F.lit(0.0)).select("r", "c", "h", "id"))
    meta = spark.createDataFrame([(vf.n_rows, vf.n_cols, vf.n_z, vf.min_x, vf.max_y, vf.min_z, vf.size)], "n_rows int, n_cols int, n_z int, min_x double, max_y double, min_z double, size double")
    return {"dem": dem, "cover": cover, "building": filled, "segments": segments, "canopy": canopy, "voxels": voxels, "layers": layers, "mesh_trees": trees.select("r", "c", "z"), "meshes": _mesh_table(vf, {
        voxel.GROUND: terrain, voxel.TREE: _metres(plants, local), voxel.BUILDING: _metres(tri("building"), local), voxel.BRIDGE: _metres(tri("bridge"), local)}), "meta": meta}


def _bounds(spark: SparkSession, rect: list[tuple[float, float]], epsg: str) -> tuple[float, float, float, float]:
    """The box around a rectangle of (lon, lat) corners in a projected system."""
    p = spark.createDataFrame([(float(x), float(y)) for x, y in rect], "lon double, lat double").select(to_projected(F.col("lon"), F.col("lat"), F.lit(epsg), [epsg]).alias("p"))
    return tuple(p.agg(F.min("p.x"), F.min("p.y"), F.max("p.x"), F.max("p.y")).first())


def terrain_voxels(tri: DataFrame, frame: VoxelFrame) -> DataFrame:
    """(r, c, z) of terrain triangles made a solid down to the frame's floor: a cell is ground if its centre is in it.

    Points nearer than a thousandth of a cell are one; numbers are fixed by a checkpoint before they are used twice.
    """
    n = settled(tri.select(F.monotonically_increasing_id().alias("face"), *voxel.TRI))
    v = n.select("face", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"{k}{i}").alias(k) for k in "xyz"]) for i in range(3)])).alias("p"))
    v = v.select(F.lit(0).cast("long").alias("mesh"), (F.col("face") * 3 + F.col("p.i")).alias("v"), "p.x", "p.y", "p.z")
    f = n.select(F.lit(0).cast("long").alias("mesh"), "face", *[(F.col("face") * 3 + i).alias(k) for i, k in enumerate("abc")])
    points, faces = topology.terrain_solid(v, f, 1 << 60, frame.min_z, frame.size * 1e-3)
    t = topology.face_points(settled(faces), settled(points)).withColumn("seq", F.lit(0).cast("long"))
    low = t.withColumns({f"z{i}": F.col(f"z{i}") - frame.size / 2 for i in range(3)})  # so that whole cells up to the half are ground
    return voxel.scanline_fill(low, frame).select("r", "c", "z")


def _mesh_table(frame: VoxelFrame, kinds: dict[int, DataFrame]) -> DataFrame:
    """(code, seq, face, x0..z2): triangles by category in the exports' frame, x southwards, y eastwards, from the grid's corner."""
    out = None
    for code, tri in kinds.items():
        place = {k: [{"x": frame.max_y - F.col(f"y{i}"), "y": F.col(f"x{i}") - frame.min_x, "z": F.col(f"z{i}") - frame.min_z}[k].alias(f"{k}{i}") for i in range(3)] for k in "xyz"}
        one = tri.select(F.lit(code).alias("code"), F.col("seq").cast("long").alias("seq"), F.monotonically_increasing_id().alias("face"), *[place[k][i] for i in range(3) for k in "xyz"])
        out = one if out is None else out.unionByName(one)
    return settled(out)


def _lifted(tri: DataFrame, old: DataFrame | None, new: DataFrame, frame: GridFrame) -> DataFrame:
    g = _grid(tri, frame)
    points = g.select("seq", F.explode(F.array(*[F.struct(*[F.col(f"{k}{i}").alias(k) for k in "xyz"]) for i in range(3)])).alias("p")).select("seq", "p.*").distinct()
    dz = raster.anchor_shift(points, old, new, frame.n_rows, frame.n_cols)
    return tri.join(dz, "seq").withColumns({f"z{i}": F.col(f"z{i}") + F.col("dz") for i in range(3)}).drop("dz")


def land_use_grid(files: DataFrame, frame: GridFrame, cells: DataFrame, rect: list[tuple[float, float]], systems: list[str] | None = None) -> DataFrame:
    """(r, c, code) from land-use files; cells without a polygon have the default class."""
    xs, ys = [p[0] for p in rect], [p[1] for p in rect]
    bounds = (min(xs), min(ys), max(xs), max(ys))
    own = files.where("feature_type = 'land use'")
    use = citygml.land_use_from_text(own.where("epsg is null").where(citygml.envelope_meets(F.col("text"), *bounds)).select("path", "text"), "text", bounds)
    if systems:
        far = citygml.land_use_from_text(own.where("epsg is not null").select("path", "epsg", "text"), "text")
        back = lambda ring: F.transform(ring, lambda p: to_geographic(p["y"], p["x"], F.col("epsg"), systems))
        turned = lambda ring: F.transform(back(ring), lambda g: F.struct(g["lon"].alias("x"), g["lat"].alias("y")))
        use = use.unionByName(far.withColumns({"ring": turned(F.col("ring")), "holes": F.transform("holes", turned)}).drop("epsg"))

    def place(p):
        r, c = frame.rowcol(p["x"], p["y"])
        return F.struct(c.alias("x"), r.alias("y"))

    polys = use.select(F.struct("path", "k", "part").alias("seq"), raster.lookup(F.col("class"), raster.LAND_USE, raster.DEFAULT_CLASS).alias("code"),
                       F.transform("ring", place).alias("ring"), F.transform("holes", lambda h: F.transform(h, place)).alias("holes"))
    return raster.land_cover(raster.polygon_cells(polys, frame.n_rows, frame.n_cols), cells)


def generate(spark: SparkSession, cfg: CityConfig, out: str | None = None) -> dict[str, DataFrame]:
    tables = run_core(spark, cfg)
    if out:
        n = tables["meta"].first()["n_rows"]
        model.write_model(tables, out, n)
        return model.read_model(spark, out, list(tables), n)
    return tables


def export_obj(tables: dict[str, DataFrame], path: str, what: str = "voxels") -> None:
    """OBJ in the one frame of the meta row: `voxels`, `layers` (each category by itself, overlaps kept), `cover`, or
    `meshes` (triangles cut at the rectangle). Faces of voxels are joined to large rectangles."""
    meta = tables["meta"].first()
    size = meta["size"]
    if what == "cover":
        model.write_obj(model.cover_quads(tables["cover"], tables["dem"], size), path)
    elif what == "meshes":
        model.write_obj(model.triangle_polygons(tables["meshes"], (0.0, 0.0), (meta["n_rows"] * size, meta["n_cols"] * size)), path)
    else:
        model.write_obj(model.rectangle_quads(voxel.maximal_rectangles(voxel.exposed_faces(tables[what])), size), path)


def reapply(spark: SparkSession, path: str, canopy: DataFrame, to: str) -> dict[str, DataFrame]:
    """A new version of a stored model with another canopy, at a new place; the old one stays as it is."""
    n = spark.read.parquet(f"{path}/meta").first()["n_rows"]
    t = model.read_model(spark, path, ["dem", "cover", "building", "segments", "voxels", "mesh_trees", "meta"], n)
    m = t["meta"].first()
    frame = VoxelFrame(m["n_rows"], m["n_cols"], m["n_z"], m["min_x"], m["max_y"], m["min_z"], m["size"])
    t["voxels"] = voxel.reapply_canopy(t["voxels"], t["mesh_trees"], canopy, t["dem"], frame)
    t["canopy"] = canopy
    model.write_model(t, to, n)
    return model.read_model(spark, to, list(t), n)
