"""Graphs of local sets: objects of a file that name each other by unique ids, from packages down to descriptors.

sets: file, uid, kind and the properties as columns; refs: file, uid (the owner), role, position, target. Every step is an
equi-join on (file, uid), so a file with very many sets spreads over all tasks, and no graph is ever gathered. Repeated
rows of a set or a reference count once; of sets with one uid and different properties the smallest row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.sources.tables import checkpointed

#: Kinds of a track's data.
OTHER, PICTURE, SOUND, DATA, TIMECODE = range(5)


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row a uid; sets without a uid can't be named and go."""
    rest = [c for c in sets.columns if c not in ("file", "uid")]
    one = sets.filter("uid IS NOT NULL").groupBy("file", "uid").agg(F.min(F.struct(*rest)).alias("__set"))
    return one.select("file", "uid", *(F.col("__set")[c].alias(c) for c in rest))


def reached(sets: DataFrame, refs: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """Every reference met on the way down from the roots (file, uid), breadth first, each set entered once a root.

    Rows: file, root, owner, role, position, uid, kind, depth, path (roles from the root), state. States: `whole`, the set is
    entered; `missing`, no such set; `cycle`, the set is one of the owners above; `again`, it was entered on another way (at a
    smaller depth, or at the same depth on the smaller path, owner and position); `deep`, it has depth levels above it and isn't entered. A
    level is one round of joins, written to the checkpoint folder, and there are at most depth of them.
    """
    named = checkpointed(distinct_sets(sets.select("file", "uid", "kind")).select("file", F.col("uid").alias("target"), "kind"))
    edges = checkpointed(refs.select("file", F.col("uid").alias("owner"), "role", "position", "target").distinct())
    start = roots.select("file", "uid").distinct()
    front = start.select("file", F.col("uid").alias("root"), F.col("uid").alias("owner"), F.lit("").alias("above"), F.array("uid").alias("owners"))
    entered, out = start.select("file", F.col("uid").alias("root"), F.col("uid").alias("target")), None
    for level in range(1, depth + 1):
        met = front.join(edges, ["file", "owner"]).withColumn("path", F.concat_ws("/", F.when(F.col("above") != "", F.col("above")), "role"))
        met = met.join(named, ["file", "target"], "left").join(entered.withColumn("known", F.lit(True)), ["file", "root", "target"], "left")
        place = F.struct("path", "owner", "position")
        ranked = met.join(met.filter("kind IS NOT NULL").groupBy("file", "root", "target").agg(F.min(place).alias("least")), ["file", "root", "target"], "left")
        state = (
            F.when(F.col("kind").isNull(), "missing").when(F.array_contains("owners", F.col("target")), "cycle")
            .when(F.col("known") | (place != F.col("least")), "again").when(F.lit(level == depth), "deep").otherwise("whole")
        )
        found = checkpointed(ranked.select("file", "root", "owner", "role", "position", F.col("target").alias("uid"), "kind", F.lit(level).alias("depth"), "path", state.alias("state"), "owners"))
        out = found.drop("owners") if out is None else out.unionByName(found.drop("owners"))
        fresh = found.filter("state = 'whole'")
        if not fresh.limit(1).count():
            break
        front = fresh.select("file", "root", F.col("uid").alias("owner"), F.col("path").alias("above"), F.concat("owners", F.array("uid")).alias("owners"))
        entered = entered.unionByName(fresh.select("file", "root", F.col("uid").alias("target")))
    return out


def _named(refs: DataFrame, role: str, *renamed: str) -> DataFrame:
    """References of a role: file, owner, position, target under the given names."""
    return refs.filter(F.col("role") == role).select("file", *(F.col(c).alias(n) for c, n in zip(("uid", "position", "target"), renamed, strict=True))).distinct()


def package_tracks(sets: DataFrame, refs: DataFrame) -> DataFrame:
    """Tracks of all packages: file, package, package_kind, place, track_id, num, den, data, duration, start, base, dropped.

    A track's data and duration are its sequence's. The components of a sequence, or the set itself where it is no sequence or names none,
    may say more: a time code makes it a time-code track (the last one counts), and without a duration the first time code or clip
    that has one gives it. References to missing sets count as none; tracks of other kinds than timeline, event and static are left out.
    """
    own = distinct_sets(sets)
    packages = own.filter("kind IN ('MaterialPackage', 'SourcePackage')").select("file", F.col("uid").alias("package"), F.col("kind").alias("package_kind"))
    tracks = own.filter("kind IN ('TimelineTrack', 'EventTrack', 'StaticTrack')").select("file", F.col("uid").alias("track"), "track_id", "num", "den")
    placed = packages.join(_named(refs, "Tracks", "package", "place", "track"), ["file", "package"]).join(tracks, ["file", "track"])
    # A track that names several sequences has its first one, whether that exists or not.
    link = _named(refs, "Sequence", "track", "n", "sequence").groupBy("file", "track").agg(F.min_by("sequence", F.struct("n", "sequence")).alias("sequence"))
    sequences = own.select("file", F.col("uid").alias("sequence"), F.col("kind").alias("sequence_kind"), F.col("definition").alias("data"), F.col("duration").alias("whole"), *(F.col(c).alias(f"own_{c}") for c in ("start", "base", "dropped")))
    linked = placed.join(link, ["file", "track"], "left").join(sequences, ["file", "sequence"], "left")

    parts = _named(refs, "Components", "sequence", "position", "component")
    kinds = own.select("file", F.col("uid").alias("component"), "kind", "duration", "start", "base", "dropped")
    code = F.col("kind") == "TimecodeComponent"
    seen = F.struct("position", "component")
    named = parts.join(kinds, ["file", "component"], "left").groupBy("file", "sequence").agg(
        F.max_by(F.when(code, F.struct(*_timecode())), F.when(code, seen)).alias("timecode"),
        F.min_by("duration", F.when(code | (F.col("kind") == "SourceClip"), F.when(F.col("duration").isNotNull(), seen))).alias("part"),
        F.lit(True).alias("composed"),
    )
    joined = linked.join(named, ["file", "sequence"], "left")
    composed = (F.col("sequence_kind") == "Sequence") & F.col("composed")
    alone = (F.col("sequence_kind") == "TimecodeComponent") & ~F.coalesce(composed, F.lit(False))
    timecode = F.when(composed, F.col("timecode")).when(alone, F.struct(*_timecode("own_")))
    data = F.when(timecode.isNotNull(), F.lit(TIMECODE)).otherwise(F.coalesce("data", F.lit(OTHER)))
    return joined.withColumn("timecode", timecode).select(
        "file", "package", "package_kind", "place", "track", "track_id", "num", "den", data.alias("data"),
        F.coalesce("whole", F.when(composed, F.col("part"))).alias("duration"), F.col("timecode.start").alias("start"), F.col("timecode.base").alias("base"), F.col("timecode.dropped").alias("dropped"),
    )


def _timecode(prefix: str = "") -> list[Column]:
    return [F.coalesce(f"{prefix}{c}", F.lit(0)).alias(c) for c in ("start", "base", "dropped")]


def package_descriptors(sets: DataFrame, refs: DataFrame) -> DataFrame:
    """Descriptors of source packages in order: the named one, or those that a multiple descriptor names. file, package, position, descriptor, kind, linked."""
    own = distinct_sets(sets).select("file", F.col("uid").alias("descriptor"), "kind", "linked")
    packages = distinct_sets(sets).filter("kind = 'SourcePackage'").select("file", F.col("uid").alias("package"))
    link = _named(refs, "Descriptor", "package", "n", "descriptor").groupBy("file", "package").agg(F.min_by("descriptor", F.struct("n", "descriptor")).alias("descriptor"))
    first = packages.join(link, ["file", "package"]).join(own, ["file", "descriptor"])
    several = first.filter("kind = 'MultipleDescriptor'").select("file", "package", F.col("descriptor").alias("multiple"))
    subs = several.join(_named(refs, "SubDescriptors", "multiple", "position", "descriptor"), ["file", "multiple"]).join(own, ["file", "descriptor"])
    columns = ["file", "package", "position", "descriptor", "kind", "linked"]
    one = first.filter("kind <> 'MultipleDescriptor'").withColumn("position", F.lit(0).cast(subs.schema["position"].dataType))
    return one.select(columns).unionByName(subs.select(columns))


def described(tracks: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Essence tracks with their descriptor: the first linked to the track's number; else the only one of a package with one track; else the first of the track's class."""
    essence = tracks.filter((F.col("package_kind") == "SourcePackage") & F.col("data").between(PICTURE, DATA))
    order = F.struct("position", "descriptor")
    linked = descriptors.groupBy("file", "package", F.col("linked").alias("track_id")).agg(F.min_by("descriptor", order).alias("linked_one"))
    first = lambda kind: F.min_by("descriptor", F.when(F.col("kind") == kind, order))
    kinds = descriptors.groupBy("file", "package").agg(F.count(F.lit(1)).alias("many"), F.min("descriptor").alias("only"), first("PictureDescriptor").alias("picture"), first("SoundDescriptor").alias("sound"))
    counts = essence.groupBy("file", "package").agg(F.count(F.lit(1)).alias("tracks"))
    joined = essence.join(linked, ["file", "package", "track_id"], "left").join(kinds, ["file", "package"], "left").join(counts, ["file", "package"])
    alone = F.when((F.col("many") == 1) & (F.col("tracks") == 1), F.col("only"))
    own = F.when(F.col("data") == PICTURE, F.col("picture")).when(F.col("data") == SOUND, F.col("sound"))
    return joined.select("file", "package", "track", "track_id", "data", F.coalesce("linked_one", alone, own).alias("descriptor"))


def file_durations(tracks: DataFrame) -> DataFrame:
    """The longest picture or sound track of a file's material packages in milliseconds, rounded; files without one have no row."""
    ms = F.when((F.col("num") > 0) & (F.col("den") > 0), F.col("duration").cast("double") * F.col("den") * 1000 / F.col("num"))
    own = tracks.filter((F.col("package_kind") == "MaterialPackage") & F.col("data").isin(PICTURE, SOUND))
    return own.groupBy("file").agg(F.max(ms).alias("ms")).filter("ms IS NOT NULL").select("file", F.round("ms").cast("long").alias("duration"))
