"""Queries over graphs of local sets: a conversation acts as a file, each of its turns as a package with tracks and descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelframe.operators import graphs as op
from reelframe.sources.tables import table

#: l and n give the number of tracks, the kinds, and which references lead nowhere or back.
_BASE = "t AS (SELECT CAST(conv_id AS STRING) AS file, turn, role, CAST(length(text) AS BIGINT) AS l, CAST(length(text) % 3 + 1 AS INT) AS n FROM {conversations} WHERE text IS NOT NULL)"
_NONE = "CAST(NULL AS BIGINT)"


def _set(uid: str, kind: str, source: str, where: str = "true", **columns: str) -> str:
    named = [f"CAST({columns.get(c, 'NULL')} AS BIGINT) AS {c}" for c in ("track_id", "num", "den", "definition", "duration", "start", "base", "dropped", "linked")]
    return f"SELECT file, concat('{uid[0]}', turn{''.join(f", '.', {x}" for x in uid[1:])}) AS uid, {kind} AS kind, {', '.join(named)} FROM {source} WHERE {where}"


def _ref(uid: str, role: str, position: str, target: str, source: str, where: str = "true") -> str:
    name = lambda u: f"concat('{u[0]}', turn{''.join(f", '.', {x}" for x in u[1:])})"
    return f"SELECT file, {name(uid)} AS uid, '{role}' AS role, CAST({position} AS INT) AS position, {name(target)} AS target FROM {source} WHERE {where}"


SETS = f"WITH {_BASE} " + " UNION ALL ".join([
    _set("P", "CASE role WHEN 'user' THEN 'MaterialPackage' ELSE 'SourcePackage' END", "t"),
    _set("Ti", "CASE WHEN l % 7 = 0 THEN 'OtherTrack' WHEN l % 3 = 0 THEN 'EventTrack' ELSE 'TimelineTrack' END", "t {i}", track_id="i + 1", num="24 + l % 3", den="CASE WHEN l % 19 = 0 THEN 0 ELSE 1 END"),
    _set("Qi", "CASE WHEN (l + i) % 9 = 0 THEN 'TimecodeComponent' WHEN (l + i) % 5 = 0 THEN 'SourceClip' ELSE 'Sequence' END", "t {i}", "(l + i) % 11 > 0", definition="(l + i) % 4", duration="CASE WHEN (l + i) % 3 > 0 THEN l END", start="l", base="25", dropped="l % 2"),
    _set("Cij", "CASE WHEN (l + i + j) % 4 = 0 THEN 'TimecodeComponent' WHEN (l + j) % 6 = 0 THEN 'Filler' ELSE 'SourceClip' END", "t {i} {j}", "(l + j) % 13 > 0", duration="CASE WHEN (l + j) % 3 > 0 THEN 2 * l + j END", start="l + j", base="30", dropped="j"),
    _set("D", "CASE WHEN n > 1 THEN 'MultipleDescriptor' WHEN l % 2 = 0 THEN 'PictureDescriptor' ELSE 'SoundDescriptor' END", "t", "l % 10 > 0"),
    _set("Ei", "CASE (l + i) % 3 WHEN 0 THEN 'PictureDescriptor' WHEN 1 THEN 'SoundDescriptor' ELSE 'DataDescriptor' END", "t {i}", linked="CASE WHEN (l + i) % 4 > 0 THEN (l + i) % 3 + 1 END"),
])
REFS = f"WITH {_BASE} " + " UNION ALL ".join([
    _ref("P", "Tracks", "i", "Ti", "t {i}"),
    _ref("Ti", "Sequence", "0", "Qi", "t {i}"),
    _ref("Qi", "Components", "j", "Cij", "t {i} {j}", "(l + i) % 2 = 0"),
    _ref("Qi", "Components", "9", "Ti", "t {i}", "l % 17 = 0"),
    _ref("Ti", "Linked", "1", "D", "t {i}"),
    _ref("P", "Descriptor", "0", "D", "t", "role <> 'user'"),
    _ref("D", "SubDescriptors", "i", "Ei", "t {i}", "n > 1"),
])


def _spark_sql(sql: str) -> str:
    return sql.replace("{i}", "LATERAL VIEW explode(sequence(0, n - 1)) AS i").replace("{j}", "LATERAL VIEW explode(array(0, 1)) AS j")


def _duck_sql(sql: str) -> str:
    return sql.replace("{i}", ", LATERAL (SELECT unnest(range(n)) AS i)").replace("{j}", ", LATERAL (SELECT unnest([0, 1]) AS j)").replace("{conversations}", "conversations")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations")
    return tuple(spark.sql(_spark_sql(sql), conversations=rows) for sql in (SETS, REFS))


def q_set_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references met below the packages, with those that are missing, lead back, or were met before."""
    sets, refs = graph(spark, sf_dir)
    return op.reached(sets, refs, sets.filter("kind IN ('MaterialPackage', 'SourcePackage')"), depth=4)


def q_package_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.package_tracks(*graph(spark, sf_dir)).drop("track")


def q_track_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, refs = graph(spark, sf_dir)
    return op.described(op.package_tracks(sets, refs), op.package_descriptors(sets, refs))


def q_package_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.file_durations(op.package_tracks(*graph(spark, sf_dir)))


_CTES = f"""sets AS MATERIALIZED (SELECT DISTINCT * FROM ({_duck_sql(SETS)})), refs AS MATERIALIZED (SELECT DISTINCT * FROM ({_duck_sql(REFS)}))"""


def _levels(depth: int) -> str:
    """A level after the other; those before say what has been entered."""
    out = [f"{_CTES}, w0 AS (SELECT file, uid AS root, uid, '' AS path, 'whole' AS state, [uid] AS owners FROM sets WHERE kind IN ('MaterialPackage', 'SourcePackage'))"]
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT file, root, uid FROM w{x} WHERE state = 'whole'" for x in range(k))
        out.append(f"""m{k} AS (SELECT w.file, w.root, w.uid AS owner, r.role, r.position, r.target AS uid, s.kind, {k} AS depth, CASE WHEN w.path = '' THEN r.role ELSE w.path || '/' || r.role END AS path, w.owners AS above
 FROM w{k - 1} w JOIN refs r ON r.file = w.file AND r.uid = w.uid LEFT JOIN sets s ON s.file = r.file AND s.uid = r.target WHERE w.state = 'whole'),
w{k} AS (SELECT *, CASE WHEN kind IS NULL THEN 'missing' WHEN list_contains(above, uid) THEN 'cycle'
 WHEN (file, root, uid) IN (SELECT (file, root, uid) FROM ({before})) OR row_number() OVER (PARTITION BY file, root, uid ORDER BY path, owner, position) > 1 THEN 'again' WHEN {k == depth} THEN 'deep' ELSE 'whole' END AS state, list_append(above, uid) AS owners FROM m{k})""")
    rows = " UNION ALL ".join(f"SELECT file, root, owner, role, position, uid, kind, depth, path, state FROM w{k}" for k in range(1, depth + 1))
    return f"WITH {', '.join(out)} {rows}"


_TRACKS = f"""WITH {_CTES},
k AS (SELECT file, uid AS package, kind AS package_kind FROM sets WHERE kind IN ('MaterialPackage', 'SourcePackage')),
l AS (SELECT k.*, r.position AS place, s.uid AS track, s.track_id, s.num, s.den FROM k JOIN refs r ON r.file = k.file AND r.uid = package AND role = 'Tracks' JOIN sets s ON s.file = k.file AND s.uid = r.target WHERE s.kind IN ('TimelineTrack', 'EventTrack', 'StaticTrack')),
q AS (SELECT l.*, s.uid AS sequence, s.kind AS k, s.definition, s.duration AS whole, s.start AS s0, s.base AS b0, s.dropped AS d0 FROM l LEFT JOIN refs r ON r.file = l.file AND r.uid = track AND role = 'Sequence' LEFT JOIN sets s ON s.file = l.file AND s.uid = r.target),
c AS (SELECT r.file, r.uid AS sequence, true AS composed, arg_max({{'s': coalesce(s.start, 0), 'b': coalesce(s.base, 0), 'd': coalesce(s.dropped, 0)}}, r.position) FILTER (s.kind = 'TimecodeComponent') AS tc,
 arg_min(s.duration, r.position) FILTER (s.kind IN ('TimecodeComponent', 'SourceClip') AND s.duration IS NOT NULL) AS part FROM refs r LEFT JOIN sets s ON s.file = r.file AND s.uid = r.target WHERE role = 'Components' GROUP BY ALL),
x AS (SELECT q.*, k = 'Sequence' AND composed AS inner_parts, CASE WHEN k = 'Sequence' AND composed THEN tc WHEN k = 'TimecodeComponent' THEN {{'s': coalesce(s0, 0), 'b': coalesce(b0, 0), 'd': coalesce(d0, 0)}} END AS code, part FROM q LEFT JOIN c USING (file, sequence)),
tracks AS (SELECT file, package, package_kind, place, track, track_id, num, den, CASE WHEN code IS NOT NULL THEN 4 ELSE coalesce(definition, 0) END AS data, coalesce(whole, CASE WHEN inner_parts THEN part END) AS duration, code.s AS start, code.b AS base, code.d AS dropped FROM x)"""
_DESCRIPTORS = """p AS (SELECT r.file, r.uid AS package, s.uid AS descriptor, s.kind, s.linked FROM refs r JOIN sets s ON s.file = r.file AND s.uid = r.target JOIN sets o ON o.file = r.file AND o.uid = r.uid AND o.kind = 'SourcePackage' WHERE role = 'Descriptor'),
d AS (SELECT file, package, 0 AS position, descriptor, kind, linked FROM p WHERE kind <> 'MultipleDescriptor'
 UNION ALL SELECT p.file, p.package, r.position, s.uid, s.kind, s.linked FROM p JOIN refs r ON r.file = p.file AND r.uid = p.descriptor AND role = 'SubDescriptors' JOIN sets s ON s.file = r.file AND s.uid = r.target WHERE p.kind = 'MultipleDescriptor'),
e AS (SELECT *, count(*) OVER (PARTITION BY file, package) AS many FROM tracks WHERE package_kind = 'SourcePackage' AND data BETWEEN 1 AND 3)"""
_FIRST = "(SELECT arg_min(descriptor, position) FROM d WHERE d.file = e.file AND d.package = e.package{0})"

QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
ORACLE = {
    "q_set_graph": _levels(4),
    "q_package_tracks": f"{_TRACKS} SELECT file, package, package_kind, place, track_id, num, den, data, duration, start, base, dropped FROM tracks",
    "q_track_descriptors": f"""{_TRACKS}, {_DESCRIPTORS} SELECT file, package, track, track_id, data, coalesce({_FIRST.format(' AND d.linked = e.track_id')},
 CASE WHEN many = 1 AND (SELECT count(*) FROM d WHERE d.file = e.file AND d.package = e.package) = 1 THEN {_FIRST.format('')} END,
 CASE data WHEN 1 THEN {_FIRST.format(" AND d.kind = 'PictureDescriptor'")} WHEN 2 THEN {_FIRST.format(" AND d.kind = 'SoundDescriptor'")} END) AS descriptor FROM e""",
    "q_package_durations": f"{_TRACKS} SELECT file, round(max(duration::DOUBLE * den * 1000 / num))::BIGINT AS duration FROM tracks WHERE package_kind = 'MaterialPackage' AND data IN (1, 2) AND num > 0 AND den > 0 AND duration IS NOT NULL GROUP BY file",
}
