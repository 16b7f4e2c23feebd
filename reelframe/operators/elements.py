"""Element trees of binary columns as tables: nested boxes, chunks and EBML elements, found by built-in functions alone.

A tree is one projection: a fold over the bytes of each container reads header after header and gathers the elements,
and a fold over the levels makes the containers among them the next level's input. The content stays in its row, nothing is exchanged and no
Python runs. A fold takes at most LIMIT elements of a container; where more follow, the rest of that container is the
input of another round over the files that have one, until none is left.

Rows: file, path (ids joined by /), id, depth (from 0), parent (start of the container, null at the top), start, head
(start of the payload), end, state. States: `whole`; `open`, a size that says "to the end" or is unknown; `cut`, an end
beyond the container's, which is held to it; `deep`, a container below the last level, which isn't entered. A header that can't be read
(short, or a size smaller than the header) ends its container's list. Null and empty content have no rows. Ids
outside printable characters are written byte by byte as Latin-1, EBML ids in hexadecimal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.sources.tables import checkpointed

LIMIT = 2048
_ITEM = "struct<id:string,start:bigint,head:bigint,end:bigint,next:bigint,state:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piece(content: Column, start: Column, n: int | Column) -> Column:
    """n bytes from start, counted from 0."""
    return F.substring(content, (start + 1).cast("int"), F.lit(n) if isinstance(n, int) else n.cast("int"))


def big_endian(data: Column) -> Column:
    """An unsigned number of up to eight bytes; null without bytes or beyond a long."""
    return F.conv(F.hex(data), 16, 10).try_cast("long")


def little_endian(data: Column, n: int) -> Column:
    return F.conv(F.concat(*(F.hex(F.substring(data, k, 1)) for k in range(n, 0, -1))), 16, 10).try_cast("long")


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _item(name: Column, start: Column, head: Column, end: Column, step: Column, state: Column) -> Column:
    return F.struct(name.alias("id"), start.alias("start"), head.alias("head"), end.alias("end"), step.alias("next"), state.alias("state"))


def _sized(name: Column, start: Column, header: Column, size: Column, limit: Column, opened: Column, pad: bool = False) -> Column:
    """An element of header + size bytes; held to its container."""
    head = start + header
    end = F.when(opened, limit).when(size.isNull() | (head + size > limit), limit).otherwise(head + size)
    state = F.when(opened, "open").when(size.isNull() | (head + size > limit), "cut").otherwise("whole")
    step = end + end.bitwiseAND(F.lit(1)).bitwiseXOR(head.bitwiseAND(F.lit(1))) if pad else end
    return _item(name, start, head, end, step, state)


@dataclass(frozen=True)
class Family:
    """How headers are read: header(content, start, limit, depth) gives an element or null; least is the shortest header."""

    name: str
    header: Callable[[Column, Column, Column, Column], Column]
    least: int
    containers: dict[str, int]  # id -> bytes between the head and the first child


def _box(content: Column, start: Column, limit: Column, depth: Column) -> Column:
    """A 32-bit size that counts the header; 1: a 64-bit one follows; 0: to the end."""
    size = big_endian(piece(content, start, 4))

    def read(size: Column) -> Column:
        long = size == 1
        header = F.when(long, F.lit(16)).otherwise(F.lit(8)).cast("long")
        whole = F.when(long, big_endian(piece(content, start + 8, 8))).otherwise(size)
        name = latin(piece(content, start + 4, 4))
        short = (long & (start + 16 > limit)) | ((size != 0) & (whole < header))
        return F.when(~F.coalesce(short, F.lit(False)), _sized(name, start, header, whole - header, limit, size == 0))

    return let(size, read)


def _chunk(big: bool) -> Callable[[Column, Column, Column, Column], Column]:
    def header(content: Column, start: Column, limit: Column, depth: Column) -> Column:
        """An id and a 32-bit size; payloads are padded to even lengths; a size of all ones: to the end."""
        data = piece(content, start + 4, 4)
        size = big_endian(data) if big else little_endian(data, 4)
        return let(size, lambda n: _sized(latin(piece(content, start, 4)), start, F.lit(8).cast("long"), n, limit, n == 0xFFFFFFFF, pad=True))

    return header


def _width(first: Column, most: int) -> Column:
    """Bytes of a variable-length number by the leading zero bits of its first byte; null beyond most."""
    return reduce(lambda rest, k: F.when(first >= (0x80 >> (k - 1)), F.lit(k)).otherwise(rest), range(most, 0, -1), F.lit(None).cast("int"))


def _element(content: Column, start: Column, limit: Column, depth: Column) -> Column:
    """An id and a size of variable length. Of unknown size, the outermost runs to the end; within it, the elements follow as siblings."""

    def with_id(w: Column) -> Column:
        return let(big_endian(piece(content, start + w, 1)), lambda second: let(F.struct(w.alias("w"), _width(second, 8).alias("n"), second.alias("b")), with_size))

    def with_size(x: Column) -> Column:
        bits = F.element_at(F.array(*(F.lit(0x7F >> k).cast("long") for k in range(8))), x["n"])
        rest = F.when(x["n"] == 1, F.lit(0).cast("long")).otherwise(big_endian(piece(content, start + x["w"] + 1, x["n"] - 1)))
        scale = F.element_at(F.array(*(F.lit(1 << 8 * k).cast("long") for k in range(8))), x["n"])
        size = x["b"].bitwiseAND(bits) * scale + rest
        whole = F.struct(size.alias("size"), ((x["b"].bitwiseAND(bits) == bits) & (rest == scale - 1)).alias("unknown"), (x["w"] + x["n"]).cast("long").alias("header"), F.hex(piece(content, start, x["w"])).alias("id"))
        return F.when(x["n"].isNotNull() & (start + x["w"] + x["n"] <= limit), let(whole, lambda y: F.when(y["unknown"] & (depth > 0), _item(y["id"], start, start + y["header"], start + y["header"], start + y["header"], F.lit("open"))).otherwise(_sized(y["id"], start, y["header"], y["size"], limit, y["unknown"]))))

    return let(_width(big_endian(piece(content, start, 1)), 4), lambda w: F.when(w.isNotNull() & (start + w < limit), with_id(w)))


BOXES = Family("boxes", _box, 8, dict.fromkeys("moov trak mdia minf stbl dinf edts udta moof traf mvex mfra ilst sinf schi".split(), 0) | {"meta": 4, "stsd": 8, "dref": 8})
_FORMS = dict.fromkeys(["RIFF", "RIFX", "RF64", "BW64", "LIST", "FORM"], 4)
CHUNKS = Family("chunks", _chunk(False), 8, _FORMS)
BIG_CHUNKS = Family("big-endian chunks", _chunk(True), 8, _FORMS)
#: Segment, seek head, info, tracks with video, audio and encodings, cues, chapters, tags, clusters and block groups, attachments.
EBML = Family("ebml", _element, 2, dict.fromkeys("1A45DFA3 18538067 114D9B74 4DBB 1549A966 1654AE6B AE E0 E1 6D80 6240 1C53BB6B BB B7 1043A770 45B9 B6 80 1254C367 7373 63C0 67C8 1F43B675 A0 1941A469 61A7".split(), 0))


def walked(content: Column, start: Column, limit: Column, depth: Column, family: Family, most: int = LIMIT) -> Column:
    """(items, at): the elements between start and limit in order, most at once; at is where a further fold goes on, else null."""
    steps = F.least(F.lit(most).cast("long"), (limit - start) / F.lit(family.least)).cast("int")
    zero = F.struct(start.alias("at"), F.array().cast(f"array<{_ITEM}>").alias("items"))

    def step(state: Column, _: Column) -> Column:
        stop = F.struct(limit.alias("at"), state["items"].alias("items"))
        more = lambda x: F.when(x.isNull(), stop).otherwise(F.struct(F.greatest(x["next"], state["at"] + 1).alias("at"), F.concat(state["items"], F.array(x)).alias("items")))
        return F.when(state["at"] + family.least > limit, state).otherwise(let(family.header(content, state["at"], limit, depth).cast(_ITEM), more))

    done = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), zero, step)
    return let(done, lambda s: F.struct(s["items"].alias("items"), F.when(s["at"] + family.least <= limit, s["at"]).alias("at")))


_NODE = "struct<path:string,depth:int,id:string,parent:bigint,start:bigint,head:bigint,end:bigint,state:string>"


def _level(content: Column, containers: Column, family: Family, most: int) -> Column:
    """Nodes of all containers' elements, and a node of state `more` for each container that has further ones."""
    own = lambda c, x: F.struct(F.concat_ws("/", c["path"], x["id"]).alias("path"), c["depth"].alias("depth"), x["id"].alias("id"), c["parent"].alias("parent"), x["start"].alias("start"), x["head"].alias("head"), x["end"].alias("end"), x["state"].alias("state")).cast(_NODE)
    rest = lambda c, at: F.when(at.isNotNull(), F.array(F.struct(c["path"].alias("path"), c["depth"].alias("depth"), F.lit(None).cast("string").alias("id"), c["parent"].alias("parent"), at.alias("start"), at.alias("head"), c["end"].alias("end"), F.lit("more").alias("state")).cast(_NODE))).otherwise(F.array().cast(f"array<{_NODE}>"))
    found = lambda c: let(walked(content, c["head"], c["end"], c["depth"], family, most), lambda w: F.concat(F.transform(w["items"], lambda x: own(c, x)), rest(c, w["at"])))
    return F.flatten(F.transform(containers, found))


def _inside(nodes: Column, family: Family, depth: int) -> Column:
    """The containers among nodes, as input of the next level."""
    table = F.create_map(*(F.lit(x) for pair in family.containers.items() for x in pair))
    entered = F.filter(nodes, lambda x: (F.coalesce(F.element_at(table, x["id"]), F.lit(-1)) >= 0) & (x["depth"] < depth - 1))
    return F.transform(entered, lambda x: F.struct(x["path"].alias("path"), (x["depth"] + 1).alias("depth"), F.lit(None).cast("string").alias("id"), x["start"].alias("parent"), x["start"].alias("start"), (x["head"] + F.element_at(table, x["id"])).alias("head"), x["end"].alias("end"), x["state"].alias("state")).cast(_NODE))


def _expanded(files: DataFrame, file: str, family: Family, depth: int, most: int) -> DataFrame:
    """Nodes of the containers in column seeds, down to depth levels; `deep` for a container that isn't entered."""
    zero = F.struct(F.col("seeds").alias("front"), F.array().cast(f"array<{_NODE}>").alias("nodes"))
    more = lambda state: lambda own: F.struct(_inside(own, family, depth).alias("front"), F.concat(state["nodes"], own).alias("nodes"))
    step = lambda state, _: F.when(F.size(state["front"]) > 0, let(_level(F.col("content"), state["front"], family, most), more(state))).otherwise(state)
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), zero, step, lambda state: state["nodes"])
    deep = (F.col("depth") == depth - 1) & (F.col("state") != "more") & F.col("id").isin(list(family.containers))
    nodes = files.select(file, F.explode(levels).alias("x")).select(file, "x.*")
    return nodes.withColumn("state", F.when(deep, "deep").otherwise(F.col("state")))


def elements(files: DataFrame, family: Family, file: str = "file", depth: int = 8, most: int = LIMIT) -> DataFrame:
    """The element tree of every file; files: a key and content (binary)."""
    own = files.select(file, "content")
    top = F.array(F.struct(F.lit(None).cast("string"), F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.length("content").cast("long"), F.lit("")).cast(_NODE))
    out, found = None, checkpointed(_expanded(own.withColumn("seeds", F.when(F.length("content") > 0, top).otherwise(F.array().cast(f"array<{_NODE}>"))), file, family, depth, most))
    while True:
        done = found.filter("state <> 'more'")
        out = done if out is None else out.unionByName(done)
        rest = found.filter("state = 'more'")
        if not rest.limit(1).count():
            return out
        seeds = rest.groupBy(file).agg(F.collect_list(F.struct(*(c for c in rest.columns if c != file)).cast(_NODE)).alias("seeds"))
        found = checkpointed(_expanded(own.join(seeds, file), file, family, depth, most))
