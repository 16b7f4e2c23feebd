"""Quality rules: cross-document line frequency over the counts of whole texts.

Lines are normalised (words, A-Z lower-cased, single blanks) and hashed. A line is counted for each distinct document
of a host (column source) that holds it. Two documents count as one when their sets of lines are the same, so exact
copies of a text never make its own lines look like page furniture; documents that differ in any line count each.
Lines found in at least max(min_documents, share * distinct documents of the host) distinct documents are removed; a
document that keeps less than min_kept of its words is depleted and rejected.

Defined results: a null or empty text has no words and fails the base rules; null hosts form one host; repeated rows
are kept, each with its own result, and count once in line counts; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, numbered, pieces, with_text
from reelframe.llm.textstats import Words, prefix_hashes, salted, span_hashes, windows, mix

MIN_DOCUMENTS = 20
HOST_SHARE = 0.01
MIN_KEPT = 0.3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_set long, lines array<struct<line: long, words: int>>"


def line_places(words: Words) -> tuple[np.ndarray, ...]:
    """Of each line with words: its first byte and the end, its row, its first word and the hash of its normalised form."""
    breaks = np.flatnonzero(words.flat == 10)
    line_starts = np.unique(np.concatenate([words.offsets[:-1], breaks + 1]))
    line_of = np.searchsorted(line_starts, words.starts, "right") - 1
    used, first_word = np.unique(line_of, return_index=True)
    doc_of = words.doc[first_word]
    starts = line_starts[used]
    stops = np.minimum(words.offsets[1:][doc_of], np.append(breaks, len(words.flat))[np.searchsorted(breaks, starts)])
    lowered = words.hashes(True)
    place = (np.arange(len(lowered)) - np.repeat(first_word, np.diff(np.append(first_word, len(lowered))))).astype(np.uint64)
    value = mix(lowered + place * np.uint64(0xA24BAED4963EE407))
    line = mix(np.add.reduceat(value, first_word) if len(first_word) else np.empty(0, np.uint64)).view(np.int64)
    return starts, stops, doc_of, first_word, line


def line_stats(words: Words) -> dict[str, np.ndarray]:
    """The five counts of each row, and its distinct normalised lines."""
    n, flat = words.n, words.flat
    exact = prefix_hashes(flat)
    hashes = span_hashes(exact, words.starts, words.ends)
    out = {"n_words": words.per_doc.astype(np.int64)}
    out["word_chars"] = words.sums(words.inside & ((flat & 0xC0) != 0x80))
    out["n_symbols"] = words.sums(_SYMBOLS[flat])

    at, window = windows(words, hashes, 3)
    _, inverse, counts = np.unique(salted(window, words.doc[at]), return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1] if len(at) else at
    held = np.zeros(len(words.starts) + 2, bool)
    for k in range(3):
        held[again + k] = True
    out["n_repeat_words"] = np.bincount(words.doc[held[: len(words.starts)]], minlength=n).astype(np.int64)

    starts, stops, doc_of, first_word, line = line_places(words)
    raw = np.unique(salted(span_hashes(exact, starts, stops), doc_of), return_index=True)[1]
    out["n_dup_lines"] = (np.bincount(doc_of, minlength=n) - np.bincount(doc_of[raw], minlength=n)).astype(np.int64)

    size = np.diff(np.append(first_word, len(words.starts)))
    order = np.lexsort((line, doc_of))
    doc_s, line_s, size_s = doc_of[order], line[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc_s[1:] != doc_s[:-1]) | (line_s[1:] != line_s[:-1])
    heads = np.flatnonzero(new)
    out["line"], out["line_doc"] = line_s[heads], doc_s[heads]
    out["line_words"] = (np.add.reduceat(size_s, heads) if len(heads) else size_s).astype(np.int32)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = Words(batch.column("text"))
        s = line_stats(words)
        bounds = np.searchsorted(s["line_doc"], np.arange(words.n + 1)).astype(np.int32)
        total = np.zeros(len(s["line"]) + 1, np.uint64)
        np.cumsum(mix(s["line"].view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)), out=total[1:])
        line_set = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
        lines = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(s["line"]), pa.array(s["line_words"])], ["line", "words"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("source"), *(pa.array(s[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(line_set), lines],
            ["row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_set", "lines"],
        )


def document_lines(documents: DataFrame) -> DataFrame:
    """A row per document with its counts and its distinct lines, in shared storage; row numbers the input's rows."""
    rows = with_text(documents.withColumn("row", F.monotonically_increasing_id()), "row", F.col("source").cast("string").alias("source"))
    return checkpointed(rows.mapInArrow(_rows, SCHEMA))


def frequent_lines(stats: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = HOST_SHARE) -> DataFrame:
    """(host, line) of lines above the limit of their host."""
    counted = (
        _exploded(stats)
        .groupBy("host", "line", "line_set").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("one").alias("documents"))
        .filter(F.col("documents") >= min_documents)
    )
    distinct = stats.select(F.coalesce("host", F.lit("")).alias("host"), "line_set").distinct()
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    return counted.join(hosts, "host").filter(F.col("documents") >= share * F.col("host_documents")).select("host", "line")


def _exploded(stats: DataFrame) -> DataFrame:
    return stats.select("row", F.coalesce("host", F.lit("")).alias("host"), "line_set", F.explode("lines").alias("x")).select("row", "host", "line_set", "x.line", "x.words")


def assess(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = HOST_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """A row per input row: its counts, the words in removed lines, base_failed and kept."""
    return _assessed(document_lines(documents), min_documents, share, min_kept).drop("removed_lines")


def _assessed(stats: DataFrame, min_documents: int, share: float, min_kept: float, lines: bool = False) -> DataFrame:
    """assess() of document_lines(), with the hashes of the removed lines where asked for, else null."""
    gone = F.collect_list("line") if lines else F.lit(None).cast("array<long>")
    removed = _exploded(stats).join(frequent_lines(stats, min_documents, share), ["host", "line"], "left_semi").groupBy("row").agg(F.sum("words").cast("long").alias("removed_words"), gone.alias("removed_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < min_kept * F.col("n_words")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return (
        stats.select("row", "doc_id", *counts)
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .select("row", "doc_id", *counts, "removed_words", "removed_lines", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
    )


def without_lines(column: pa.Array, removed: pa.Array) -> pa.Array:
    """The texts without the lines whose hashes are in removed; the other lines keep their bytes and order."""
    words = Words(column)
    starts, _, doc, _, line = line_places(words)
    gone = removed.to_pylist()
    pairs = [(d, x) for d, xs in enumerate(gone) for x in xs or ()]
    rows, hashes = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
    dropped = set(starts[np.isin(salted(line.view(np.uint64), doc), salted(hashes.view(np.uint64), rows))].tolist())
    out = column.to_pylist()
    for d in np.unique(rows).tolist():
        at, left = int(words.offsets[d]), []
        for part in out[d].encode().split(b"\n"):
            if at not in dropped:
                left.append(part)
            at += len(part) + 1
        out[d] = b"\n".join(left).decode()
    return pa.array(out, pa.string())


def accepted(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = HOST_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """The documents that the rules keep, with all their columns, without the removed lines, and n_chars counted anew."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = batch.set_column(batch.schema.get_field_index("text"), "text", without_lines(batch.column("text"), batch.column("__removed")))
            yield out.select([n for n in out.schema.names if n not in ("__row", "__removed")])

    found = _assessed(document_lines(documents), min_documents, share, min_kept, lines=True).filter("kept").select(F.col("row").alias("__row"), F.col("removed_lines").alias("__removed"))
    out = numbered(documents).join(found, "__row").mapInArrow(rows, documents.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
