"""Data sources for raw files, read in planned parts.

`register(spark)` makes three formats known to spark.read: "marked_text" (records that a marker line
begins), "fasta_pieces" and "zip_lines". Plain files are cut into byte ranges, archives into their
members; what is compressed as a whole is read as a stream. A part yields rows as it reads, so no file,
record stream or chromosome is held. Paths are opened through pyarrow, in any store that it knows; the
last element may be a pattern.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairbench.operators import ordering

SPAN = 64 << 20  # bytes of a part
PIECE = 1 << 16  # letters of a row


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int  # -1: to the end of a stream
    member: str = ""


def _files(path: str) -> list[tuple[str, int]]:
    fs, at = pfs.FileSystem.from_uri(path)
    head, _, name = at.rpartition("/")
    if any(c in name for c in "*?["):
        found = [i for i in fs.get_file_info(pfs.FileSelector(head)) if fnmatch.fnmatch(i.base_name, name)]
    else:
        info = fs.get_file_info(at)
        found = fs.get_file_info(pfs.FileSelector(at, recursive=True)) if info.type == pfs.FileType.Directory else [info]
    files = sorted((i.path, i.size) for i in found if i.type == pfs.FileType.File)
    if not files:
        raise FileNotFoundError(path)
    return files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.span = int(options.get("span", SPAN))

    def partitions(self) -> list[Part]:
        out = []
        for name, size in _files(self.path):
            if name.endswith(".gz"):
                out.append(Part(name, 0, -1))
            else:
                out += [Part(name, a, min(a + self.span, size)) for a in range(0, size, self.span)] or [Part(name, 0, 0)]
        return out

    def lines(self, part: Part) -> Iterator[tuple[int, bytes]]:
        """(place of its first byte, line without its end) from the first line that begins in the part, on
        to the file's end: the caller stops."""
        fs, _ = pfs.FileSystem.from_uri(self.path)
        if part.stop < 0:
            source = fs.open_input_stream(part.path)  # unpacks by the file's name
        else:
            source = fs.open_input_file(part.path)
            source.seek(max(part.start - 1, 0))
        with io.BufferedReader(source, 1 << 20) as f:
            at = part.start
            if part.start:  # a line that began before belongs to the part before
                at += len(f.readline()) - 1
            for line in f:
                yield at, line.rstrip(b"\r\n")
                at += len(line)


class _MarkedReader(_Reader):
    def read(self, part: Part) -> Iterator[tuple]:
        marker = self.options["marker"].encode()
        name, begun, body = None, 0, []
        for at, line in self.lines(part):
            if line.startswith(marker):
                if name is not None:
                    yield part.path, begun, name, "\n".join(body)
                name = None
                if 0 <= part.stop <= at:
                    return
                name, begun, body = line[len(marker) :].decode("utf-8", "replace").strip(), at, []
            elif name is not None:
                body.append(line.decode("utf-8", "replace"))
            elif 0 <= part.stop <= at:
                return
        if name is not None:
            yield part.path, begun, name, "\n".join(body)


class _FastaReader(_Reader):
    def read(self, part: Part) -> Iterator[tuple]:
        most = int(self.options.get("piece", PIECE))
        head, begun, held, n = None, None, [], 0
        for at, line in self.lines(part):
            if 0 <= part.stop <= at:
                break
            if line.startswith(b">"):
                if begun is not None:
                    yield part.path, begun, head, b"".join(held).decode()
                head, begun, held, n = line[1:].decode("utf-8", "replace").strip(), at, [], 0
                continue
            letters = b"".join(line.split())
            begun = at if begun is None else begun
            held.append(letters)
            n += len(letters)
            if n >= most:
                yield part.path, begun, head, b"".join(held).decode()
                head, begun, held, n = None, None, [], 0
        if begun is not None:
            yield part.path, begun, head, b"".join(held).decode()


class _ZipReader(_Reader):
    def partitions(self) -> list[Part]:
        out = []
        fs, _ = pfs.FileSystem.from_uri(self.path)
        for name, _ in _files(self.path):
            with fs.open_input_file(name) as f, zipfile.ZipFile(f) as z:  # reads the directory at its end only
                out += [Part(name, 0, -1, m.filename) for m in z.infolist() if not m.is_dir()]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.path:
            return
        fs, _ = pfs.FileSystem.from_uri(self.path)
        with fs.open_input_file(part.path) as f, zipfile.ZipFile(f) as z, z.open(part.member) as lines:
            for i, line in enumerate(lines):
                yield part.path, part.member, i, line.rstrip(b"\r\n").decode("utf-8", "replace")


class MarkedText(DataSource):
    """(path, at, id, body); option `marker`, and `span` for the bytes of a part."""

    @classmethod
    def name(cls) -> str:
        return "marked_text"

    def schema(self) -> str:
        return "path string, at long, id string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _MarkedReader(dict(self.options))


class FastaPieces(DataSource):
    """(path, at, head, seq): letters in pieces, in file order by `at`; head only where a record begins."""

    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return "path string, at long, head string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(dict(self.options))


class ZipLines(DataSource):
    """(archive, member, place, line): lines of all members, a member a part."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "archive string, member string, place long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (MarkedText, FastaPieces, ZipLines):
        spark.dataSource.register(source)


def _read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(**{k: str(v) for k, v in options.items()}).load(path)


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, "zip_lines", path)


def records(spark: SparkSession, path: str, marker: str, wanted: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """(path, at, id, body) of records that a line `marker` followed by the id begins; `wanted` (id) keeps some."""
    out = _read(spark, "marked_text", path, marker=marker, span=span).where("id <> ''")
    return out if wanted is None else out.join(wanted.select("id"), "id", "left_semi")


def weight_matrices(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """(name, weights): motifs of `>name` and rows of four numbers; of repeated names the first in the
    files' order counts. A row that has not four numbers is an error that names some of its motifs."""
    first = records(spark, path, ">", span=span).groupBy("id").agg(F.min_by("body", F.struct("path", "at")).alias("body"))
    rows = F.transform(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != ""), lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.try_cast("double")))
    good = (F.size("rows") > 0) & F.forall("rows", lambda r: (F.size(r) == 4) & F.forall(r, lambda v: v.isNotNull()))
    own = first.select(F.col("id").alias("name"), rows.alias("rows"))
    if bad := [r[0] for r in own.where(~good).select("name").orderBy("name").limit(5).collect()]:
        raise ValueError(f"not rows of four numbers: {bad}")
    return own.select("name", F.flatten("rows").alias("weights"))


def genome(spark: SparkSession, path: str, width: int, size: int, span: int = SPAN, piece: int = PIECE) -> DataFrame:
    """(chrom, tile, seq): sequences of FASTA files in tiles of `size` letters, each with the `width` - 1 that
    follow; cut_tiles of the raw scans takes windows from them. No chromosome is ever in one row or task:
    where a piece lies in its record follows from running sums over one light row a piece."""
    pieces = _read(spark, "fasta_pieces", path, span=span, piece=piece)
    light = pieces.select("path", "at", "head", F.length("seq").alias("n"), F.col("head").isNotNull().cast("int").alias("begins"))
    placed, _ = ordering.running(light, ["path", "at"], "n", before="letters")
    placed, _ = ordering.running(placed, ["path", "at"], "begins", before="records")
    placed = placed.withColumn("record", F.col("records") + F.col("begins"))
    heads = placed.where("begins = 1").select("record", F.split_part("head", F.lit(" "), F.lit(1)).alias("chrom"), F.col("letters").alias("origin"))
    place = placed.join(heads, "record").select("path", "at", "chrom", (F.col("letters") - F.col("origin")).alias("pos"))
    own = pieces.select("path", "at", "seq").where("seq <> ''").join(place, ["path", "at"])
    end = F.col("pos") + F.length("seq")
    low = F.greatest(F.floor((F.col("pos") - (width - 1)) / size), F.lit(0).cast("long"))
    cut = own.select("chrom", "pos", "seq", F.explode(F.sequence(low, F.floor((end - 1) / size))).alias("tile"))
    begin = F.greatest(F.col("tile") * size, F.col("pos"))
    stop = F.least(F.col("tile") * size + size + width - 1, end)
    part = cut.select("chrom", "tile", begin.alias("begin"), F.substring("seq", (begin - F.col("pos") + 1).cast("int"), (stop - begin).cast("int")).alias("part")).where("part <> ''")
    joined = F.array_sort(F.collect_list(F.struct("begin", "part")))
    return part.groupBy("chrom", "tile").agg(F.array_join(F.transform(joined, lambda x: x["part"]), "").alias("seq"))
