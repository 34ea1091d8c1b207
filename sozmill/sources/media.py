"""Audio files and archives: WAV headers and cuts, directory scans, tar members, pointers into Parquet corpora."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructType

#: Types are objects, as workers import this module without a session to parse DDL.
HEADER = StructType().add("frames", LongType()).add("rate", IntegerType()).add("channels", IntegerType())


def _header(content: bytes | None) -> tuple[int | None, int | None, int | None]:
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.getnframes(), w.getframerate(), w.getnchannels()
    except Exception:  # any unreadable file is a row without a header
        return None, None, None


@F.pandas_udf(HEADER)
def wav_header(content: pd.Series) -> pd.DataFrame:
    """Frames, rate and channels of WAV bytes; nulls for anything else."""
    return _headers(_header(c) for c in content)


def _headers(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["frames", "rate", "channels"]).astype({"frames": "Int64", "rate": "Int32", "channels": "Int32"})


def opened(path: str):
    """(file system, path in it) of a URI or plain path, for use in tasks."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@F.pandas_udf(HEADER)
def wav_header_at(path: pd.Series) -> pd.DataFrame:
    """As ``wav_header`` of a file, of which only the header is read."""

    def one(p):
        try:
            files, at = opened(p)
            with files.open_input_file(at) as f, wave.open(f) as w:
                return w.getnframes(), w.getframerate(), w.getnchannels()
        except Exception:
            return None, None, None

    return _headers(one(p) for p in path)


@F.pandas_udf(DoubleType())
def duration_of(content: pd.Series) -> pd.Series:
    """Seconds of WAV bytes: as the header says; else, where its sizes are missing or wrong, as long as the samples that are there; else null."""

    def one(c):
        frames, rate, channels = _header(c)
        if frames and rate:
            width = 2
            with wave.open(io.BytesIO(c)) as w:
                width = w.getsampwidth()
            if frames * width * channels <= len(c):
                return frames / rate
        at, form = c.find(b"data") if c else -1, c.find(b"fmt ") if c else -1
        if at < 0 or form < 0 or len(c) < form + 24:
            return None
        channels, rate = struct.unpack_from("<HI", c, form + 10)
        bits = struct.unpack_from("<H", c, form + 22)[0]
        size = channels * bits // 8
        return (len(c) - at - 8) // size / rate if size and rate and len(c) > at + 8 else None

    return pd.Series([one(c) for c in content], dtype="float64")


@F.pandas_udf(ArrayType(FloatType()))
def mono_samples(content: pd.Series) -> pd.Series:
    """Samples of 16-bit WAV bytes as -1 .. 1, channels averaged; null for anything else."""

    def one(c):
        try:
            with wave.open(io.BytesIO(c)) as w:
                if w.getsampwidth() != 2:
                    return None
                data = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
            return (data.astype(np.float32) / 32768.0).mean(1)
        except Exception:
            return None

    return pd.Series([one(c) for c in content], dtype=object)


@F.pandas_udf(BinaryType())
def wav_cut(content: pd.Series, first: pd.Series, end: pd.Series) -> pd.Series:
    """WAV bytes of frames [first, end) clipped to the file; null where nothing is left."""

    def one(c, a, b):
        try:
            with wave.open(io.BytesIO(c)) as w:
                a, b = max(0, int(a)), min(w.getnframes(), int(b))
                if b <= a:
                    return None
                w.setpos(a)
                out = io.BytesIO()
                with wave.open(out, "wb") as o:
                    o.setparams(w.getparams())
                    o.writeframes(w.readframes(b - a))
                return out.getvalue()
        except Exception:
            return None

    return pd.Series([one(c, a, b) for c, a, b in zip(content, first, end)])


@F.pandas_udf(BooleanType())
def _finished(folder: pd.Series) -> pd.Series:
    """Whether a folder holds a .done file, which Spark's listing hides; asked of the file system that all executors share."""

    def one(f):
        files, at = opened(f)
        return files.get_file_info(f"{at}/.done").is_file

    return folder.map(one)


_META = "id string, title string, channel string, uploader string, language string, upload_date string, duration double, webpage_url string"


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Path and folder of the files of a name below a root; contents are read only where they are selected."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return found.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))


def _part(i: int) -> Column:
    return F.element_at(F.split("path", "/"), i)


def _checked(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "unreadable audio").when(seconds == 0, "empty audio")


def scan_recordings(spark: SparkSession, root: str) -> DataFrame:
    """root/<channel>/<video>/audio.wav of finished videos (a .done file beside it): ids, title, language, duration, and an issue or null.

    meta.json beside the audio gives the title, the uploader's name and the language; a folder without a readable one has an issue.
    """
    seconds = F.try_divide(F.col("h.frames"), F.col("h.rate"))
    audio = _listed(spark, root, "audio.wav").select("folder", _part(-3).alias("channel"), _part(-2).alias("video"), wav_header_at("path").alias("h")).where(_finished("folder"))
    parsed = F.from_json(F.col("content").cast("string"), _META)
    metas = _listed(spark, root, "meta.json").select("folder", parsed.alias("m")).where("m.id is not null")
    rows = audio.join(metas, "folder", "left")
    owner = F.coalesce(F.nullif(F.trim("m.channel"), F.lit("")), F.nullif(F.trim("m.uploader"), F.lit("")))
    return rows.select(
        "folder", "channel", "video", F.col("m.title").alias("title"), owner.alias("owner"), F.nullif(F.trim("m.language"), F.lit("")).alias("language"), seconds.alias("duration"),
        F.col("h.rate").alias("sample_rate"), F.coalesce(_checked(seconds), F.when(F.col("m").isNull(), "no metadata")).alias("issue"),
    )


def scan_segments(spark: SparkSession, root: str) -> DataFrame:
    """root/<channel>/<video>/<stem>.wav of finished folders: id (channel_video_stem), path, duration, sample_rate, and an issue or null."""
    seconds = F.try_divide(F.col("h.frames"), F.col("h.rate"))
    audio = _listed(spark, root, "*.wav").select("path", "folder", F.concat_ws("_", _part(-3), _part(-2), F.regexp_replace(_part(-1), "\\.wav$", "")).alias("id"), wav_header_at("path").alias("h"))
    return audio.where(_finished("folder")).select(F.lower("id").alias("id"), "path", seconds.alias("duration"), F.col("h.rate").alias("sample_rate"), _checked(seconds).alias("issue"))


def scan_corpus(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """The named columns of the Parquet files that match a glob, each row with its file and its number there; other columns aren't read."""
    return spark.read.parquet(pattern).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_no"), *columns)


def relative(path: Column, base: str) -> Column:
    """A path below ``base`` without it, any other as it is."""
    head = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of the files that match a glob."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


class TarPartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class TarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import glob

        return [TarPartition(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition: TarPartition) -> Iterator[tuple]:
        import tarfile

        with tarfile.open(partition.path) as archive:
            for member in archive:
                if member.isfile():
                    yield partition.path, member.name, archive.extractfile(member).read()


class TarSource(DataSource):
    """``spark.read.format("tar").load(glob)``: one row per member, one partition per archive, members streamed."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return "archive string, name string, content binary"

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def read_speech(spark: SparkSession, tsv: str, archives: str) -> DataFrame:
    """Rows of tab-separated transcripts joined with the archived audio of their file name, the first by member name.

    Lines of fewer than three fields are dropped; the file's stem gives the split: dev is val, test is test, else train.
    """
    spark.dataSource.register(TarSource)
    lines = spark.read.text(tsv).select(F.split("value", "\t").alias("f"), F.regexp_extract("_metadata.file_path", "([^/]+)\\.[^./]*$", 1).alias("stem")).where(F.size("f") >= 3)
    rows = lines.select(F.get("f", 0).alias("id"), F.get("f", 1).alias("file_name"), F.get("f", 2).alias("text"), F.when(F.col("stem") == "dev", "val").when(F.col("stem") == "test", "test").otherwise("train").alias("split"))
    members = spark.read.format("tar").load(archives).withColumn("file_name", F.regexp_extract("name", "([^/]+)$", 1))
    first = members.groupBy("file_name").agg(F.min_by("content", "name").alias("content"))
    return rows.join(first, "file_name")


def dereference(manifest: DataFrame, root: str, audio: str = "audio", sources: dict[str, str] | None = None, finished: DataFrame | None = None) -> DataFrame:
    """Manifest rows with the bytes their pointer names: cell ``row_no`` of column ``audio`` of ``root``/``parquet``, or a file.

    Only the footers and the row groups that hold wanted rows are read, a group by one task and only its audio column;
    the corpus itself is never shuffled. ``audio`` is bytes or a struct with bytes. Missing files, rows outside the file
    and rows without bytes keep null. ``sources`` maps each source to its folder below the root; a row of another source
    then raises. Rows of ``finished`` (sample_id) are left out.
    """
    if sources is not None:
        unknown = unknown_names([r[0] for r in manifest.select("source").distinct().collect()], list(sources))
        if unknown:
            raise ValueError(f"unknown sources: {', '.join(map(str, unknown))}")
    if finished is not None:
        manifest = manifest.join(finished.select("sample_id"), "sample_id", "left_anti")
    folder = F.lit(root) if sources is None else F.concat(F.lit(root.rstrip("/") + "/"), F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])[F.col("source")])
    pointed = manifest.where("parquet is not null").withColumn("_file", F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), "parquet"))
    wanted = pointed.select("_file", F.col("row_no").alias("_row")).dropna().distinct()

    def groups(batches):
        known: dict[str, np.ndarray | None] = {}
        for pdf in batches:
            out = []
            for path, row in zip(pdf["_file"], pdf["_row"]):
                if path not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[path] = _group_ends(path)
                ends = known[path]
                out.append(int(np.searchsorted(ends, row, "right")) if ends is not None and len(ends) and 0 <= row < ends[-1] else None)
            yield pdf.assign(_group=pd.array(out, dtype="Int32"))

    def read(batches):
        last, cells, first = None, None, 0
        for pdf in batches:
            content = []
            for path, row, group in zip(pdf["_file"], pdf["_row"], pdf["_group"]):
                if last != (path, group):
                    last, (cells, first) = (path, group), _group_cells(path, int(group), audio)
                content.append(cells[int(row) - first].as_py())
            yield pdf.drop(columns="_group").assign(content=content)

    grouped = wanted.mapInPandas(groups, "_file string, _row long, _group int").where("_group is not null")
    cells = grouped.repartition("_file", "_group").sortWithinPartitions("_file", "_group").mapInPandas(read, "_file string, _row long, content binary")
    filled = pointed.join(cells, (pointed["_file"] == cells["_file"]) & (F.col("row_no") == F.col("_row")), "left").select(*manifest.columns, "content")
    local = manifest.where("parquet is null")

    def load(batches):
        for pdf in batches:
            yield pdf.assign(content=[_content(p) for p in pdf["audio_filepath"]])

    files = local.select("audio_filepath").dropna().distinct().mapInPandas(load, "audio_filepath string, content binary")
    return filled.unionByName(local.join(files, "audio_filepath", "left").select(*filled.columns))


def unknown_names(wanted: list, known: list) -> list:
    """Names that aren't known, each once, in order."""
    return [n for n in dict.fromkeys(wanted) if n not in set(known)]


def _content(path: str) -> bytes | None:
    try:
        files, at = opened(path)
        with files.open_input_stream(at) as f:
            return f.read()
    except OSError:
        return None


def _group_ends(path: str) -> np.ndarray | None:
    """Numbers of the first row after each row group, or None where there is no such file."""
    import pyarrow.parquet as pq

    try:
        files, at = opened(path)
        with files.open_input_file(at) as f:
            meta = pq.ParquetFile(f).metadata
            return np.cumsum([meta.row_group(i).num_rows for i in range(meta.num_row_groups)])
    except (OSError, ValueError):
        return None


def _group_cells(path: str, group: int, audio: str):
    """Byte cells of one row group's audio column, and the number of its first row."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    files, at = opened(path)
    with files.open_input_file(at) as f:
        parquet = pq.ParquetFile(f)
        first = sum(parquet.metadata.row_group(i).num_rows for i in range(group))
        column = parquet.read_row_group(group, columns=[audio]).column(audio).combine_chunks()
    if pa.types.is_struct(column.type):
        column = column.field("bytes")
    return column, first
