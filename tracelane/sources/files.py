"""Tables, inventories, ragged CSV, log archives, and named objects of large JSON files."""

from __future__ import annotations

import io
import itertools
import json
import re
import tarfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tracelane.functions.text import ANSI


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at a path, else the CSV beside it, else an empty table of the schema."""
    base = path.removesuffix(".parquet")
    for read in (lambda: spark.read.parquet(f"{base}.parquet"), lambda: spark.read.option("header", True).schema(schema).csv(f"{base}.csv")):
        try:
            return read()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()) and "UNABLE_TO_INFER_SCHEMA" not in str(e.getCondition()):
                raise
    return spark.createDataFrame([], schema)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """An artifact inventory: a JSON list, or an object that holds one; a missing file is an empty inventory."""
    schema = "artifact_id string, artifact_name string, head_sha string"
    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    v = F.try_parse_json("value")
    items = F.coalesce(F.try_variant_get(v, "$.artifacts", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    rows = text.select(F.explode(items).alias("a"))
    get = lambda *names: F.coalesce(*(F.try_variant_get("a", f"$.{n}", "string") for n in names))
    return rows.select(get("artifact_id", "id").alias("artifact_id"), get("artifact_name", "name").alias("artifact_name"), get("head_sha", "workflow_run.head_sha").alias("head_sha"))


def aggregate_files(spark: SparkSession, path: str) -> DataFrame:
    """Published results below a path: files of one concurrency win, run summaries count only where there is none."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value").withColumn("name", F.lower(F.element_at(F.split("path", "/"), -1)))
    files = files.where(F.col("name").rlike("agg|result|summary")).withColumn("per_concurrency", F.col("name").rlike(r"(conc|[-_]c)[-_]?\d+"))
    wins = files.agg(F.max("per_concurrency").alias("any_"))
    return files.join(F.broadcast(wins)).where(F.col("per_concurrency") | ~F.col("any_")).drop("any_")  # one row


def ragged_csv(lines: DataFrame, header_prefix: str, columns: Sequence[str]) -> DataFrame:
    """A CSV whose header is the first line that begins with a prefix. Short rows get nulls, the surplus cells of long
    ones are joined into the last column, and the physical line number stays. Cells hold no quoted line ends."""
    head = lines.where(F.col("value").startswith(header_prefix)).agg(F.min("line_no").alias("head_"))
    body = lines.join(F.broadcast(head)).where((F.col("line_no") > F.col("head_")) & (F.trim("value") != ""))  # one row
    cells = F.regexp_extract_all("value", F.lit(r'(?:^|,)((?:"(?:[^"]|"")*"|[^,]*))'), 1)
    plain = F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(c, '^"(.*)"$', "$1"), '""', '"'))
    n = len(columns)
    at = lambda i: F.try_element_at(F.col("cells"), F.lit(i + 1))
    last = F.when(F.size("cells") > n, F.array_join(F.slice("cells", n, F.size("cells")), ",")).otherwise(at(n - 1))
    return body.withColumn("cells", plain).select("line_no", *(at(i).alias(c) for i, c in enumerate(columns[:-1])), last.alias(columns[-1]))


BLOCK, WHOLE_BYTES = 512, 64 << 20


class _Blocks(io.RawIOBase):
    """A stream over blocks that an iterator gives; it holds one block and what is asked for."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.rest = blocks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        self.rest = self.rest or next(self.blocks, b"")
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _archive_lines(name: str, data: io.RawIOBase, suffixes: tuple[str, ...]) -> Iterator[tuple[str, str, int, str]]:
    """The lines of an archive's log members, member by member, never going back."""
    with tarfile.open(fileobj=io.BufferedReader(data, 1 << 20), mode="r|*") as tar:
        for member in tar:
            if member.isfile() and member.name.endswith(suffixes):
                for k, raw in enumerate(tar.extractfile(member), 1):
                    yield name, member.name, k, re.sub(ANSI, "", raw.decode("utf-8", "replace").rstrip("\r\n"))


def log_lines(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".out", ".log"), whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """archive, member, line_no and line of the log members of tar archives; colour codes go, bad bytes are replaced.
    An archive is read by one task from its first member to its last, since a member's place follows from those before.
    Up to whole_bytes its content is one value; a larger one (.tar, .tar.gz, .tar.bz2), of any size, comes in blocks of
    512 bytes, of which few are held. Other large archives are an error."""
    schema = "archive string, member string, line_no long, line string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = _archive_lines(name, io.BytesIO(content.as_buffer()), suffixes)
                while rows := list(itertools.islice(found, 10_000)):
                    yield _lines(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").option("recursiveFileLookup", True).load(path)
    out = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(read, schema)
    for row in files.where(F.col("length") > whole_bytes).select("path").toLocalIterator():  # names, not contents
        if not row.path.endswith((".tar", ".tar.gz", ".tar.bz2")):
            raise ValueError(f"no stream of blocks from {row.path}")
        out = out.unionByName(spark.createDataFrame(_streamed(spark, row.path, suffixes), schema))
    return out


def _streamed(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> RDD:
    """Rows of one archive, read as fixed blocks in one split; Spark decompresses on the way."""
    plain = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)  # the setting holds patterns, between commas
    conf = {
        "fixedlengthinputformat.record.length": str(BLOCK),
        "mapreduce.input.fileinputformat.split.minsize": str((1 << 63) - 1),
        "mapreduce.input.fileinputformat.inputdir": re.sub(r"([\\,])", r"\\\1", plain),
    }
    blocks = spark.sparkContext.newAPIHadoopRDD(
        "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf
    )
    return blocks.mapPartitions(lambda part: _archive_lines(path, _Blocks(bytes(b) for _, b in part), suffixes))


def _lines(rows: list[tuple[str, str, int, str]]) -> pa.RecordBatch:
    archives, members, numbers, texts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(archives), pa.array(members), pa.array(numbers, pa.int64()), pa.array(texts)], names=["archive", "member", "line_no", "line"])


_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"')
_OPENS = re.compile(r'^\s*"((?:[^"\\]|\\.)*)"\s*:\s*\{')


def _split_scan(lines: Iterator[str], wanted: Callable[[str], bool]) -> dict:
    """What one split says without knowing the others: its lines, its change of depth, where each new lowest depth was
    reached, and the wanted keys with their depth and last line (None: in a later split). Depths are relative. A JSON
    string holds no raw line end, so that every line begins outside of strings."""
    depth, lowest, n = 0, 0, 0
    falls: list[tuple[int, int]] = []
    found: list[list] = []
    open_: list[int] = []
    for n, line in enumerate(lines, 1):
        plain = _STRINGS.sub("", line)
        key = _OPENS.match(line)
        if key and wanted(json.loads(f'"{key[1]}"')):
            open_.append(len(found))
            found.append([json.loads(f'"{key[1]}"'), n, depth, None])
        depth += plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")
        while open_ and depth <= found[open_[-1]][2]:
            found[open_.pop()][3] = n
        if depth < lowest:
            lowest = depth
            falls.append((depth, n))
    return {"n": n, "delta": depth, "falls": falls, "found": found}


def _spans(splits: list[tuple[int, dict]]) -> list[tuple[str, int, int, int, int]]:
    """(name, first split, its line, last split, its line) of the wanted objects of one file: depths of the splits before
    are summed, and an object that its own split doesn't end ends where a later one first falls to its depth."""
    before = list(itertools.accumulate((s["delta"] for _, s in splits), initial=0))
    out = []
    for k, (at, s) in enumerate(splits):
        for name, line, depth, end in s["found"]:
            last = (at, end) if end is not None else next(((b, n) for j, (b, t) in enumerate(splits[k + 1 :], k + 1) for d, n in t["falls"] if before[j] + d <= before[k] + depth), None)
            if last is None:
                raise ValueError(f"object {name} has no end")
            out.append((name, at, line, *last))
    return out


def named_objects(spark: SparkSession, path: str, names: Sequence[str], prefix: bool = False) -> DataFrame:
    """name and value (JSON text) of the first object under each wanted key of a pretty-printed JSON file, of whatever
    size and at whatever depth. prefix: every key that begins with one of names is wanted.

    The file is read twice, whatever the number of names, and by many tasks: once for the depth at which each split
    begins and for the wanted keys, once for their text. The driver gets some numbers for each split. An object wanted
    must fit into a task; a name that isn't there is an error, unless it is a prefix.
    """
    exact, starts = frozenset(names), tuple(names)
    wanted = (lambda key: key.startswith(starts)) if prefix else exact.__contains__
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")

    def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
        rows = ((f, a, v) for b in batches for f, a, v in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
        for key, part in itertools.groupby(rows, key=lambda r: r[:2]):
            yield key, (r[2] for r in part)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, at), part in by_split(batches):
            yield pa.RecordBatch.from_pydict({"file": [file], "at": [at], "said": [json.dumps(_split_scan(part, wanted))]}, pa.schema([("file", pa.string()), ("at", pa.int64()), ("said", pa.string())]))

    files: dict[str, list[tuple[int, dict]]] = {}
    for r in lines.mapInArrow(scan, "file string, at long, said string").toLocalIterator():
        files.setdefault(r.file, []).append((r.at, json.loads(r.said)))
    first: dict[str, tuple] = {}
    for file in sorted(files):
        for span in sorted(_spans(sorted(files[file], key=lambda x: x[0])), key=lambda x: x[1:3]):
            first.setdefault(span[0], (file, *span[1:]))
    if not prefix and exact - set(first):
        raise ValueError(f"{path} has no object {', '.join(sorted(exact - set(first)))}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, at), part in by_split(batches):
            held = {name: s for name, s in first.items() if s[0] == file and s[1] <= at <= s[3]}
            texts: dict[str, list[str]] = {name: [] for name in held}
            for n, line in enumerate(part if held else (), 1):
                for name, (_, a, from_line, b, to_line) in held.items():
                    if (at, n) >= (a, from_line) and (at, n) <= (b, to_line):
                        texts[name].append(_OPENS.sub("{", line, count=1) if (at, n) == (a, from_line) else line)
            for name, text in texts.items():
                if text:
                    yield pa.RecordBatch.from_pydict({"name": [name], "at": [at], "text": ["\n".join(text)]}, pa.schema([("name", pa.string()), ("at", pa.int64()), ("text", pa.string())]))

    pieces = lines.mapInArrow(cut, "name string, at long, text string").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    value = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return pieces.select("name", F.regexp_replace(value, r"(?s)\}[^}]*$", "}").alias("value"))


def phase_window(spark: SparkSession, path: str, phase: str = "profiling") -> DataFrame:
    """start_ns and end_ns of a phase from the summary object of a metrics file: one row, nulls for an absent phase."""
    v = F.try_parse_json("value")
    at = lambda side: F.try_variant_get(v, f"$.phase_time_ranges.{phase}.{side}_ns", "long").alias(f"{side}_ns")
    return named_objects(spark, path, ["summary"]).select(at("start"), at("end"))


SERIES = "struct<description:string, series:array<struct<endpoint_url:string, labels:map<string,string>, stats:map<string,double>, timeslices:array<struct<start_ns:bigint, end_ns:bigint, avg:double, last:double, max:double, min:double>>>>>"


def time_slices(objects: DataFrame) -> DataFrame:
    """Labelled gauge samples of metric objects: metric, endpoint_url, labels, start_ns, end_ns and values."""
    s = objects.select(F.col("name").alias("metric"), F.from_json("value", SERIES).alias("o")).select("metric", F.explode("o.series").alias("s"))
    return s.select("metric", "s.endpoint_url", "s.labels", F.explode("s.timeslices").alias("t")).select("metric", "endpoint_url", "labels", "t.*")


def series_stats(objects: DataFrame, quantiles: Sequence[str] = ("p50", "p90", "p95", "p99")) -> DataFrame:
    """Exported statistics of each series; a histogram's quantiles are its estimates, under p50_estimate and so on."""
    s = objects.select(F.col("name").alias("metric"), F.from_json("value", SERIES).alias("o")).select("metric", F.explode("o.series").alias("s"))
    q = lambda n: F.coalesce(F.try_element_at("s.stats", F.lit(n)), F.try_element_at("s.stats", F.lit(f"{n}_estimate"))).alias(n)
    return s.select("metric", "s.endpoint_url", "s.labels", F.try_element_at("s.stats", F.lit("avg")).alias("avg"), *(q(n) for n in quantiles))


def run_config(text: str) -> dict:
    """A small YAML subset (nested mappings, lists, scalars) from a config text, for the driver only."""
    try:
        import yaml
    except ImportError:
        return _plain_config(text)
    return yaml.safe_load(text) or {}


def _plain_config(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    lines = [ln.split(" #")[0].rstrip() for ln in text.splitlines() if ln.strip() and not ln.lstrip().startswith("#")]
    scalar = lambda v: {"true": True, "false": False, "null": None, "~": None}.get(v, int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d+\.\d+", v) else v.strip("'\""))
    for k, line in enumerate(lines):
        depth, body = len(line) - len(line.lstrip()), line.strip()
        while depth <= stack[-1][0]:
            stack.pop()
        holder = stack[-1][1]
        if body.startswith("- "):
            holder.append(scalar(body[2:].strip()))
            continue
        name, _, value = body.partition(":")
        if value.strip():
            holder[name.strip()] = scalar(value.strip())
        else:
            listed = k + 1 < len(lines) and lines[k + 1].strip().startswith("- ")
            holder[name.strip()] = child = [] if listed else {}
            stack.append((depth, child))
    return root
