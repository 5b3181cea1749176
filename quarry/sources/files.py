"""Documents from folders: Markdown by Spark's text reader, PDF through a parser that is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import layout

#: Parses a file's bytes into pages of words and tables: ``[(words, [(box, rows)])]``, words and boxes as dicts.
Parser = Callable[[bytes], Iterable[tuple[list[dict], list[tuple[dict, list[list[str | None]]]]]]]
DOCUMENT = "source string, page int, knowledge_base string, text string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whichever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def base_name(folder: str) -> str:
    """A folder's knowledge base: its own last component, also for files below it."""
    return folder.rstrip("/").rsplit("/", 1)[-1]


def folders_of(folders: str | list[str]) -> list[str]:
    return [folders] if isinstance(folders, str) else list(folders)


def union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unseen(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Files of a kind that Spark's readers pass over: below the folder, with a name on their way that begins with ``_`` or ``.``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = system.getFileStatus(at).getPath().toString().rstrip("/")
    found, every = [], system.listFiles(at, True)
    while every.hasNext():
        path = every.next().getPath().toString()
        if path.endswith(f".{kind}") and any(x.startswith(".") or (x.startswith("_") and "=" not in x) for x in path.removeprefix(top).split("/")):
            found.append(path)
    return sorted(found)


def contents(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``path, content`` of the files that ``unseen`` finds, read where the tasks run; one that can't be read has no content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                    with system.open_input_stream(at) as f:
                        content = f.read()
                except (OSError, ValueError):  # ValueError: a file system that only Spark knows
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

    return spark.createDataFrame([(p,) for p in unseen(spark, folder, kind)], "path string").mapInArrow(read, "path string, content binary")


def listing(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """``path, kind, knowledge_base, size`` of all PDF and Markdown files below the folders; missing folders are passed over.

    Sort by ``kind`` descending and ``path`` for the order pdf, then md.
    """
    parts = []
    for folder in folders_of(folders):
        if exists(spark, folder):
            for kind in ("pdf", "md"):
                files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(folder)
                parts.append(files.select("path", F.lit(kind).alias("kind"), F.lit(base_name(folder)).alias("knowledge_base"), F.col("length").alias("size")))
                if unseen(spark, folder, kind):
                    parts.append(contents(spark, folder, kind).select("path", F.lit(kind).alias("kind"), F.lit(base_name(folder)).alias("knowledge_base"), F.length("content").cast("long").alias("size")))
    return union(parts, spark, "path string, kind string, knowledge_base string, size long")


def markdown(spark: SparkSession, folders: str | list[str], plain: bool = False) -> DataFrame:
    """One document a Markdown file, without a page; ``plain`` takes the markup off.  A file that can't be read has none."""
    parts = []
    for folder in folders_of(folders):
        if exists(spark, folder):
            files = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
            parts.append(files.select(F.col("_metadata.file_path").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(base_name(folder)).alias("knowledge_base"), F.col("value").alias("text")))
            if unseen(spark, folder, "md"):
                text = F.make_valid_utf8(F.col("content").cast("string"))
                parts.append(contents(spark, folder, "md").where("content IS NOT NULL").select(F.col("path").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(base_name(folder)).alias("knowledge_base"), text.alias("text")))
    out = union(parts, spark, DOCUMENT)
    return out.withColumn("text", unmarked(F.col("text"))) if plain else out


def unmarked(text: Column) -> Column:
    """Markdown without heads, emphasis, rules, code fences and link targets."""
    for pattern, by in ((r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s*```.*$", ""), (r"(?m)^\s*([-*_])(\s*\1){2,}\s*$", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(\*\*|__|\*|`)(\S(?:.*?\S)?)\1", "$2"), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*+]\s+", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def pdf_pages(spark: SparkSession, folders: str | list[str], parse: Parser) -> DataFrame:
    """``source, knowledge_base, page, words, tables, error`` of every page; a file that can't be read is one row with an error."""
    schema = f"source string, knowledge_base string, page int, words {layout.WORDS}, tables array<struct<box:struct<x0:double,top:double,x1:double,bottom:double>,rows:array<array<string>>>>, error string"
    number = pa.float64()
    word = pa.struct([("text", pa.string()), ("x0", number), ("top", number), ("x1", number), ("bottom", number)])
    box = pa.struct([("x0", number), ("top", number), ("x1", number), ("bottom", number)])
    table = pa.struct([("box", box), ("rows", pa.list_(pa.list_(pa.string())))])
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(word), pa.list_(table), pa.string()]
    names = ["source", "knowledge_base", "page", "words", "tables", "error"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    pages = [(row["path"], row["knowledge_base"], n, words, [{"box": b, "rows": r} for b, r in tables], None) for n, (words, tables) in enumerate(parse(row["content"]), 1)]
                except Exception as e:  # a file that can't be read must not end the job
                    pages = [(row["path"], row["knowledge_base"], None, None, None, f"{type(e).__name__}: {e}")]
                if pages:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pages, strict=True), kinds, strict=True)], names)

    parts = []
    for folder in folders_of(folders):
        if exists(spark, folder):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
            parts.append(files.select("path", F.lit(base_name(folder)).alias("knowledge_base"), "content"))
            if unseen(spark, folder, "pdf"):
                parts.append(contents(spark, folder, "pdf").select("path", F.lit(base_name(folder)).alias("knowledge_base"), "content"))
    return union(parts, spark, "path string, knowledge_base string, content binary").mapInArrow(read, schema)


def pdf_documents(pages: DataFrame) -> DataFrame:
    """One document a page that isn't blank: its text outside tables in lines, then its tables."""
    loose = layout.lines(layout.outside(F.col("words"), F.transform("tables", lambda t: t["box"])))
    text = layout.page_text(loose, F.transform("tables", lambda t: layout.markdown(t["rows"])))
    return pages.where("error IS NULL").select("source", "page", "knowledge_base", text.alias("text")).where(F.col("text").rlike(r"\S"))


def pdfplumber_parser(content: bytes) -> list:
    """A parser by pdfplumber, where that is installed."""
    import io

    import pdfplumber

    out = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            words = [{k: (w[k] if k == "text" else float(w[k])) for k in ("text", "x0", "top", "x1", "bottom")} for w in page.extract_words()]
            tables = [(dict(zip(("x0", "top", "x1", "bottom"), map(float, t.bbox), strict=True)), t.extract()) for t in page.find_tables()]
            out.append((words, tables))
    return out


def stream_parser(content: bytes) -> list:
    """A parser by pypdf that keeps the file's own order: one word a line, no tables."""
    import io

    import pypdf

    out = []
    for page in pypdf.PdfReader(io.BytesIO(content)).pages:
        rows = (page.extract_text() or "").split("\n")
        out.append(([{"text": r, "x0": 0.0, "top": 10.0 * k, "x1": 0.0, "bottom": 10.0 * k} for k, r in enumerate(rows)], []))
    return out
