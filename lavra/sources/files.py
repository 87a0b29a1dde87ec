"""Case files: listing, hashing, and reading of HTML, text and stored records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lavra.functions.text import clean_breaks

# Extensions read, lines of a page of text, tags whose content is no text.
SUPPORTED = {".pdf": "pdf", ".html": "html", ".htm": "html", ".txt": "txt"}
LINES_PER_PAGE = 150
SILENT = {"script", "style", "noscript", "template"}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The files under a folder: caminho (relative), nome, extensao, tipo (null: not supported), tamanho, modificado,
    content. Office leftovers (~$) and hidden files are passed over; a column that isn't used isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = re.escape(folder.rstrip("/"))
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), rf"^.*?{root}/", "")
    rows = files.select(path.alias("caminho"), F.col("length").alias("tamanho"), F.col("modificationTime").alias("modificado"), "content")
    rows = rows.withColumn("nome", F.element_at(F.split("caminho", "/"), -1)).where(~F.col("nome").startswith("~$") & ~F.col("nome").startswith("."))
    ext = F.lower(F.regexp_extract("nome", r"(\.[^.]+)$", 1))
    kind = F.create_map(*(F.lit(x) for kv in SUPPORTED.items() for x in kv))
    return rows.withColumn("extensao", ext).withColumn("tipo", F.try_element_at(kind, ext))


def with_digest(files: DataFrame) -> DataFrame:
    """`files` with sha256 and documento_id, its first 16 digits."""
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("documento_id", F.substring("sha256", 1, 16))


def decode(content: bytes | None) -> str:
    """UTF-8 with or without a mark, else Windows-1252, else Latin-1, which takes any byte."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return (content or b"").decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title = ""
        self.silent = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT
        self.in_title = tag == "title"
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in SILENT))
        self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.silent and data.strip():
            self.parts.append(data.strip() + "\n")


def html_text(source: str | None) -> tuple[str, str]:
    """Title and text of an HTML document: pieces of text on lines of their own, scripts and styles left out."""
    reader = _Text()
    reader.feed(source or "")
    reader.close()
    lines = [x.strip() for x in "".join(reader.parts).split("\n")]
    return " ".join(reader.title.split()), re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """HTML files as documents of one page: key, n, titulo, texto. `content` is binary or a string."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [html_text(decode(c) if isinstance(c, bytes) else c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * len(read), pa.int32()), pa.array([t for t, _ in read], pa.string()), pa.array([x for _, x in read], pa.string())], names=[key, "n", "titulo", "texto"])

    return files.select(key, content).mapInArrow(run, f"{key} {kind}, n int, titulo string, texto string")


def decoded(files: DataFrame, key: str, content: str) -> DataFrame:
    """Binary text files as strings: key, texto."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(c) for c in batch.column(1).to_pylist()], pa.string())], names=[key, "texto"])

    return files.select(key, content).mapInArrow(run, f"{key} {kind}, texto string")


def text_pages(texts: DataFrame, key: str, text: str, lines: int = LINES_PER_PAGE) -> DataFrame:
    """Texts in pages of `lines` lines: key, n (from 1), primeira, ultima (lines from 1), texto. Null and empty
    texts have none."""
    split = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    rows = texts.where(F.col(text) != "").select(key, split.alias("_l"))
    n = F.ceil(F.size("_l") / F.lit(lines)).cast("int")
    page = rows.select(key, "_l", F.explode(F.sequence(F.lit(1), n)).alias("n"))
    first = (F.col("n") - 1) * lines + 1
    return page.select(key, "n", first.alias("primeira"), F.least(first + lines - 1, F.size("_l")).alias("ultima"), clean_breaks(F.array_join(F.slice("_l", first, lines), "\n")).alias("texto"))


def json_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Stored JSON documents; unreadable ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def log_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An append-only JSONL log with ordem, which sorts as the log was written: by the file's time and name, then by
    place in the file. Lines that can't be read are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    m = F.col("_metadata")
    place = F.struct(m["file_modification_time"].alias("em"), m["file_path"].alias("arquivo"), m["file_block_start"].alias("bloco"), F.monotonically_increasing_id().alias("linha"))
    return rows.select("*", place.alias("ordem"))
