"""Notes on disk, and sinks that write them or reports back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import basename


def _files(spark: SparkSession, root: str):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)


def read_vault(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, basename, content, mtime, size) of all *.md files below root, without those below excluded folders."""
    rows = list_vault(spark, root, exclude, _content=True)
    return rows.select("path", "basename", "content", "mtime", "size")


def list_vault(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), _content: bool = False) -> DataFrame:
    """The same without contents: only metadata is read."""
    df = _files(spark, root)
    path = F.regexp_replace("path", "^file:/+", "/")
    cols = [path.alias("path"), basename(path).alias("basename"), (F.unix_millis("modificationTime")).alias("mtime"), F.col("length").alias("size")]
    if _content:
        cols.append(F.decode("content", "UTF-8").alias("content"))
    rows = df.select(*cols)
    for d in exclude:
        rows = rows.where(~F.col("path").contains(f"/{d}/"))
    return rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files, compressed or not."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a word2vec text file; the header, two numbers, isn't one."""
    return read_lines(spark, path).where(~F.col("line").rlike(r"^\d+ \d+$")).select(F.element_at(F.split("line", " "), 1).alias("word")).where("word <> ''")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(concept) of every English concept reference in assertion lines."""
    found = F.regexp_extract_all("line", F.lit(r"/c/en/([^/\t\s]+)"), F.lit(1))
    return read_lines(spark, path).select(F.explode(found).alias("concept"))


def read_pages(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """(title, redirect, text) of the pages of an XML dump, plain or bzip2; with max_pages the scan stops there."""
    schema = "title string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    df = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    rows = df.select("title", F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("text"))
    return rows if max_pages is None else rows.limit(max_pages)


def read_abstracts(spark: SparkSession, path: str, tag: str = "doc") -> DataFrame:
    """(abstract) of an XML dump of abstracts: all text inside, that of elements within an abstract too."""
    rows = spark.read.format("xml").option("rowTag", tag).schema("abstract string").load(path)
    return rows.select(F.regexp_replace("abstract", r"</?[A-Za-z_][^<>]*>", "").alias("abstract")).where("abstract is not null")


def read_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """(lemma) of the data files of a lexical database: offset, file, kind, number of words (hexadecimal), then
    each word and its sense; lines of the license begin with blanks. Underscores become spaces."""
    fields = F.split("line", " ")
    n = F.conv(F.get(fields, F.lit(3)), 16, 10).cast("int")
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(fields, 4 + 2 * i))
    rows = read_lines(spark, path).where(F.col("line").rlike(r"^\d{8} \d\d [nvasr] [0-9a-f]{2} "))
    return rows.select(F.explode(words).alias("word")).select(F.regexp_replace(F.replace("word", F.lit("_"), F.lit(" ")), r"\((?:a|p|ip)\)$", "").alias("lemma"))


def first_notes(notes: DataFrame, n: int) -> DataFrame:
    """The first n notes by path, as a sample for timing."""
    return notes.orderBy("path").limit(n)


def read_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Training reports of several runs, one JSON document each: (run, final_mse, metrics_mse, epochs)."""
    schema = "finalValMSE double, finalMetrics struct<mse:double>, epochs array<struct<mse:double,dead:long>>"
    df = spark.read.schema(schema).option("multiLine", True).json(paths)
    return df.select(F.input_file_name().alias("run"), F.col("finalValMSE").alias("final_mse"), F.col("finalMetrics.mse").alias("metrics_mse"), "epochs")


def write_corpus(lines: DataFrame, path: str) -> None:
    """Sorted distinct lines as text files, in order over the files."""
    lines.select("line").distinct().orderBy("line").write.mode("overwrite").text(path)


def headline(reports: DataFrame, warm: str = "warm_p50", cold: str = "cold_p50") -> DataFrame:
    """Configurations by their warm median, or the cold one where there is no warm pass, fastest first."""
    return reports.orderBy(F.coalesce(warm, cold), *[c for c in reports.columns if c not in (warm, cold)])


def markdown_table(df: DataFrame) -> str:
    """A report as a Markdown table, all rows of df, read one partition at a time."""
    cols = df.columns
    rows = [[("" if v is None else str(v)) for v in r] for r in df.toLocalIterator()]
    return "\n".join(["| " + " | ".join(r) + " |" for r in [cols, ["---"] * len(cols), *rows]]) + "\n"


def write_report(df: DataFrame, path: str) -> None:
    """A report of any size as JSON lines."""
    df.write.mode("overwrite").json(path)
