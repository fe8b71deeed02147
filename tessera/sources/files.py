"""Readers and writers: file inventories, words, profiles, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions import text as T


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, mtime and content digest of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha"))


def spec_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as rows: source_name, text."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("source_name"), F.col("value").alias("text"))


def profiles(spark: SparkSession, builtin: str, user: str | None = None) -> DataFrame:
    """Markdown profiles: name, disciplines, items; a user's profile replaces a built-in of its name."""
    df = spec_texts(spark, builtin).withColumn("rank", F.lit(0))
    if user:
        df = df.unionByName(spec_texts(spark, user).withColumn("rank", F.lit(1)))
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.btrim(F.regexp_extract(front, rf"(?m)^{k}:\s*(.*)$", 1))
    name = F.when(field("name") != "", field("name")).otherwise(F.regexp_replace("source_name", r"\.md$", ""))
    items = F.regexp_extract_all("text", F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1))
    df = df.select(name.alias("name"), F.filter(F.split(F.lower(field("disciplines")), r"[,\s]+"), lambda x: x != "").alias("disciplines"), items.alias("items"), "rank")
    return df.groupBy("name").agg(F.max_by(F.struct("disciplines", "items"), F.col("rank")).alias("p")).select("name", "p.disciplines", "p.items")


class WordsSource(DataSource):
    """``spark.read.format("tessera_words")``: words of page files (JSON lines of page objects), one row each.

    A page file holds lines {"page": n, "words": [[x0, y0, x1, y1, text, block, line, word], …]}."""

    @classmethod
    def name(cls) -> str:
        return "tessera_words"

    def schema(self) -> str:
        return "source_name string, page int, ordinal int, x0 double, y0 double, x1 double, y1 double, text string, block int, line int"

    def reader(self, schema):
        return _WordsReader(self.options)


class _WordsReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")

    def partitions(self):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        files = [path] if where.get_file_info(path).is_file else [x.path for x in where.get_file_info(fs.FileSelector(path)) if x.is_file]
        return [InputPartition(x) for x in sorted(files)]

    def read(self, partition):
        import json

        from pyarrow import fs

        where = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with where.open_input_stream(partition.value) as f:
            data = f.read().decode("utf-8")
        name = partition.value.rsplit("/", 1)[-1]
        for line in data.splitlines():
            if line.strip():
                page = json.loads(line)
                for i, w in enumerate(page["words"]):
                    yield name, int(page["page"]), i, float(w[0]), float(w[1]), float(w[2]), float(w[3]), str(w[4]), int(w[5]), int(w[6])


def write_csv(df: DataFrame, path: str) -> None:
    """Text columns with a leading formula character are defused; header, quoted where needed."""
    safe = [T.csv_safe(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def artifact_name(raw: Column, limit: int = 80) -> Column:
    """Last path component, forbidden and trailing characters neutralised, length-capped."""
    last = F.regexp_extract(raw, r"[^/\\]*$", 0)
    t = F.regexp_replace(F.regexp_replace(last, r'[<>:"|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    t = F.when(t.rlike(r"(?i)^(con|prn|aux|nul|com\d|lpt\d)(\..*)?$"), F.concat(F.lit("_"), t)).otherwise(t)
    return F.when(t == "", F.lit("unnamed")).otherwise(F.left(t, F.lit(limit)))
