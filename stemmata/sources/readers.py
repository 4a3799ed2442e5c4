"""Reading manifests, work documents, records, tables and run metadata, with declared schemas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "chapter string, page string, column string, line string, role string, text string, ref string"
META = "tlg_id string, title string, author string, editor string, publisher string, pub_place string, date string, source_url string, lang string, licence string, source_type string, line_scheme string"
DOCUMENT = f"meta struct<{', '.join(c.replace(' ', ':', 1) for c in META.split(', '))}>, segments array<struct<{', '.join(c.replace(' ', ':', 1) for c in SEGMENT.split(', '))}>>, notes array<string>"
#: a match record (19 columns); the count of j is missing in older files and null then
RECORD = (
    "work_i string, work_j string, era_i string, era_j string, author_i string, author_j string, title_i string, title_j string, score double, chain_len int, "
    "matched_words int, matched_words_j int, n_chained int, ref_i string, ref_j string, word_range_i string, word_range_j string, snippet_i string, snippet_j string"
)
PACKAGE = "work_i string, ref_i string, era_i string, work_j string, ref_j string, era_j string, score double, chain_len int, matched_words int, snippet_i string, snippet_j string, author_i string, author_j string, title_i string, title_j string, tag string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(work_id, era, author, title_latin) from JSON lines, CSV, or YAML where a YAML library is installed."""
    kind = Path(path).suffix
    schema = "tlg_id string, era string, author string, title_latin string"
    if kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML library here; give the manifest as JSON lines or CSV") from e
        works = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        works = works["works"] if isinstance(works, dict) else works
        rows = spark.createDataFrame([tuple(w.get(c) for c in ("tlg_id", "era", "author", "title_latin")) for w in works], schema)
    elif kind == ".csv":
        rows = spark.read.schema(schema).csv(path, header=True)
    else:
        rows = spark.read.schema(schema).json(path)
    return rows.withColumnRenamed("tlg_id", "work_id")


def documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(work_id, seg_pos, chapter, page, column, line, role, text, ref) from work documents; of several files of a work the first by path counts."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())
    first = raw.groupBy("meta.tlg_id").agg(F.min("path").alias("path"))
    chosen = raw.join(first.select("path"), "path", "left_semi")
    return chosen.select(F.col("meta.tlg_id").alias("work_id"), F.posexplode("segments").alias("seg_pos", "s")).select("work_id", "seg_pos", "s.*")


def work_files(spark: SparkSession, root: str, works: DataFrame) -> DataFrame:
    """(work_id, path): of each work (work_id, era) of a manifest the first file by name of ``root``/era/id__*.json; works without a file are left out. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*__*.json").load(root).select("path")
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/([^/]+?)__[^/]*\.json$", k)
    found = files.select(F.url_decode(part(1)).alias("era"), F.url_decode(part(2)).alias("work_id"), "path")
    return works.select("work_id", "era").join(found, ["work_id", "era"]).groupBy("work_id").agg(F.min("path").alias("path"))


def work_documents(spark: SparkSession, root: str, works: DataFrame) -> DataFrame:
    """(work_id, seg_pos, ...) of the works of a manifest, as ``documents``, with the manifest's id; every chosen file is read once."""
    chosen = work_files(spark, root, works)
    paths = [r["path"] for r in chosen.collect()]  # one for each work of the manifest
    if not paths:
        return spark.createDataFrame([], f"work_id string, seg_pos int, {SEGMENT}")
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(paths).withColumn("path", F.col("_metadata.file_path"))
    bare = lambda c: F.url_decode(F.regexp_replace(c, r"^file:/+", "/"))
    named = raw.withColumn("p", bare("path")).join(chosen.select("work_id", bare("path").alias("p")), "p")
    return named.select("work_id", F.posexplode("segments").alias("seg_pos", "s")).select("work_id", "seg_pos", "s.*")


def in_file_order(rows: DataFrame, out: str = "match_id") -> DataFrame:
    """Rows as read from files, with a number in the order of the files by name and of their lines; numbers may have gaps."""
    at = ["__f", "__b"]
    rows = rows.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    ranked = rows.select(*at).distinct().withColumn("__r", F.row_number().over(Window.orderBy(*at)))  # a row for each split of a file
    low = (1 << 33) - 1  # the place inside a partition
    return rows.join(F.broadcast(ranked), at).withColumn(out, F.col("__r").cast("bigint") * (low + 1) + F.col("__m").bitwiseAND(low)).drop(*at, "__m", "__r")


def in_order(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """Records of JSON-lines files with match_id in the order of the files and their lines."""
    return in_file_order(spark.read.schema(schema).json(paths))


def markdown_table(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """The table under a heading of a report: text columns named by the table's head; None of its cells is converted."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=False).collect()]  # a report is a page for readers
    at = next((i for i, line in enumerate(lines) if line.lstrip("# ").strip() == heading), len(lines))
    table = []
    for line in lines[at + 1 :]:
        if line.startswith("|"):
            table.append([c.strip() for c in line.strip().strip("|").split("|")])
        elif table or line.startswith("#"):
            break
    if not table:
        raise ValueError(f"no table under {heading!r}")
    rows = [tuple(r) for r in table[1:] if not all(set(c) <= set("-: ") for c in r)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in table[0]))


def plain_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text): whole text files, to be cut into segments by the importer."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def records(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """Match records from JSON-lines files, one after another, nothing dropped; blank lines are skipped."""
    return spark.read.schema(schema).json(paths)


def table(spark: SparkSession, path: str, schema: str = PACKAGE) -> DataFrame:
    """A tab-separated table with a header, unquoted; an empty field is null."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("encoding", "UTF-8").csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def package_table(spark: SparkSession, folder: str, wp: str) -> DataFrame | None:
    """A package's tagged table, else its clean one, with wp_key and rel_id by file order; None without either."""
    for name in (f"{wp}_tagged.tsv", f"{wp}_clean.tsv"):
        path = f"{folder}/{name}"
        if _exists(spark, path):
            # a package is a curated list; its order is the record's identity
            rows = in_file_order(table(spark, str(path)), "__at")
            number = F.row_number().over(Window.orderBy("__at"))
            return rows.withColumn("wp_key", F.lit(wp)).withColumn("rel_id", F.format_string("rel-%s-%05d", F.lit(wp), number)).drop("__at")
    return None


def all_package_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame | None:
    """The union of the packages that exist."""
    out = None
    for wp in names:
        one = package_table(spark, folder, wp)
        if one is not None:
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def score_scope(table_path: str) -> str:
    """'corpus' or 'call', from the metadata beside a table; 'call' where there is none."""
    p = Path(table_path)
    for candidate in (p.with_suffix(".meta.json"), p.parent / "text_reuse_matches.meta.json", p.parent.parent / "text_reuse_matches.meta.json"):
        try:
            return "corpus" if json.loads(candidate.read_text(encoding="utf-8")).get("corpus_idf") else "call"
        except (OSError, ValueError):
            continue
    return "call"


def fingerprints(spark: SparkSession, pattern: str, digits: int = 16) -> DataFrame:
    """(path, length, sha256): the first ``digits`` of each file's hash."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", "length", F.substring(F.sha2("content", 256), 1, digits).alias("sha256"))
