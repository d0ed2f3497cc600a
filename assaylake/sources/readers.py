"""Readers of measurement, metadata and reference files; everything comes out as a long or row table."""

from __future__ import annotations

import csv
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.common import col
from assaylake.functions import names as N
from assaylake.operators.matching import injection_order

AREA = "Area:"


def _head(spark: SparkSession, path: str, size: int = 1024) -> str:
    """The first characters of a text file, read by Spark so that any file system works."""
    rows = spark.read.text(path).limit(20).collect()
    return "\n".join(r.value for r in rows)[:size]


def sniff_delimiter(text: str) -> str:
    """R2: the delimiter that the csv module recognises, else a tab if there is one, else a comma."""
    try:
        return csv.Sniffer().sniff(text, delimiters=",;\t|").delimiter
    except csv.Error:
        return "\t" if "\t" in text else ","


def _sniffed(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> tuple[str, str]:
    """(delimiter, encoding) of a file, those that are given or what its first bytes tell."""
    if encoding is None:
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("c")).first()
        raw = bytes(head.c) if head else b""
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            encoding = "UTF-16"
        else:
            # A cut in the middle of the last character says nothing about the encoding.
            encoding = "UTF-8" if _decodes(raw) else "ISO-8859-1"
        if sep is None:
            sep = sniff_delimiter(raw.decode(encoding, "replace")[:1024])
    return sep or sniff_delimiter(_head(spark, path)), encoding


def read_text_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """A delimited file with header, all columns as text; UTF-8 unless its bytes aren't, then Latin-1."""
    sep, encoding = _sniffed(spark, path, sep, encoding)
    # Spark splits lines before decoding, so UTF-16 needs whole-file records.
    return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", encoding == "UTF-16").csv(path)


def _decodes(raw: bytes) -> bool:
    for cut in range(4):
        try:
            raw[: len(raw) - cut].decode("utf-8")
            return True
        except UnicodeDecodeError:
            continue
    return False


def _number(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def wide_to_long(df: DataFrame, feature: str, samples: Sequence[str], name: str = "original_col") -> DataFrame:
    """(feature, <name>, value) of the given columns, text that is no number becoming NULL."""
    cols = df.select(col(feature).alias("feature"), *[_number(col(c)).alias(c) for c in samples])
    return cols.unpivot("feature", [col(c) for c in samples], name, "value")


#: A character that no text holds, so that a line is one column.
NO_SEPARATOR = "\ufdd0"


def _fields(line: Column, sep: str) -> Column:
    """The fields of a delimited line as they are written; a delimiter within quotes is none."""
    d = rf"\x{{{ord(sep):x}}}"
    return F.regexp_extract_all(line, F.lit(rf'(?s)(?<=^|{d})(?:"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"(?={d}|\z)|[^{d}]*+)'), F.lit(0))


def _unquoted(field: Column) -> Column:
    """The text of a written field: quotes around it are cut, an empty one is NULL."""
    inner = F.regexp_replace(F.substr(field, F.lit(2), F.length(field) - 2), r'\\(["\\])|"(")', "$1$2")
    quoted = field.startswith(F.lit('"')) & field.endswith(F.lit('"')) & (F.length(field) > 1)
    return F.when(quoted, inner).when(field != "", field)


def _column_names(fields: Sequence[str | None]) -> list[str]:
    """Names for the fields of a header as Spark gives them: a name without text or of several columns gets its position."""
    often = Counter(c.lower() for c in fields if c)
    return [f"_c{i}" if not c else f"{c}{i}" if often[c.lower()] > 1 else c for i, c in enumerate(fields)]


def read_wide_lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(column names, rows of an array ``fields`` of written fields) of a delimited file with header and any number of columns.

    Spark's own reader ends at 20,480 columns, and plans grow with them; here a line is one value, so the plan is the same for any
    width. A line that equals the header is one, as in each part of a folder. Short lines are filled up.
    """
    sep, encoding = _sniffed(spark, path)
    lines = spark.read.option("sep", NO_SEPARATOR).option("quote", "").option("encoding", encoding).option("multiLine", encoding == "UTF-16").schema("line string").csv(path)
    head = lines.select(F.md5("line").alias("hash"), F.transform(_fields(F.col("line"), sep), _unquoted).alias("names")).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    columns = _column_names(head.names)
    rows = lines.where(F.md5("line") != head.hash).select(_fields(F.col("line"), sep).alias("fields"))
    missing = F.greatest(F.lit(len(columns)) - F.size("fields"), F.lit(0))
    return columns, rows.select(F.concat("fields", F.array_repeat(F.lit(""), missing)).alias("fields"))


def _field(columns: Sequence[str], name: str) -> Column:
    return _unquoted(F.get("fields", F.lit(columns.index(name))))


def _cells(rows: DataFrame, columns: Sequence[str], wanted: Callable[[str], bool]) -> DataFrame:
    """(feature, original_col, value) of the wanted columns of rows (feature, fields); text that is no number becomes NULL."""
    # The names of one line, so they may be broadcast.
    names = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns) if wanted(c)], "pos int, original_col string")
    cells = rows.select("feature", F.posexplode("fields").alias("pos", "_text")).join(F.broadcast(names), "pos")
    return cells.select("feature", "original_col", _number(_unquoted(F.col("_text"))).alias("value"))


def read_wide(spark: SparkSession, path: str, threshold: float | None = None, feature: str = "Name", prefix: str = AREA) -> DataFrame:
    """(feature, original_col, sample_id, batch, sample_type, value) of a wide file with one column per injection, any number of them.

    Features without any value above the threshold are left out.
    """
    columns, rows = read_wide_lines(spark, path)
    long = _cells(rows.select(_field(columns, feature).alias("feature"), "fields"), columns, lambda c: c.startswith(prefix))
    c = F.col("original_col")
    sample = N.sample_of(c)
    out = long.select("feature", c, sample.alias("sample_id"), N.batch_of(c).alias("batch"), N.sample_type_of(sample).alias("sample_type"), "value")
    if threshold is None:
        return out
    return out.join(out.groupBy("feature").agg(F.max("value").alias("m")).where(F.col("m") > threshold).select("feature"), "feature", "left_semi")


def read_batch_file(spark: SparkSession, path: str, with_name: bool = True) -> DataFrame:
    """(feature, original_col, value) keyed by name, formula and time, any number of columns; rows without formula are left out, repeats numbered from 2."""
    columns, rows = read_wide_lines(spark, path)
    rt = next(c for c in columns if c.lower().startswith("rt"))
    key = F.concat_ws("_", *([F.coalesce(_field(columns, "Name"), F.lit(""))] if with_name else []), _field(columns, "Formula"), _field(columns, rt))
    rows = rows.where(_field(columns, "Formula").isNotNull()).select("fields", F.monotonically_increasing_id().alias("_at"), key.alias("_key"))
    n = F.row_number().over(Window.partitionBy("_key").orderBy("_at"))
    feature = F.when(n == 1, F.col("_key")).otherwise(F.concat_ws(" ", "_key", n.cast("string")))
    return _cells(rows.select(feature.alias("feature"), "fields"), columns, lambda c: AREA in c)


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(name, injection_order, created) of the earliest run per cleaned file name; dates that can't be read come last."""
    df = read_text_table(spark, path)
    runs = df.select("File Name", F.try_to_timestamp("Creation Date", F.lit("dd-MM-yyyy HH:mm:ss")).alias("created"))
    return injection_order(runs, N.clean_name(F.col("File Name")), "created", keep_date=True).select("name", F.col("at").alias("created"), "injection_order")


def batch_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("_NEG.csv", "_POS.csv")) -> DataFrame:
    """(batch, file) of the input files in the batch folders, on any file system; only names are listed, nothing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("file"))
    name = F.element_at(F.split("file", "/"), -1)
    ends = [F.endswith(name, F.lit(s)) for s in suffixes]
    return found.where(reduce(lambda a, b: a | b, ends)).select(F.element_at(F.split("file", "/"), -2).alias("batch"), "file")


def discover_batches(folder: str, suffixes: Sequence[str] = ("_NEG.csv", "_POS.csv")) -> dict[str, list[str]]:
    """R6, R7 on the driver's own disk: batch folder -> its input files, for folders that have at least one."""
    out = {}
    for d in sorted(p for p in Path(folder).iterdir() if p.is_dir()):
        files = sorted(str(f) for f in d.iterdir() if f.name.endswith(tuple(suffixes)))
        if files:
            out[d.name] = files
    return out


def read_matrix(spark: SparkSession, path: str, labels: Sequence[str], id_column: str | None = None) -> DataFrame:
    """(sample, labels..., feature, value); of repeated samples the first row counts, rows with a missing label are left out."""
    df = read_text_table(spark, path)
    key = id_column or df.columns[0]
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(col(key)).orderBy("_at"))).where("_n = 1")
    rows = rows.select(col(key).alias("sample"), *[_number(col(c)).alias(c) for c in df.columns if c != key])
    for c in labels:
        rows = rows.where(col(c).isNotNull())
    return rows.unpivot(["sample", *map(col, labels)], [col(c) for c in df.columns if c != key and c not in labels], "feature", "value")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, oordeel, classification, non_treated) with missing numbers as NULL; absent columns are NULL."""
    df = read_text_table(spark, path)
    roles = N.header_role(df.columns, {"sample_id": ["monster", "sample"], "oordeel": ["oordeel"], "classification": ["classification"], "non_treated": ["non-treated", "non treated"]})
    get = lambda r: _number(col(roles[r])) if r in roles else F.lit(None).cast("double")
    return df.select(col(roles["sample_id"]).alias("sample_id"), *[get(r).alias(r) for r in ("oordeel", "classification", "non_treated")])


def read_pathway_metabolites(spark: SparkSession, path: str, species: str, names: DataFrame | None = None) -> DataFrame:
    """Distinct (smp_id, pathway_name, hmdb_id, metabolite_name) of one species; rows without accession are left out."""
    df = read_text_table(spark, path, ",")
    missing = {"pathway_id", "hmdb_id", "species"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    name = F.trim("metabolite_name") if "metabolite_name" in df.columns else F.lit(None).cast("string")
    rows = df.where(F.trim("species") == species).select(F.trim("pathway_id").alias("smp_id"), F.upper(F.trim("hmdb_id")).alias("hmdb_id"), name.alias("metabolite_name")).where("hmdb_id <> ''")
    if names is not None:
        rows = rows.join(names.select("smp_id", "pathway_name"), "smp_id", "left")
    else:
        rows = rows.withColumn("pathway_name", F.lit(None).cast("string"))
    return rows.select("smp_id", F.coalesce("pathway_name", "smp_id").alias("pathway_name"), "hmdb_id", "metabolite_name").distinct()


def read_pathway_names(spark: SparkSession, path: str) -> DataFrame:
    """(smp_id, pathway_name, category, species), the first row of each id."""
    df = read_text_table(spark, path, ",")
    roles = N.header_role(df.columns, {"smp_id": ["pathway id", "smpdb id", "smp id", "id"], "pathway_name": ["name", "pathway name"], "category": ["category", "subject"], "species": ["species"]})
    rows = df.select(*[(F.trim(col(roles[r])) if r in roles else F.lit(None).cast("string")).alias(r) for r in ("smp_id", "pathway_name", "category", "species")], F.monotonically_increasing_id().alias("_at"))
    return rows.where("smp_id <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("smp_id").orderBy("_at"))).where("_n = 1").drop("_n", "_at")


def read_pathway_lists(spark: SparkSession, path: str) -> DataFrame:
    """(smp_id, pathway_name, n_compounds, hmdb_ids array)."""
    df = read_text_table(spark, path, "\t")
    ids = F.filter(F.transform(F.split("hmdb_ids", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select("smp_id", "pathway_name", F.col("n_compounds").try_cast("int").alias("n_compounds"), F.coalesce(ids, F.array().cast("array<string>")).alias("hmdb_ids"))


def read_keep_list(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """Distinct names to keep: accession, name and synonyms of at least ``least`` characters."""
    df = read_text_table(spark, path, "\t")
    parts = F.concat(F.array(F.coalesce("HMDB_ID", F.lit("")), F.coalesce("Name", F.lit(""))), F.coalesce(F.split("Synonyms", ";"), F.array().cast("array<string>")))
    return df.select(F.explode(F.transform(parts, lambda x: F.trim(x))).alias("name")).where(F.length("name") >= least).distinct()


def read_compound_xml(spark: SparkSession, path: str, row_tag: str = "metabolite") -> DataFrame:
    """(accession, name, synonyms array) of a compound XML; name spaces don't matter, rows without a proper accession are left out."""
    schema = "accession string, name string, synonyms struct<synonym array<string>>"
    df = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)
    return df.where(F.trim("accession").rlike(r"^HMDB\d+$")).select(F.trim("accession").alias("accession"), F.trim("name").alias("name"), F.coalesce("synonyms.synonym", F.array().cast("array<string>")).alias("synonyms"))


def parse_diseases(df: DataFrame, coded: bool = True) -> DataFrame:
    """(disease, marker, direction, hmdb_ids array, smp_id) of a table with marker and code lists.

    Lists are cut at semicolons outside brackets and zipped by position, the shorter one wins; 'none' entries are left out.
    With ``coded`` false, the markers without a code instead, for the audit of J17.
    """
    roles = N.header_role(df.columns, {"disease": ["disease"], "markers": ["biochemical markers"], "codes": ["hmdb codes"], "smp": ["smpdb code"]})
    markers, codes = N.split_outside(col(roles["markers"])), N.split_outside(col(roles["codes"]))
    n = F.least(F.size(markers), F.size(codes))
    pairs = F.arrays_zip(F.slice(markers, 1, n).alias("m"), F.slice(codes, 1, n).alias("c"))
    rows = df.select(F.trim(col(roles["disease"])).alias("disease"), F.nullif(F.regexp_extract(col(roles["smp"]), r"(SMP\d+)", 1), F.lit("")).alias("smp_id"), F.explode(pairs).alias("p"))
    p = rows.select("disease", "smp_id", F.col("p")["m"].alias("m"), F.col("p")["c"].alias("c")).where(F.lower("m") != "none")
    ids = F.expr(r"regexp_extract_all(c, '(HMDB\\d+)', 1)")
    return p.select("disease", N.marker_name(F.col("m")).alias("marker"), N.marker_direction(F.col("m")).alias("direction"), ids.alias("hmdb_ids"), "smp_id").where((F.size("hmdb_ids") > 0) == F.lit(coded))


def load_run(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a saved run by name; frames of figures are built again from them without scoring anything."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names}


def read_attachments(spark: SparkSession, path: str | None) -> DataFrame:
    """(smp_id, pathway_name, hmdb_id, source); an absent file gives an empty table, rows need an accession and a pathway."""
    schema = "smp_id string, pathway_name string, hmdb_id string, source string"
    at = None if path is None else spark._jvm.org.apache.hadoop.fs.Path(path)
    if at is None or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    df = read_text_table(spark, path, ",")
    get = lambda c: F.nullif(F.trim(col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    out = df.select(get("smp_id").alias("smp_id"), get("pathway_name").alias("pathway_name"), F.upper(get("hmdb_id")).alias("hmdb_id"), get("source").alias("source"))
    return out.where("hmdb_id is not null and (smp_id is not null or pathway_name is not null)")


def cached(spark: SparkSession, build: Any, source: str, folder: str, version: str = "1") -> DataFrame:
    """The table that ``build()`` makes of a source file or folder, kept as Parquet under a key of names, sizes, times and version.

    Both may be on any file system that the executors share.
    """
    stat = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    state = stat.select(F.concat_ws("|", "path", "length", "at").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("s")).first().s
    path = f"{folder.rstrip('/')}/{hashlib.sha256('|'.join([*state, version]).encode()).hexdigest()[:24]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Config:
    """Nested settings with dotted access; a missing or NULL setting gives the default."""

    def __init__(self, values: dict[str, Any] | None = None):
        self.values = values or {}

    @classmethod
    def load(cls, path: str) -> Config:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            return cls(json.loads(text))
        import yaml

        return cls(yaml.safe_load(text))

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or at.get(part) is None:
                return default
            at = at[part]
        return at

    def set(self, key: str, value: Any) -> None:
        *parents, last = key.split(".")
        at = self.values
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def get_list(self, key: str, default: Sequence[Any] = ()) -> list[Any]:
        v = self.get(key)
        return list(default) if v is None else list(v) if isinstance(v, (list, tuple)) else [v]

    def get_float(self, key: str, default: float) -> float:
        v = self.get(key)
        return default if v is None else float(v)


def scorer_options(text: str | dict[str, Any] | None) -> dict[str, Any]:
    """Options given as a mapping, as JSON, or as ``k=v, k=v``."""
    if not text:
        return {}
    if isinstance(text, dict):
        return dict(text)
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict[str, Any] = {}
    for part in filter(None, map(str.strip, re.split(r"[,\n]", text))):
        k, _, v = part.partition("=")
        try:
            out[k.strip()] = json.loads(v.strip().lower() if v.strip().lower() in ("true", "false", "null") else v.strip())
        except json.JSONDecodeError:
            out[k.strip()] = v.strip()
    return out
