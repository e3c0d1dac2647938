"""File sources and sinks: front-matter Markdown, JSON lines, sealed bundles and indexes, project folders, archives, reports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions import text
from tessera.operators.relational import collated
from tessera.operators.stages import filesystem


def front_matter(spark: SparkSession, path: str, scalars: list[str], lists: list[str], id_key: str | None = None, redact: bool = False) -> DataFrame:
    """Markdown files with a ``---`` head of ``key: value`` lines; ``lists`` are JSON arrays of strings.

    ``error`` names a missing head, unknown or repeated keys, and an ``id_key``
    value that another file has too.  With ``redact``, personal data in scalars
    and content is masked.  Sort by ``path`` for the order of code points.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda s: F.trim(s) != ""), lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("v")))
    parsed = raw.withColumn("pairs", pairs)
    keys = F.transform("pairs", lambda p: p["k"])
    known = F.array(*[F.lit(k) for k in [*scalars, *lists]])
    error = F.when(head == "", "NO_HEAD").when(F.size(F.array_distinct(keys)) < F.size(keys), "REPEATED_KEY").when(F.size(F.array_except(keys, known)) > 0, "UNKNOWN_KEY")
    clean = text.redact if redact else lambda c: c

    def value_of(key: str) -> Column:
        return F.try_element_at(F.transform(F.filter("pairs", lambda p: p["k"] == key), lambda p: p["v"]), F.lit(1))

    cols = [value_of(k) for k in [*scalars, *lists]]
    named = [clean(c).alias(k) if k in scalars else F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(k) for k, c in zip([*scalars, *lists], cols, strict=True)]
    out = parsed.select("path", *named, clean(F.regexp_replace(F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", ""), r"\A\s+|\s+\z", "")).alias("content"), error.alias("error"))
    if id_key is None:
        return out
    twice = out.groupBy(id_key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(id_key, F.lit("REPEATED_ID").alias("_e"))
    return out.join(twice, id_key, "left").select(*[F.coalesce("error", "_e").alias("error") if c == "error" else c for c in out.columns])


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by a schema; a line that doesn't follow it keeps its text in ``_corrupt_record``."""
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def json_line_faults(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``line, fault`` of the lines that are no rows: blank ones, those that aren't JSON, and those of another shape (unknown keys, missing or unfit values)."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    row = F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    unknown = F.size(F.array_except(F.json_object_keys("line"), F.array(*[F.lit(f.name) for f in schema.fields]))) > 0
    missing = [row[f.name].isNull() for f in schema.fields if not f.nullable]
    unfit = row["_corrupt_record"].isNotNull() | F.coalesce(unknown, F.lit(True))
    for m in missing:
        unfit = unfit | m
    fault = F.when(F.trim("line") == "", "BLANK_LINE").when(F.try_parse_json("line").isNull(), "BAD_JSON").when(unfit, "SCHEMA_MISMATCH")
    return lines.select("line", fault.alias("fault")).where("fault is not null")


def content_digest(rows: DataFrame, columns: Sequence[str]) -> str:
    """A digest of a table's content: row digests are summed in eight words, so no order and no single task is needed."""
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *words).first()
    return f"{got['n']}:" + ":".join(str(got[f"w{i}"] or 0) for i in range(8))


def sealed_rows(rows: DataFrame, digest: str, columns: list[str]) -> bool:
    """Does the content of ``columns`` have this digest; order and partitions don't matter."""
    return content_digest(rows, columns) == digest


def publish(rows: DataFrame, path: str) -> str:
    """Writes ``rows`` as a sealed index at ``path`` that is there whole or not at all; returns its digest.

    Rows and the ``DONE`` marker, which holds the digest of what was written,
    go to a folder beside it, which is renamed at the end.  A ``path`` that
    exists is refused.
    """
    spark = rows.sparkSession
    fs, target = filesystem(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows.write.parquet(f"{staging}/rows")
    digest = content_digest(spark.read.schema(rows.schema).parquet(f"{staging}/rows"), rows.columns)
    spark.createDataFrame([(json.dumps({"columns": rows.columns, "digest": digest}),)], "value string").coalesce(1).write.text(f"{staging}/DONE")
    if not fs.rename(filesystem(spark, staging)[1], target):
        raise OSError(f"could not rename {staging}")
    return digest


def sealed_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of :func:`publish`, or None if the marker is missing or the content isn't the one that it seals."""
    fs, done = filesystem(spark, f"{path.rstrip('/')}/DONE")
    if not fs.exists(done):
        return None
    seal = json.loads(spark.read.text(f"{path.rstrip('/')}/DONE").first()["value"])
    rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
    if sorted(rows.columns) != sorted(seal["columns"]) or content_digest(rows, seal["columns"]) != seal["digest"]:
        return None
    return rows


def bundle_faults(spark: SparkSession, folder: str, manifest: str = "manifest.json") -> DataFrame:
    """``file, fault`` of a bundle whose manifest lists ``files`` of ``name`` and ``sha256``: MISSING, CHANGED or UNLISTED files, and NOT_DONE without a ``DONE.json``."""
    found = spark.read.format("binaryFile").load(f"{folder}/*").select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("got"))
    listed = spark.read.schema("files array<struct<name: string, sha256: string>>").option("multiLine", "true").json(f"{folder}/{manifest}")
    want = listed.select(F.explode("files").alias("f")).select(F.col("f.name").alias("file"), F.col("f.sha256").alias("want"))
    own = found.where(~F.col("file").isin(manifest, "DONE.json"))
    fault = F.when(F.col("got").isNull(), "MISSING").when(F.col("want").isNull(), "UNLISTED").when(F.col("got") != F.col("want"), "CHANGED")
    faults = own.join(want, "file", "full_outer").select("file", fault.alias("fault")).where("fault is not null")
    done = found.where("file = 'DONE.json'").agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("DONE.json").alias("file"), F.lit("NOT_DONE").alias("fault"))
    return faults.unionByName(done)


def bundle_table(spark: SparkSession, folder: str, table: str, schema: StructType, rows: str = "rows.jsonl") -> DataFrame:
    """The rows of one table of a bundle whose lines are ``{"table": .., "row": {..}}``."""
    lines = spark.read.schema(StructType([StructField("table", StringType()), StructField("row", schema)])).option("mode", "FAILFAST").json(f"{folder}/{rows}")
    return lines.where(F.col("table") == table).select("row.*")


# Project folders: one text file a node, with its inputs, and one beside it with its parameters.

#: Node families that are told apart; all others are OTHER.  Fixed values.
FAMILIES = ("COMP", "TOP", "CHOP", "SOP", "POP", "MAT", "DAT")
#: Beginnings of parameter names that say nothing, parts and endings of those that matter, and marks of an expression.
NOISE = ("pageindex", "w", "h", "resizecomp", "repocomp", "border", "parentshortcut", "clone", "ext[0-9]", "opviewer", "viewer", "display", "pickable", "render", "cooktype", "nodecolorr", "nodecolorg", "nodecolorb")
IMPORTANT = ("instance", "input", "output", "file", "resolution", "res", "rows", "cols", "amp", "period", "gain", "offset", "rotate", "scale", "translate", "feedback", "noise", "font", "text")
IMPORTANT_ENDS = ("top", "sop", "chop", "tx", "ty", "tz", "r", "g", "b")
EXPRESSIONS = ("absTime", r"me\.", r"op\(", r"parent\(", r"chop\(", "curTime", "python", "expr")


def project_nodes(spark: SparkSession, root: str, most: int = 10) -> DataFrame:
    """Nodes of an expanded project: ``path, folder, name, family, kind, inputs, parameters, n_parameters, signature``.

    ``inputs`` are structs of place and source as written, ``parameters`` the
    first ``most`` that matter as structs of name and value: expressions count
    four points and telling names two, equal ones go by the alphabet; names that
    say nothing are left out, local paths hidden.  The folders ``local`` and ``perform`` are left out.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{n,parm}")
    rel = F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{re.escape(root.rstrip('/').removeprefix('file://'))}/", "")
    files = raw.select(rel.alias("rel"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    own = files.where(F.col("rel").endswith(".n")).select(F.regexp_replace("rel", r"\.n$", "").alias("path"), F.col("value").alias("body"))
    own = own.where(~F.col("path").rlike(r"^(local|perform)(/|$)") & F.col("body").rlike(r"^\s*[^:\n]+:.+"))
    parms = files.where(F.col("rel").endswith(".parm")).select(F.regexp_replace("rel", r"\.parm$", "").alias("path"), F.col("value").alias("parm"))
    both = own.join(parms, "path", "left").withColumn("parm", F.coalesce("parm", F.lit("")))
    family = F.trim(F.regexp_extract("body", r"^\s*([^:\n]+):", 1))
    block = F.regexp_extract("body", r"(?s)(?:^|\n)\s*inputs\s*\n(.*?)(?:\n\s*(?:\}|end)|$)", 1)
    place, source = (F.regexp_extract_all(block, F.lit(r"(?m)^\s*(\d+)\s+\"?([^\"\n]+?)\"?\s*$"), i) for i in (1, 2))
    name, value = (F.regexp_extract_all("parm", F.lit(r"(?m)^[ \t]*(\S+)[ \t]+\d+[ \t]+(.*)$"), i) for i in (1, 2))
    inputs = F.zip_with(place, source, lambda p, s: F.struct(p.cast("int").alias("place"), s.alias("source")))
    some = lambda c, words: c.rlike("(?i)(?:" + "|".join(words) + ")")
    points = lambda n, v: some(v, EXPRESSIONS).cast("int") * 4 + (some(n, IMPORTANT) | n.rlike("(?i)(?:" + "|".join(IMPORTANT_ENDS) + ")$")).cast("int") * 2
    given = F.zip_with(name, value, lambda n, v: F.struct((-points(n, v)).alias("rank"), collated(n, "zh-CN").alias("place"), n.alias("name"), F.substring(text.without_local_paths(v), 1, 240).alias("value")))
    kept = F.filter(given, lambda p: ~p["name"].rlike("(?i)^(?:" + "|".join(NOISE) + ")"))
    params = F.transform(F.slice(F.array_sort(kept), 1, most), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))
    return both.select(
        "path", text.dirname(F.col("path")).alias("folder"), text.basename(F.col("path")).alias("name"), F.when(family.isin(*FAMILIES), family).otherwise("OTHER").alias("family"),
        F.trim(F.regexp_extract("body", r"^\s*[^:\n]+:([^\n]+)", 1)).alias("kind"), inputs.alias("inputs"), params.alias("parameters"), F.size(name).alias("n_parameters"),
        F.sha2(F.concat_ws("\n", "body", "parm"), 256).alias("signature"),
    )


def project_edges(nodes: DataFrame) -> DataFrame:
    """``source, target`` of all inputs that lead to a node."""
    given = nodes.select("path", "folder", F.explode("inputs").alias("i"))
    made = given.select(text.joined_path(F.col("folder"), F.col("i.source")).alias("source"), F.col("path").alias("target"))
    return made.join(nodes.select(F.col("path").alias("source")), "source", "left_semi").select("source", "target")


def archive_members(spark: SparkSession, path: str, ending: str | None = None) -> DataFrame:
    """``archive, member, bytes`` of zip archives, listed without unpacking; a file that is no archive has one row without a member."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                        found = [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    found = [(None, None)]
                yield pa.RecordBatch.from_pydict({"archive": [name] * len(found), "member": pa.array([x[0] for x in found], pa.string()), "bytes": pa.array([x[1] for x in found], pa.int64())})

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "archive string, member string, bytes long")
    return out if ending is None else out.where(F.col("member").endswith(ending))


def markdown_report(rows: DataFrame, title: str, order: Sequence[str | Column], most: int = 1000) -> str:
    """A small table as Markdown; more rows than ``most`` are refused, as a report is read by people."""
    made = rows.orderBy(*order).limit(most + 1).collect()
    if len(made) > most:
        raise ValueError(f"a report of more than {most} rows")

    def cell(v: object) -> str:
        return "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    return "\n".join([*head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in made)]) + "\n"
