"""Sinks: features, tables, workbooks, manifests, atomic publication."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from collections.abc import Sequence
from datetime import datetime
from itertools import chain
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions.text import excel_column

#: The limits of a sheet.
MOST_COLUMNS, MOST_ROWS, MOST_CHARACTERS = 16384, 1_048_575, 32_767


def feature_lines(df: DataFrame, path: str, geometry: str, properties: Sequence[str]) -> None:
    """One compact feature to a line, in as many files as there are partitions; coordinates may be arrays or JSON text."""
    shape = F.col(geometry)
    if "coordinates" in (names := df.select(geometry).schema[0].dataType.fieldNames()) and df.select(f"{geometry}.coordinates").schema[0].dataType.typeName() == "string":
        shape = F.struct(*((F.parse_json(shape[c]) if c == "coordinates" else shape[c]).alias(c) for c in names))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """A table with a byte order mark before its header, which each file repeats."""
    columns = list(columns or sorted(df.columns))
    df.select(*columns).toDF(f"\ufeff{columns[0]}", *columns[1:]).write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def workbook(df: DataFrame, path: str, metadata: Sequence[Sequence[str]] = ()) -> int:
    """A workbook of a table with a filter, a frozen header and a sheet of metadata; the number of rows.

    Rows are written as they come, so the driver holds one partition at a time. A table over the limits of a sheet is an error. Text that looks like a formula stays text.
    """
    if len(df.columns) > MOST_COLUMNS:
        raise ValueError("too many columns for a sheet")
    def cell(r: int, c: int, value) -> str:
        at = f"{excel_column(c)}{r}"
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value}</v></c>'
        text = str(value)
        if len(text) > MOST_CHARACTERS:
            raise ValueError(f"{at} is too long for a cell")
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def sheet(z: zipfile.ZipFile, name: str, table, extra, view: str = "") -> int:
        """Write rows as they come; the number of rows."""
        n = 0
        with z.open(name, "w", force_zip64=True) as out:
            put = lambda text: out.write(text.encode())
            put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}<sheetData>')
            for n, row in enumerate(table, 1):
                if n > MOST_ROWS + 1:
                    raise ValueError("too many rows for a sheet")
                put(f'<row r="{n}">{"".join(cell(n, c, v) for c, v in enumerate(row, 1))}</row>')
            put(f"</sheetData>{extra(n)}</worksheet>")
        return n

    width = excel_column(max(1, len(df.columns)))
    frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
    # The parts of a workbook and their namespaces, as the format prescribes them.
    main = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Metadata" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{main}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet2.xml"/></Relationships>')
        rows = sheet(z, "xl/worksheets/sheet1.xml", chain([df.columns], df.limit(MOST_ROWS + 1).toLocalIterator()), lambda n: f'<autoFilter ref="A1:{width}{n}"/>', frozen)
        sheet(z, "xl/worksheets/sheet2.xml", metadata, lambda n: "")
    return rows - 1


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file; content is hashed where it is read and not gathered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed."""
    rows = expected.select("path", F.struct("bytes", "sha256").alias("e")).join(found.select("path", F.struct("bytes", "sha256").alias("f")), "path", "full_outer")
    status = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("changed")
    return rows.where(~F.col("e").eqNullSafe(F.col("f"))).select("path", status.alias("status"))


def bundle(spark: SparkSession, files: dict[str, str], data: dict[str, dict], target: str, created_at: str, name: str = "deployment-manifest.json") -> None:
    """A folder with copies of contract files (path inside: source) and a manifest of them and of the datasets, which aren't copied.

    ``data``: for each region its outputs as {path: {bytes, sha256}}. An existing target is refused; it appears by one rename, verified.
    """
    fs, to = _filesystem(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(to):
        raise ValueError(f"{target} exists")
    staging = f"{target}.staging"
    fs.delete(path(staging), True)
    util = spark._jvm.org.apache.hadoop.fs.FileUtil
    for inside, source in files.items():
        where = path(f"{staging}/content/{_inside(inside)}")
        fs.mkdirs(where.getParent())
        from_fs, source_path = _filesystem(spark, source)
        util.copy(from_fs, source_path, fs, where, False, spark._jsc.hadoopConfiguration())
    found = {_below(r["path"], staging): {"bytes": r["bytes"], "sha256": r["sha256"]} for r in manifest(spark, f"{staging}/content").collect()}
    content = {"schema_version": 1, "created_at": created_at, "files": found, "data": data}
    stream = fs.create(path(f"{staging}/{name}"), True)
    stream.write(bytearray(json.dumps(content, ensure_ascii=False, sort_keys=True).encode()))
    stream.close()
    verify_bundle(spark, staging, name=name)
    if not fs.rename(path(staging), to):
        raise OSError(f"{target} can't be published")


def _inside(relative: str) -> str:
    if relative.startswith("/") or ".." in relative.split("/") or not relative:
        raise ValueError(f"not a path inside a folder: {relative}")
    return relative


def _below(found: str, folder: str) -> str:
    """A file's path below a folder; schemes may differ."""
    plain = lambda p: p.split(":", 1)[-1].lstrip("/") if ":" in p else p.lstrip("/")
    return plain(found).split(f"{plain(folder).rstrip('/')}/", 1)[1]


def verify_bundle(spark: SparkSession, target: str, data_root: str | None = None, name: str = "deployment-manifest.json") -> dict:
    """The manifest of a bundle whose files are exactly those it lists, byte for byte; with ``data_root``, the regions' datasets too. Else an error."""
    content = json.loads(spark.read.text(f"{target}/{name}", wholetext=True).first()[0])
    if set(content) != {"schema_version", "created_at", "files", "data"} or content["schema_version"] != 1:
        raise ValueError("the manifest has unknown fields")
    if datetime.fromisoformat(content["created_at"]).tzinfo is None:
        raise ValueError("created_at needs a time zone")

    def compare(folder: str, listed: dict, prefix: str) -> None:
        for inside, record in listed.items():
            if set(record) != {"bytes", "sha256"} or not isinstance(record["bytes"], int) or isinstance(record["bytes"], bool) or record["bytes"] < 0 or not re.fullmatch("[0-9a-f]{64}", str(record["sha256"])):
                raise ValueError(f"not a record of a file: {_inside(inside)}")
        found = manifest(spark, folder).collect() if _exists(spark, folder) else []
        rows = {_below(r["path"], folder): {"bytes": r["bytes"], "sha256": r["sha256"]} for r in found}
        own = {i[len(prefix) :]: r for i, r in listed.items()}
        for what, names in (("missing", own.keys() - rows.keys()), ("unexpected", rows.keys() - own.keys()), ("changed", {i for i in own.keys() & rows.keys() if own[i] != rows[i]})):
            if names:
                raise ValueError(f"{what} in {folder}: {sorted(names)[:5]}")

    compare(f"{target}/content", content["files"], "content/")
    if data_root is not None:
        for region, outputs in content["data"].items():
            compare(f"{data_root}/{_inside(region)}", outputs, "")
    return content


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.exists(where)


def config_hash(config: dict, ignored: Sequence[str] = ("lifecycle",)) -> str:
    """SHA-256 of a configuration in canonical form."""
    kept = {k: v for k, v in config.items() if k not in ignored}
    return hashlib.sha256(json.dumps(kept, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def publish(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> None:
    """Write all tables beside the target, then put them in its place by renaming; the old state returns if that fails.

    Between the two renames there is no target; readers that can't wait go by a pointer, see :func:`point_to`.
    """
    staging, backup = f"{target}.staging", f"{target}.backup"
    fs, to = _filesystem(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in (staging, backup):
        fs.delete(path(p), True)
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    old = fs.exists(to)
    if old and not fs.rename(to, path(backup)):
        raise OSError(f"{target} can't be moved")
    if not fs.rename(path(staging), to):
        if old:
            fs.rename(path(backup), to)
        raise OSError(f"{target} can't be published")
    fs.delete(path(backup), True)


def point_to(spark: SparkSession, pointer: str, dataset: str) -> None:
    """Make a dataset, if it is there, the current one: the pointer is a file of one line, replaced by one rename, so that it is never missing."""
    fs, _ = _filesystem(spark, dataset)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(path(dataset)):
        raise ValueError(f"no such dataset: {dataset}")
    new = path(f"{pointer}.new")
    stream = fs.create(new, True)
    stream.write(bytearray(dataset.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    option = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(option, 1)
    how[0] = option.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, path(pointer), how)
