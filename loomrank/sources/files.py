"""Readers and writers of text formats; every reader is one distributed scan with an explicit schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import require_columns
from ..session import scratch  # noqa: F401


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Write several tables as one version below ``path``; they become visible together.

    Each goes to a new folder of the version first; the version counts once its marker
    is in place, which is written last. Readers of an earlier version keep its files.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>").coalesce(1).write.mode("append").json(f"{path}/versions")
    return path


def read_published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the latest version whose marker was committed."""
    marks = spark.read.schema("version string, tables array<string>").json(f"{path}/versions").select("version", "_metadata.file_modification_time")
    last = marks.orderBy(F.desc("file_modification_time"), "version").first()
    return spark.read.parquet(f"{path}/{last['version']}/{name}")


# fixed values: where a predictor puts its confidence files below a root, and how they name the metrics
CONFIDENCE = {
    "protenix": {
        "path": r"([^/]+)/(seed_[^/]*)/predictions/\1_summary_confidence_sample_(\d+)\.json$",
        "keys": {"iptm": "iptm", "ptm": "ptm", "plddt": "plddt"},
    },
    "rf3": {
        "path": r"([^/]+)/seed-\d+_sample-\d+/\1_(seed-\d+)_sample-(\d+)_summary_confidences\.json$",
        "keys": {"iptm": "iptm", "ptm": "ptm", "plddt": "overall_plddt"},
    },
}


def parse_confidence(files: DataFrame, preset: str = "protenix", keys: dict[str, str] | None = None, plddt_scale: float = 1.0) -> DataFrame:
    """``(path, text)`` of JSON files to ``target, seed, sample, iptm, ptm, plddt, json_path``.

    Files whose path does not follow the preset are left out. ``keys`` replaces single
    JSON keys of the preset; what is missing or no number is NULL; ``plddt`` is scaled.
    ``json_path`` begins at the target. ``seed`` is empty where its folder has no number.
    """
    pattern, names = CONFIDENCE[preset]["path"], CONFIDENCE[preset]["keys"] | (keys or {})
    part = [F.regexp_extract("path", pattern, i) for i in range(4)]
    found = files.select("text", *[p.alias(n) for p, n in zip(part, ("json_path", "target", "seed", "sample"), strict=True)]).where("json_path <> ''")
    value = {n: F.get_json_object("text", f"$['{k}']").try_cast("double") for n, k in names.items()}
    value["plddt"] = value["plddt"] * plddt_scale
    return found.select("target", F.regexp_extract("seed", r"seed[_-](\d+)", 1).alias("seed"), "sample", *[value[n].alias(n) for n in ("iptm", "ptm", "plddt")], "json_path")


def read_confidence(spark: SparkSession, root: str, preset: str = "protenix", keys: dict[str, str] | None = None, plddt_scale: float = 1.0) -> DataFrame:
    """All confidence files below ``root``; see :func:`parse_confidence`."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return parse_confidence(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), preset, keys, plddt_scale)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of whole files, each below the 2 GB that one row can hold."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_tsv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("escape", '"').csv(path)
    return path


def read_tsv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """Headered tab-separated table; missing columns fail at once."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return require_columns(df, required or [])


def read_wide_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines of id and numbers to ``(id, vec)``: never one column per number."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("id"), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.try_cast("double")).alias("vec"))


def read_some_vectors(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Like :func:`read_wide_vectors` for given ids: the id is tested before a line is parsed; ids without a line raise."""
    known = spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("id"))
    absent = [r["id"] for r in ids.select("id").distinct().join(known, "id", "left_anti").limit(6).collect()]
    if absent:
        raise ValueError(f"no vectors for {', '.join(sorted(map(str, absent))[:5])}{' and others' if len(absent) > 5 else ''}")
    lines = spark.read.text(path).withColumn("id", F.substring_index("value", "\t", 1)).join(ids, "id", "left_semi")
    parts = F.split("value", "\t")
    return lines.select("id", F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.try_cast("double")).alias("vec"))


def unpack_vectors(df: DataFrame, text: str = "text", out: str = "vec") -> DataFrame:
    """``[1.0, 2.0]`` or blanks between numbers; rows with anything unparseable are dropped."""
    bare = F.trim(F.regexp_replace(text, r"[\[\]]", ""))
    vec = F.transform(F.split(bare, r"[,\s]+"), lambda x: x.try_cast("double"))
    return df.withColumn(out, vec).where(~F.exists(out, lambda x: x.isNull()))


def fasta_text(id_: str, seq: str, width: int = 0):
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else F.col(seq)
    return F.concat(F.lit(">"), id_, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, id_: str = "id", seq: str = "seq", width: int = 0) -> str:
    df.select(fasta_text(id_, seq, width).alias("value")).write.mode("overwrite").text(path)
    return path


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Ids up to the first blank; wrapped lines are joined."""
    rec = spark.read.option("lineSep", "\n>").text(path)
    bare = F.regexp_replace("value", "^>", "")
    return rec.select(F.regexp_extract(bare, r"^(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace(bare, r"^[^\n]*\n?", ""), r"\s+", "").alias("seq")).where("id <> ''")


def read_tasks(spark: SparkSession, root: str, schema: str, key: str = "donor") -> DataFrame:
    """All tables below ``root/<key>=../`` style folders, the folder's name as a column."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("recursiveFileLookup", True).csv(root)
    return df.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), f"{key}=([^/]+)/", 1))


def parse_pdb(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """ATOM records, not HETATM, of the first model; of alternate locations blank wins, then A, then occupancy, then line."""
    lines = files.select(path, F.posexplode(F.split(text, "\r?\n")).alias("line", "l"))
    model_end = lines.where("l like 'ENDMDL%'").groupBy(path).agg(F.min("line").alias("stop"))
    at = lines.where("l like 'ATOM  %'").join(model_end, path, "left").where("stop is null or line < stop")

    def f(a, b):
        return F.trim(F.substring("l", a, b - a + 1))

    atoms = at.select(
        path, "line", f(13, 16).alias("atom"), f(17, 17).alias("altloc"), f(18, 20).alias("resname"), f(22, 22).alias("chain"), f(23, 26).try_cast("int").alias("resseq"), f(27, 27).alias("icode"),
        *[f(a, b).try_cast("double").alias(n) for n, a, b in (("x", 31, 38), ("y", 39, 46), ("z", 47, 54), ("occ", 55, 60))],
    )
    rank = F.when(F.col("altloc") == "", 0).when(F.col("altloc") == "A", 1).otherwise(2)
    keys = [path, "chain", "resseq", "icode", "atom"]
    rest = [c for c in atoms.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(rank, -F.coalesce("occ", F.lit(0.0)), "line"))
    names = F.count_distinct("resname")
    return atoms.groupBy(*keys).agg(best.alias("b"), (names > 1).alias("name_conflict")).select(*keys, "b.*", "name_conflict")


def parse_mmcif(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """CA atoms of ``_atom_site`` loops; columns are found by the loop's own header."""
    lines = files.select(path, F.posexplode(F.split(text, "\r?\n")).alias("line", "l"))
    heads = lines.where("l like '_atom_site.%'").select(path, "line", F.trim(F.substring_index("l", ".", -1)).alias("name"))
    order = heads.groupBy(path).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda s: s["name"]).alias("names"))
    rows = lines.where("l like 'ATOM %' or l like 'HETATM %'").join(order, path).select(path, "line", F.map_from_arrays("names", F.slice(F.split(F.trim("l"), r"\s+"), F.lit(1), F.size("names"))).alias("m"))
    m = F.col("m")
    return rows.where(m["label_atom_id"] == "CA").select(path, m["auth_asym_id"].alias("chain"), m["auth_seq_id"].try_cast("int").alias("resseq"), m["label_comp_id"].alias("resname"), *[m[f"Cartn_{c}"].try_cast("double").alias(c) for c in "xyz"])
