"""Scans, sources and sinks (S1-S25): tables are written in each format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import tables as T
from ..sources import files as R
from .base import query


@query("s1_headered_tsv", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s1(t):
    path = R.write_tsv(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), R.scratch(t.spark, "orders"))
    return R.read_tsv(t.spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", ["o_orderkey", "o_totalprice"])


def _wide(t):
    path = R.scratch(t.spark, "wide")
    t.embeddings.select(F.concat_ws("\t", F.col("vec_id").cast("string"), F.array_join(V.doubles(F.col("embedding")).cast("array<string>"), "\t")).alias("value")).write.text(path)
    return path


@query("s2_wide_vectors", "SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS vec FROM embeddings")
def s2(t):
    return R.read_wide_vectors(t.spark, _wide(t))


@query("s3_packed_vectors", "SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 5 <> 0")
def s3(t):
    """Every fifth row is unparseable and skipped."""
    packed = F.concat(F.lit("["), F.array_join(V.doubles(F.col("embedding")).cast("array<string>"), ", "), F.when(F.col("vec_id") % 5 == 0, " x]").otherwise("]"))
    return R.unpack_vectors(t.embeddings.select("vec_id", packed.alias("text"))).select("vec_id", "vec")


@query("s4_task_scan", "SELECT event_id, value, event_type AS donor FROM events")
def s4(t):
    path = R.scratch(t.spark, "tasks")
    t.events.select("event_id", "value", F.col("event_type").alias("donor")).write.partitionBy("donor").option("sep", "\t").option("header", True).csv(path)
    return R.read_tasks(t.spark, path, "event_id long, value double")


def _fasta(t, width):
    rows = t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(" note")).alias("id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("seq"))
    return R.write_fasta(rows, R.scratch(t.spark, "fasta"), width=width)


@query("s5_fasta_read", "SELECT 'P' || p_partkey AS id, replace(p_name, ' ', '') AS seq FROM part")
def s5(t):
    return R.read_fasta(t.spark, _fasta(t, 4))


@query("s6_fasta_write", "SELECT 'entity' AS file, p_brand AS id, replace(arg_min(p_name, p_partkey), ' ', '') AS seq FROM part GROUP BY p_brand UNION ALL SELECT 'sample', p_brand || '/' || p_partkey, replace(p_name, ' ', '') FROM part")
def s6(t):
    """Two FASTA files, read back: one keyed by entity with its first sequence, one keyed by sample with all of them."""
    bare = F.replace("p_name", F.lit(" "), F.lit(""))
    first = t.part.groupBy(F.col("p_brand").alias("id")).agg(F.min_by(bare, "p_partkey").alias("seq"))
    every = t.part.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("id"), bare.alias("seq"))
    files = {"entity": first, "sample": every}
    read = [R.read_fasta(t.spark, R.write_fasta(df, R.scratch(t.spark, name), width=0)).select(F.lit(name).alias("file"), "id", "seq") for name, df in files.items()]
    return read[0].unionByName(read[1])


@query("s7_fasta_wrap", "SELECT doc_id, CAST(list_sum(list_transform(string_split(text, chr(10)), lambda l: length(l) + greatest(0, ceil(length(l) / 60.0) - 1) + 1)) - 1 AS BIGINT) AS n FROM documents")
def s7(t):
    return t.documents.select("doc_id", F.length(F.regexp_replace("text", "([^\n]{60})(?=[^\n])", "$1\n")).cast("long").alias("n"))


def _pdb_lines(t):
    """Points of the vectors as PDB text, one file per vector."""
    atom = F.format_string("ATOM  %5d  CA  %s A%4d    %8.3f%8.3f%8.3f%6.2f", F.col("i"), F.element_at(F.array(*[F.lit(x) for x in ("ALA", "GLY", "SER", "THR")]), F.col("i") % 4 + 1), F.col("i") + 1, F.col("p")[0] * 100, F.col("p")[1] * 100, F.col("p")[2] * 100, F.lit(1.0))
    from .geometry import points

    lines = points(t).select("vec_id", "i", atom.alias("l")).groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda s: s["l"]), "\n").alias("a"))
    return lines.select(F.col("vec_id").cast("string").alias("path"), F.concat(F.lit("MODEL 1\n"), "a", F.lit("\nHETATM   99  O   HOH A  99       1.000   2.000   3.000  1.00\nENDMDL\nMODEL 2\n"), "a", F.lit("\nENDMDL\n")).alias("text"))


_AT = ", ".join(f"round(embedding[i * 3 + {k + 1}]::DOUBLE * 100, 3) AS {c}" for k, c in enumerate("xyz"))
_GRID = "FROM embeddings, (SELECT unnest(range(21)) AS i)"


@query("s8_pdb_atoms", f"SELECT vec_id::VARCHAR AS path, 'A' AS chain, (i + 1)::INTEGER AS resseq, 'CA' AS atom, ['ALA', 'GLY', 'SER', 'THR'][i % 4 + 1] AS resname, {_AT}, 1.0::DOUBLE AS occ, false AS name_conflict {_GRID}")
def s8(t):
    return R.parse_pdb(_pdb_lines(t)).select("path", "chain", "resseq", "atom", "resname", "x", "y", "z", "occ", "name_conflict")


@query("s9_mmcif_atoms", f"SELECT vec_id::VARCHAR AS path, 'A' AS chain, (i + 1)::INTEGER AS resseq, 'GLY' AS resname, {_AT} {_GRID}")
def s9(t):
    from .geometry import points

    head = "data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in ("group_PDB", "id", "label_atom_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"))
    row = F.format_string("ATOM %d CA GLY A %d %.3f %.3f %.3f", F.col("i") + 1, F.col("i") + 1, *[F.col("p")[k] * 100 for k in range(3)])
    text = points(t).select("vec_id", "i", row.alias("l")).groupBy(F.col("vec_id").cast("string").alias("path")).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda s: s["l"]), "\n"), F.lit("\n#\n")).alias("text"))
    return R.parse_mmcif(text)


@query(
    "s10_confidence_json",
    """SELECT event_type AS target, user_id::VARCHAR AS seed, event_id::VARCHAR AS sample, value::DOUBLE AS iptm, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ptm, user_id * CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS plddt,
       CASE WHEN event_id % 2 = 0 THEN event_type || '/seed_' || user_id || '/predictions/' || event_type || '_summary_confidence_sample_' || event_id || '.json'
       ELSE event_type || '/seed-' || user_id || '_sample-' || event_id || '/' || event_type || '_seed-' || user_id || '_sample-' || event_id || '_summary_confidences.json' END AS json_path FROM events""",
)
def s10(t):
    """Files of both presets: even events by the first, odd ones by the second with a scale."""
    metrics = [F.col("value").cast("double").alias("iptm"), F.get_json_object("props", "$.k").cast("double").alias("ptm")]
    e = t.events.select("event_id", *[F.col(c).cast("string") for c in ("event_type", "user_id")], *metrics)
    one = e.where("event_id % 2 = 0").select(F.expr("concat('out/', event_type, '/seed_', user_id, '/predictions/', event_type, '_summary_confidence_sample_', event_id, '.json')").alias("path"), F.to_json(F.struct("iptm", "ptm", F.col("user_id").cast("double").alias("plddt"))).alias("text"))
    two = e.where("event_id % 2 <> 0").select(F.expr("concat('out/', event_type, '/seed-', user_id, '_sample-', event_id, '/', event_type, '_seed-', user_id, '_sample-', event_id, '_summary_confidences.json')").alias("path"), F.to_json(F.struct("iptm", "ptm", F.col("user_id").cast("double").alias("overall_plddt"))).alias("text"))
    files = one.unionByName(two)
    return R.parse_confidence(files).unionByName(R.parse_confidence(files, "rf3", plddt_scale=100.0))


_HITS = "SELECT user_id AS query, event_type || '.pdb' AS TARGET, value AS BITS, event_id FROM events"


@query("s11_search_hits", f"SELECT query, target, bits FROM (SELECT query, replace(TARGET, '.pdb', '') AS target, BITS AS bits, row_number() OVER (PARTITION BY query, TARGET ORDER BY BITS DESC, event_id) AS r FROM ({_HITS})) WHERE r = 1")
def s11(t):
    h = t.events.selectExpr("user_id AS QUERY", "concat(event_type, '.pdb') AS Target", "value AS BITS", "event_id")
    h = h.toDF(*[c.lower() for c in h.columns]).withColumn("target", F.regexp_replace("target", r"\.pdb$", ""))
    return T.first_row(h, ["query", "target"], [F.desc("bits"), F.col("event_id")]).select("query", "target", "bits")


@query("s12_hit_projections", "SELECT 'similarity' AS part, event_id, value AS v FROM events UNION ALL SELECT 'alignment', event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events")
def s12(t):
    sim = t.events.select(F.lit("similarity").alias("part"), "event_id", F.col("value").alias("v"))
    return sim.unionByName(t.events.select(F.lit("alignment").alias("part"), "event_id", F.get_json_object("props", "$.k").cast("double").alias("v")))


@query("s13_traces", "SELECT l_orderkey, CAST(printf('%.9f', l_orderkey * 1e-9::DOUBLE) AS DOUBLE) * 1e9::DOUBLE AS nanomolar, l_linenumber::DOUBLE AS time, l_quantity::DOUBLE AS signal FROM lineitem")
def s13(t):
    """Instrument files: concentration on line 2, header on line 5, molar to nanomolar."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: F.concat_ws("\t", s["l_linenumber"].cast("string"), s["l_quantity"].cast("string"))), "\n")
    files = t.lineitem.groupBy("l_orderkey").agg(F.concat(F.lit("title\nConc1\t"), F.format_string("%.9f", F.col("l_orderkey") * 1e-9), F.lit("\n\n\nTime1\tData1\n"), body).alias("text"))
    lines = files.select("l_orderkey", F.split("text", "\n").alias("a"))
    conc = F.split(F.col("a")[1], "\t")[1].try_cast("double") * 1e9
    rows = lines.select("l_orderkey", conc.alias("nanomolar"), F.posexplode("a").alias("pos", "l")).where("pos > 4")
    return rows.select("l_orderkey", "nanomolar", F.split("l", "\t")[0].try_cast("double").alias("time"), F.split("l", "\t")[1].try_cast("double").alias("signal"))


@query("s14_term_map", "WITH l AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{16}') AS ids, regexp_extract_all(text, '[a-z]{12,}') AS terms FROM documents) SELECT ids[1] AS id, len(list_distinct(flatten(list(terms)))) AS n FROM l WHERE len(ids) = 1 AND len(terms) > 0 GROUP BY 1")
def s14(t):
    d = t.documents.select(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0)).alias("ids"), F.regexp_extract_all("text", F.lit("[a-z]{12,}"), F.lit(0)).alias("terms"))
    one = d.where("size(ids) = 1 and size(terms) > 0").select(F.col("ids")[0].alias("id"), F.explode("terms").alias("term"))
    return one.groupBy("id").agg(F.count_distinct("term").alias("n"))


@query("s15_entries", "SELECT p_partkey, p_name, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type ELSE 'UNKNOWN' END AS type FROM part")
def s15(t):
    kinds = F.create_map(*[F.lit(x) for k in ("ECONOMY", "SMALL") for x in (k, k)])
    return t.part.select("p_partkey", "p_name", F.coalesce(F.try_element_at(kinds, F.col("p_type")), F.lit("UNKNOWN")).alias("type"))


@query(
    "s16_hierarchy",
    "WITH n AS (SELECT conv_id AS file, turn AS pos, turn % 3 AS level, conv_id || ':' || turn AS id FROM conversations) SELECT c.id AS child, arg_max(p.id, p.pos) AS parent FROM n c JOIN n p ON c.file = p.file AND p.level = c.level - 1 AND p.pos < c.pos GROUP BY 1",
)
def s16(t):
    """Dash-indented outlines: the parent is the last row one level up."""
    line = F.concat(F.repeat(F.lit("--"), F.col("turn") % 3), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit("::x"))
    rows = t.conversations.select("conv_id", F.col("turn").alias("pos"), line.alias("l"))
    n = rows.select("conv_id", "pos", (F.length(F.regexp_extract("l", "^(-*)", 1)) / 2).cast("int").alias("level"), F.regexp_extract("l", "^-*(.*?)::", 1).alias("id"))
    pairs = n.alias("c").join(n.alias("p"), F.expr("c.conv_id = p.conv_id and p.level = c.level - 1 and p.pos < c.pos"))
    return pairs.groupBy(F.col("c.id").alias("child")).agg(F.max_by("p.id", "p.pos").alias("parent"))


@query("s17_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def s17(t):
    return T.require_columns(t.lineitem, ["l_orderkey", "l_quantity"]).select("l_orderkey", "l_quantity")


@query("s18_id_filtered_scan", "SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE label = 3")
def s18(t):
    return R.read_some_vectors(t.spark, _wide(t), t.embeddings.where("label = 3").select(F.col("vec_id").cast("string").alias("id")))


@query("s19_split_scores", "SELECT l_orderkey, l_linenumber, 'change' AS stage, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'grafted', l_discount FROM lineitem")
def s19(t):
    path = R.scratch(t.spark, "scores")
    long = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_tax").alias("change"), F.col("l_discount").alias("grafted")).unpivot(["l_orderkey", "l_linenumber"], ["change", "grafted"], "stage", "value")
    long.sortWithinPartitions("stage", "value").write.partitionBy("stage").parquet(path)
    return t.spark.read.schema("l_orderkey long, l_linenumber int, value double, stage string").parquet(path)


@query("s20_publish", "SELECT 'result' AS part, event_type AS status, count(*) AS n FROM events WHERE value IS NOT NULL AND value <= 20 GROUP BY 2 UNION ALL SELECT 'qc', event_type, count(*) FROM events WHERE NOT coalesce(value <= 20, false) GROUP BY 2")
def s20(t):
    """Rows that pass and a side table of those that do not, published together or not at all."""
    e = t.events.select("event_id", F.col("event_type").alias("status"), F.coalesce(F.col("value") <= 20, F.lit(False)).alias("good"))
    path = R.publish(t.spark, R.scratch(t.spark, "published"), {"result": e.where("good").drop("good"), "qc": e.where("not good").drop("good")})
    read = [R.read_published(t.spark, path, p).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "status", "n") for p in ("result", "qc")]
    return read[0].unionByName(read[1])


@query("s21_directory", "SELECT o_orderpriority AS file, o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def s21(t):
    path = R.scratch(t.spark, "dir")
    t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("file")).write.partitionBy("file").parquet(path)
    return t.spark.read.parquet(path).select(F.col("file").cast("string").alias("file"), "o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))


@query("s22_harvest", "SELECT 'task_' || page_id AS task, 'task_' || page_id || '/model_0.cif' AS structure, CASE WHEN page_id % 7 <> 0 THEN 'task_' || page_id || '/confidence_0.json' END AS confidence, page_id % 7 = 0 AS missing FROM pages")
def s22(t):
    """Structure and confidence files of each task, joined by folder; missing ones are reported."""
    names = t.pages.select(F.explode(F.array(F.format_string("task_%d/model_0.cif", "page_id"), F.when(F.col("page_id") % 7 != 0, F.format_string("task_%d/confidence_0.json", "page_id")))).alias("path")).where("path is not null")
    task = F.substring_index("path", "/", 1)
    cif = names.where("path like '%.cif'").select(task.alias("task"), F.col("path").alias("structure"))
    conf = names.where("path like '%.json'").select(task.alias("task"), F.col("path").alias("confidence"))
    return cif.join(conf, "task", "full_outer").select("task", "structure", "confidence", (F.col("structure").isNull() | F.col("confidence").isNull()).alias("missing"))


@query("s23_sequence_from_atoms", "SELECT vec_id::VARCHAR AS id, string_agg(CASE i % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'S' ELSE 'T' END, '' ORDER BY i) AS seq FROM embeddings, (SELECT unnest(range(21)) AS i) GROUP BY 1")
def s23(t):
    atoms = R.parse_pdb(_pdb_lines(t)).select("path", "chain", "resseq", "icode", "resname").distinct()
    aa = X.one_letter(F.col("resname"))
    g = atoms.groupBy(F.col("path").alias("id")).agg(F.array_sort(F.collect_list(F.struct("chain", "resseq", "icode", aa.alias("aa")))).alias("r"))
    return g.select("id", F.array_join(F.transform("r", lambda s: s["aa"]), "").alias("seq"))


@query("s24_generation_schema", "SELECT 'in/' || c_name || '.pdb' AS path, substring(c_name, 5, 1) AS chain, length(c_mktsegment) AS n FROM customer")
def s24(t):
    return t.customer.select(F.concat(F.lit("in/"), "c_name", F.lit(".pdb")).alias("path"), F.substring("c_name", 5, 1).alias("chain"), F.length("c_mktsegment").cast("long").alias("n"))


@query("s25_summary_report", "SELECT o_orderkey, 'price' AS metric, round(o_totalprice, 2) AS mean, round(o_totalprice * 2, 2) AS sd FROM orders")
def s25(t):
    """Two fixed layouts of report lines, told apart by the line itself."""
    a = F.format_string("%d price mean=%.2f sd=%.2f", "o_orderkey", "o_totalprice", F.col("o_totalprice") * 2)
    b = F.format_string("%d | price | %.2f | %.2f", "o_orderkey", "o_totalprice", F.col("o_totalprice") * 2)
    lines = t.orders.select(F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(b).alias("l"))
    rx = r"^(\d+)(?: \| | )(\w+)(?: mean=| \| )([0-9.]+)(?: sd=| \| )([0-9.]+)$"
    return lines.select(F.regexp_extract("l", rx, 1).cast("long").alias("o_orderkey"), F.regexp_extract("l", rx, 2).alias("metric"), F.regexp_extract("l", rx, 3).try_cast("double").alias("mean"), F.regexp_extract("l", rx, 4).try_cast("double").alias("sd"))
