"""Readers of ontologies, annotations and nomenclature as Spark tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.numbering import in_order

#: The 17 columns of the GAF 2 format, in order.
GAF_COLUMNS = (
    "DB", "DB_Object_ID", "DB_Object_Symbol", "Qualifier", "GO_ID", "DB_Reference", "Evidence_Code", "With_From", "Aspect",
    "DB_Object_Name", "DB_Object_Synonym", "DB_Object_Type", "Taxon", "Date", "Assigned_By", "Annotation_Extension", "Gene_Product_Form_ID",
)
#: The nine columns of GTF, in order.
GTF_COLUMNS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attribute")


def read_obo(spark: SparkSession, path: str, obsolete: bool = False) -> tuple[DataFrame, DataFrame]:
    """Terms and ``parent, child`` edges of an OBO ontology.

    A stanza is a row of the text source; it begins at a line with an open bracket, whatever
    the line ends are. Terms: ``id, name, namespace, definition, is_obsolete, alt_ids``.
    Obsolete terms and their edges go unless asked for.
    """
    stanzas = spark.read.option("lineSep", "\n[").text(path).select(F.concat(F.lit("["), F.ltrim(F.regexp_replace("value", "\r", ""), F.lit("["))).alias("s"))
    one = lambda tag, pattern="([^\n]*)": F.nullif(F.regexp_extract("s", rf"(?m)^{tag}: {pattern}", 1), F.lit(""))
    many = lambda tag: F.expr(rf"regexp_extract_all(s, '(?m)^{tag}: ([^ !\n]+)', 1)")
    parsed = stanzas.filter(F.col("s").rlike(r"(?m)^\[Term\]")).select(
        one("id", r"(\S+)").alias("id"), one("name").alias("name"), one("namespace", r"(\S+)").alias("namespace"), one("def", '"((?:[^"\\\\\\\\]|\\\\\\\\.)*)"').alias("definition"),
        F.col("s").rlike(r"(?m)^is_obsolete: true").alias("is_obsolete"), F.array_distinct(many("alt_id")).alias("alt_ids"), F.array_distinct(many("is_a")).alias("_parents"),
    ).filter("id IS NOT NULL")
    terms = parsed if obsolete else parsed.filter("NOT is_obsolete")
    return terms.drop("_parents"), terms.select(F.explode("_parents").alias("parent"), F.col("id").alias("child"))


def read_gaf(spark: SparkSession, path: str, evidence: Sequence[str] | None = None, aspect: str | None = None) -> DataFrame:
    """Annotation rows with the columns of GAF 2; comments and rows of fewer than 15 fields go, short rows are padded."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("!")).select(F.split("value", "\t", -1).alias("f")).filter(F.size("f") >= 15)
    out = rows.select(*(F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(GAF_COLUMNS)))
    out = out.filter(F.col("Evidence_Code").isin(list(evidence))) if evidence else out
    return out.filter(F.col("Aspect") == aspect) if aspect else out


def gene_terms(gaf: DataFrame, gene_column: str = "DB_Object_Symbol") -> DataFrame:
    """``gene, terms``: distinct terms of each gene, sorted."""
    return gaf.groupBy(F.col(gene_column).alias("gene")).agg(F.sort_array(F.collect_set("GO_ID")).alias("terms"))


def annotation_of(gene2terms: DataFrame) -> DataFrame:
    """``gene, term`` pairs of ``(gene, terms)`` without repeats."""
    return gene2terms.select("gene", F.explode("terms").alias("term")).distinct()


def genes_by_term(annotation: DataFrame) -> DataFrame:
    return annotation.groupBy("term").agg(F.sort_array(F.collect_set("gene")).alias("genes"))


def terms_by_gene(annotation: DataFrame) -> DataFrame:
    return annotation.groupBy("gene").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def term_records(terms: DataFrame, edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Each term with its level, depth, parents and children."""
    up = edges.groupBy(F.col("child").alias("id")).agg(F.sort_array(F.collect_set("parent")).alias("parents"))
    down = edges.groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_set("child")).alias("children"))
    placed = levels.select(F.col("node").alias("id"), "level", "depth")
    return terms.join(placed, "id", "left").join(up, "id", "left").join(down, "id", "left")


def main_terms(terms: DataFrame) -> DataFrame:
    """``any_id, id``: every id and alternative id with its main term."""
    return terms.select(F.col("id").alias("any_id"), "id").union(terms.select(F.explode("alt_ids"), "id")).distinct()


def read_gtf(spark: SparkSession, path: str, feature: str | None = None, attributes: Sequence[str] | None = None) -> DataFrame:
    """Rows of a GTF file with one column per attribute, or those asked for; a repeated key keeps its last value."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t", -1).alias("f")).filter(F.size("f") == 9)
    out = rows.select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(GTF_COLUMNS))).withColumn("start", F.col("start").cast("int")).withColumn("end", F.col("end").cast("int"))
    out = out.filter(F.col("feature") == feature) if feature else out
    keys, values = F.expr(r"regexp_extract_all(attribute, '(\\w+) \"([^\"]*)\"', 1)"), F.expr(r"regexp_extract_all(attribute, '(\\w+) \"([^\"]*)\"', 2)")
    out = out.withColumn("_m", F.aggregate(F.arrays_zip(keys.alias("k"), values.alias("v")), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"]))))
    names = list(attributes) if attributes is not None else [r[0] for r in out.select(F.explode(F.map_keys("_m")).alias("k")).distinct().orderBy("k").collect()]
    return out.select(*GTF_COLUMNS[:-1], *(F.col("_m")[n].alias(n) for n in names))


def read_nomenclature(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Gene nomenclature JSON (``response.docs``) as a table."""
    docs = spark.read.option("multiLine", True).json(path).select(F.explode("response.docs").alias("d")).select("d.*")
    return docs.select(*[c for c in columns if c in docs.columns]) if columns else docs


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write as ``json``, ``csv``, ``tsv`` or ``parquet``."""
    if kind not in ("json", "csv", "tsv", "parquet"):
        raise ValueError(f"unknown format {kind}")
    writer = df.write
    if kind in ("csv", "tsv"):
        writer = writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
    writer.format("csv" if kind == "tsv" else kind).save(path)


def save_graph(path: str, edges: DataFrame, vocab: DataFrame) -> None:
    edges.write.parquet(f"{path}/edges")
    vocab.write.parquet(f"{path}/vocab")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vocab")


def save_vocabulary(path: str, vocab: DataFrame, unknown: str = "<unk>", missing: int = -1) -> None:
    """A vocabulary with its size and defaults beside it."""
    vocab.write.parquet(f"{path}/tokens")
    vocab.agg(F.count("*").alias("size")).withColumns({"default_token": F.lit(unknown), "default_index": F.lit(missing)}).coalesce(1).write.json(f"{path}/about")


def load_vocabulary(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    vocab = spark.read.parquet(f"{path}/tokens")
    if verify and vocab.count() != spark.read.json(f"{path}/about").first()["size"]:
        raise ValueError("the vocabulary's size is not the recorded one")
    return vocab


def save_gene_map(path: str, aliases: DataFrame, ids: DataFrame) -> None:
    """``aliases (alias, symbol)`` and ``ids (symbol, id)`` below one path."""
    aliases.write.parquet(f"{path}/aliases")
    ids.write.parquet(f"{path}/ids")


def load_gene_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/aliases"), spark.read.parquet(f"{path}/ids")


def mapped_labels(df: DataFrame, column: str, parse: Callable[[str], str | None], out: str | None = None) -> DataFrame:
    """``column`` put through a Python function, which runs once for each distinct label."""

    def parsed(labels: pd.Series) -> pd.Series:
        return labels.map(parse)

    table = df.select(F.col(column).alias("_l")).distinct().withColumn("_p", F.pandas_udf(parsed, "string")("_l"))
    joined = df.join(table, F.col(column).eqNullSafe(F.col("_l")), "left")
    return joined.withColumn(out or column, F.col("_p")).select(*df.columns, *([out] if out and out not in df.columns else []))


def numbered_terms(annotation: DataFrame) -> DataFrame:
    """``gene, term`` as numbers of the sorted names, for export."""
    genes = in_order(annotation.select("gene").distinct(), ["gene"], "source")
    terms = in_order(annotation.select("term").distinct(), ["term"], "target")
    return annotation.join(genes, "gene").join(terms, "term").select("source", "target")
