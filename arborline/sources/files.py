"""Text files of trees and alignments as tables, and back.

One tree a file: vectors (a number a line) and matrices (three numbers a line) in .csv or .txt, Newick strings in
.nwk and the like, alignments in FASTA. Many files are read at once by a folder or a glob; ``path`` tells them apart.
"""

from __future__ import annotations

import urllib.parse
import urllib.request
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import newick as nw
from ..functions import trees as tr
from ..plans import stages

# The extensions that are taken.
EXTENSIONS = {"array": {".csv", ".txt"}, "newick": {".txt", ".nwk", ".newick", ".tree", ".treefile"}}


def check_path(path: str, kind: str) -> None:
    """An error for an extension that isn't one of the kind's; folders and globs without one pass."""
    suffix = PurePosixPath(path).suffix
    if suffix and suffix not in EXTENSIONS[kind]:
        raise ValueError(f"{suffix} is not one of {sorted(EXTENSIONS[kind])}")


def is_url(text: Column) -> Column:
    return F.coalesce(F.try_parse_url(text, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(text, F.lit("HOST")).isNotNull(), F.lit(False))


def parse_array(text: Column, delimiter: str = ",") -> tuple[Column, Column]:
    """v and bls of a whole file's text, told apart by the type of its numbers.

    Whole numbers, one a line or all in one line, are a vector (bls null); lines of three numbers that aren't all written
    as whole ones are a matrix, whose first column must hold whole values. Anything else is an error.
    """
    lines = F.filter(F.split(F.trim(text), r"\r?\n"), lambda x: F.trim(x) != "")
    cells = F.transform(lines, lambda x: F.transform(F.split(x, "[" + "".join(f"\\{c}" for c in delimiter) + "]"), lambda c: F.trim(c)))
    return _typed(cells)


def _typed(cells: Column) -> tuple[Column, Column]:
    flat, rows = F.flatten(cells), F.size(cells)
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    whole = F.forall(flat, lambda c: c.rlike(r"^[+-]?\d+$"))
    one = (rows == 1) | F.forall(cells, lambda r: F.size(r) == 1)
    three = F.forall(cells, lambda r: F.size(r) == 3)
    value = lambda c: c.try_cast("double")
    labels = F.forall(cells, lambda r: F.coalesce(value(F.get(r, F.lit(0))) == F.floor(value(F.get(r, F.lit(0)))), F.lit(False)))
    is_vector = (rows > 0) & whole & one
    is_matrix = (rows > 0) & ~whole & three & F.forall(flat, lambda c: c.rlike(number)) & labels
    v = F.when(is_vector, F.transform(flat, lambda c: c.try_cast("int"))).when(is_matrix, F.transform(cells, lambda r: value(F.get(r, F.lit(0))).cast("int")))
    v = F.coalesce(v, F.raise_error(F.lit("neither a vector nor a matrix")).cast("array<int>"))
    bls = F.when(is_matrix, F.transform(cells, lambda r: F.struct(value(F.get(r, F.lit(1))).alias("b1"), value(F.get(r, F.lit(2))).alias("b2"))))
    return v, bls


def read_array(text: DataFrame, column: str = "value", delimiter: str = ",") -> DataFrame:
    """``v`` and ``bls`` of texts, checked."""
    v, bls = parse_array(F.col(column), delimiter)
    t = text.withColumns({"v": v, "bls": bls}).withColumn("v", tr.check(F.col("v")))
    fits = F.col("bls").isNull() | tr.is_valid_matrix(F.col("v"), F.col("bls"))
    return t.withColumn("v", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("branch lengths must not be negative")).cast("array<int>")))


def load(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(path, v, bls) of a file or folder of vectors and matrices."""
    check_path(path, "array")
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return read_array(text, "value", delimiter).select("path", "v", "bls")


def load_newick(spark: SparkSession, path: str, lengths: bool | None = None) -> DataFrame:
    """(path, newick, v, bls) of Newick files; a string with a bracket is the tree itself.

    With ``lengths`` None, each tree tells whether it has branch lengths, and bls is null where it has none.
    """
    if "(" in path:
        text = spark.createDataFrame([("", path)], "path string, newick string")
    else:
        check_path(path, "newick")
        text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("newick"))
    return stages.from_newick(text) if lengths is None else stages.vector_of_newick(text, lengths)


def written(trees: DataFrame, delimiter: str = ",") -> DataFrame:
    """``value``: the file's text of v, or of v and bls where there are any."""
    line = lambda x, b: F.concat_ws(delimiter, F.format_string("%.18e", x.cast("double")), F.format_string("%.18e", b["b1"]), F.format_string("%.18e", b["b2"]))
    matrix = F.zip_with("v", "bls", line) if "bls" in trees.columns else F.lit(None).cast("array<string>")
    lines = F.coalesce(matrix, F.transform("v", lambda x: x.cast("string")))
    return trees.withColumn("value", F.array_join(lines, "\n"))


def save(trees: DataFrame, path: str, delimiter: str = ",") -> None:
    """A text file for each partition, a tree after another; use one tree a partition for one a file. Parquet is the native sink."""
    check_path(path, "array")
    written(trees.withColumn("v", tr.check(F.col("v"))), delimiter).select("value").write.text(path)


def save_newick(trees: DataFrame, path: str, lengths: bool = False, labels: dict | None = None) -> None:
    """A line for each tree; ``labels`` maps leaves (numbers, or numbers as text) to names, which then stand in their place."""
    check_path(path, "newick")
    made = stages.newick(trees, lengths)
    if labels:
        names = F.create_map(*[F.lit(x) for leaf, name in labels.items() for x in (int(leaf), str(name))])
        made = made.withColumn("_pieces", nw.label_pieces(F.col("newick"))).withColumn("newick", nw.named(F.col("_pieces"), names))
    made.select(F.col("newick").alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, seq) of FASTA files: records are split by the reader, at lines that begin with >."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("value"))
    return fasta_records(records.where(F.trim("value") != ""))


def fasta_records(records: DataFrame) -> DataFrame:
    """(taxon, seq) of records without their > signs: the id is the header's first word."""
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    seq = F.regexp_replace(F.regexp_extract("value", r"^[^\n]*\n?([\s\S]*)$", 1), r"\s+", "")
    return records.select(head.alias("taxon"), seq.alias("seq"))


# Name, taxa, bases, format, type of sequence, rank and link of the known alignments (fetched by users, not shipped).
DATASETS = [
    ("fluA", 69, 987, "fasta", "RNA", "Influenza A", "https://raw.githubusercontent.com/4ment/phylostan/2ac68ac87cc6057efe556fa178fa391607ec5c3b/examples/fluA/fluA.fa"),
    ("h3n2", 19, 1407, "fasta", "RNA", "Influenza A subtype H3N2", "https://raw.githubusercontent.com/neherlab/treetime_examples/79eae7f8025a8ef3165c856c7359d92e738eb893/data/h3n2_na/h3n2_na_20.fasta"),
    ("m501", 29, 2520, "fasta", "RNA", "Acanthocephalans", "https://bitbucket.org/XavMeyer/coevrj/raw/fa1355af4c28123bcf06fdb0bc43c90595beca45/data/adaptiveTreeProp/alignments/TreeBase/M2131.fasta"),
    ("yeast", 8, 127026, "rdata", "DNA", "Fungi; mainly _Saccharomyces_", "https://github.com/KlausVigo/phangorn/raw/refs/heads/main/data/yeast.RData"),
    ("zika", 86, 10807, "fasta", "RNA", "Zika virus", "https://raw.githubusercontent.com/neherlab/treetime_examples/79eae7f8025a8ef3165c856c7359d92e738eb893/data/zika/zika.fasta"),
]
FORMATS = {"fasta": "fa"}


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([d[:4] for d in DATASETS], "name string, n_taxa int, n_bases int, format string")


def list_datasets(spark: SparkSession) -> list[str]:
    """Names of the alignments that can be read."""
    return [r["name"] for r in datasets(spark).where("format = 'fasta'").orderBy("name").collect()]


def load_descr(name: str) -> dict:
    """What is known of an alignment: rank, taxa, bases, type and link; an unknown name is an error."""
    for known, taxa, bases, _, kind, rank, link in DATASETS:
        if name in (known, f"{known}.md"):
            return {"Taxonomic Rank": rank, "Number of Taxa": taxa, "Number of Bases": bases, "Type": kind, "Link": link}
    raise ValueError(f"unknown dataset: {name}")


def _fetched(spark: SparkSession, url: str) -> DataFrame:
    """(taxon, seq) of a FASTA file behind a URL, read by the driver: one alignment fits it."""
    with urllib.request.urlopen(url) as answer:  # noqa: S310
        text = answer.read().decode()
    records = [(r,) for r in ("\n" + text.replace("\r", "")).split("\n>")[1:]]
    return fasta_records(spark.createDataFrame(records, "value string"))


def load_fasta(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """(taxon, seq) of an alignment in a folder of alignments, by its file's name."""
    return read_fasta(spark, f"{folder.rstrip('/')}/{name}")


def load_alignment(spark: SparkSession, dataset: str, data_format: str | None = None, folder: str | None = None, overwrite: bool = False) -> tuple[DataFrame, dict | None]:
    """An alignment (taxon, seq) and, of a known one, its description.

    A known name is read from ``folder`` where its file is there (and ``overwrite`` isn't set), else from its link.
    Anything else is a URL or a path, whose format must be given.
    """
    known = {d[0]: d for d in DATASETS}
    if dataset in known:
        data_format = known[dataset][3]
        if data_format not in FORMATS:
            raise ValueError(f"unsupported format: {data_format}")
        descr = load_descr(dataset)
        held = folder and f"{folder.rstrip('/')}/{dataset}.{FORMATS[data_format]}"
        if held and not overwrite:
            path = spark._jvm.org.apache.hadoop.fs.Path(held)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                return read_fasta(spark, held), descr
        return _fetched(spark, descr["Link"]), descr
    if data_format not in FORMATS:
        raise ValueError(f"unknown format: {data_format}; one of {list(FORMATS)} must be given")
    scheme = urllib.parse.urlparse(dataset).scheme
    return (_fetched(spark, dataset) if scheme in ("http", "https", "ftp") else read_fasta(spark, dataset)), None
