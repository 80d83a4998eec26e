"""The workflow in one call: from alignments, annotation and genome to read classes, an extended annotation and counts.

Stages are typed tables; each sample's read classes are written before the next stage, so any number of samples is one pass after another.
Defined cases: without annotations everything is new (`discovery` is then needed for counts); a sample without reads left is an error; unknown
options are taken with a warning; warnings are kept by sample in Result.warnings.
"""

from __future__ import annotations

import warnings as _warnings
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import ranges as R
from strandflow.operators import annotations as A
from strandflow.operators import extend, genes, junctions, quantify, read_classes, samples, scoring
from strandflow.operators.compare import compare_transcripts
from strandflow.operators.staged import written
from strandflow.sources import bam, genome, gtf
from strandflow.sources.txdb import read_txdb

__all__ = ["Options", "Result", "compare_transcripts", "prepare_annotations", "process_reads", "run", "train_models", "transcript_to_gene_expression", "write_output"]

EMPTY = "tx string, gene string, txid long, chr string, strand string, x array<struct<s:bigint,e:bigint>>, s long, e long, eq array<bigint>"


@dataclass(frozen=True)
class Options:
    """Parameters and their defaults; `with_` overrides some of them."""

    drop_subsets: bool = True
    least_reads: int = 2
    least_share_of_gene: float = 0.05
    least_samples: int = 1
    exon_distance: int = 35
    exon_overlap: int = 10
    slack: int = 5
    slack_ends_discovery: int = 5
    slack_ends_quant: int = 5
    least_score_multi: float = 0.0
    least_score_single: float = 1.0
    fit_models: bool = True
    default_models: scoring.TranscriptModels = field(default_factory=lambda: scoring.DEFAULT)
    base_rate: float = 0.1
    least_share_of_class: float = 0.0
    prefix: str = "Novel"
    degradation_bias: bool = True
    max_iterations: int = 10_000
    tolerance: float = 1e-2
    places: int = 5

    def with_(self, **changes) -> Options:
        known = {f.name for f in fields(self)}
        for k in changes.keys() - known:
            _warnings.warn(f"there is no option {k}", stacklevel=2)
        return replace(self, **{k: v for k, v in changes.items() if k in known})


@dataclass
class Result:
    """annotations (ANNOTATION columns), counts (tx, gene, txid, sample, counts, cpm, full_length_counts, unique_counts), incompatible (gene, sample,
    counts), classes by sample, and on request read_maps and distances by sample."""

    classes: DataFrame
    annotations: DataFrame | None = None
    counts: DataFrame | None = None
    incompatible: DataFrame | None = None
    threshold: float | None = None
    read_maps: DataFrame | None = None
    distances: DataFrame | None = None
    warnings: dict[str, list[str]] = field(default_factory=dict)


def prepare_annotations(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Transcripts from a GTF file, a transcript database (.sqlite) or a table of exons (chr, s, e, strand, gene, tx)."""
    if isinstance(source, str):
        source = read_txdb(spark, source) if source.endswith((".sqlite", ".db")) else gtf.read_gtf(spark, source)
    return A.prepared(source)


def check_inputs(reads: dict, annotations: DataFrame | None, sequence, prefix: str) -> list[str]:
    """Problems that do not stop a run; those that do are raised."""
    if not reads:
        raise ValueError("no reads")
    kinds = {"classes" if isinstance(r, str) and r.rstrip("/").endswith(".parquet") else "alignments" for r in reads.values()}
    if len(kinds) > 1:
        raise ValueError("give either alignments or read classes, not both")
    if kinds == {"alignments"} and sequence is None:
        raise ValueError("a genome is needed with alignments")
    out = []
    if annotations is not None:
        missing = {"tx", "gene", "txid", "chr", "strand", "x", "eq"} - set(annotations.columns)
        if missing:
            raise ValueError(f"the annotations are not prepared: {', '.join(sorted(missing))} missing")
        if not annotations.groupBy("tx").count().filter("count > 1").isEmpty():
            out.append("transcript names are not unique")
        if not annotations.filter(F.col("gene").startswith(f"{prefix}Gene") | F.col("tx").startswith(f"{prefix}Tx")).isEmpty():
            out.append(f"annotations have names with the prefix {prefix}; choose another one")
    return out


def _reads(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    d = source if isinstance(source, DataFrame) else bam.read_bam(spark, source) if source.endswith(".bam") else gtf.read_sam(spark, source)
    x = F.col("x")
    return d.select("read_id", "chr", "strand", "x", x[0]["s"].alias("s"), F.element_at(x, -1)["e"].alias("e"), F.size(x).alias("n"))


def process_reads(reads: DataFrame, annotations: DataFrame, sequence: DataFrame, lengths: DataFrame, options: Options = Options(), stranded: bool = False, by_chromosome: bool = False, fusion: bool = False) -> tuple[DataFrame, DataFrame, scoring.TranscriptModels | None, list[str]]:
    """(scored read classes, read_id and class_id, the sample's own models, warnings) of reads (read_id, chr, strand, x, s, e, n).

    by_chromosome: junctions and classes are built one chromosome after another, which bounds what is in flight at a time."""
    reads, annotations, told = A.shared_chromosomes(reads, annotations, lengths)
    kept = written(A.in_bounds(reads, lengths))
    n, m = reads.count(), kept.count()
    if m < n:
        told.append(f"{n - m} reads lie outside of their chromosome and are dropped")
    if not m:
        raise ValueError("no reads are left")
    if kept.filter("n > 1").isEmpty():
        told.append("no spliced reads")
    parts = [F.col("chr") == r.chr for r in kept.select("chr").distinct().orderBy("chr").collect()] if by_chromosome else [F.lit(True)]
    built: list[tuple[DataFrame, DataFrame]] = []
    for of in parts:
        some, known = kept.filter(of), annotations.filter(of)
        g = lambda d, i: d.select(i, "chr", "strand", F.explode(R.introns(F.col("x"))).alias("r")).select(i, "chr", F.col("r.s").alias("s"), F.col("r.e").alias("e"), "strand")
        table = written(junctions.build(g(some, "read_id"), g(known, "tx").drop("tx").distinct(), sequence, stranded))
        c, of_reads = read_classes.construct(some, table, known, stranded)
        built.append((written(c), written(of_reads)))
    classes, members = built[0]
    for c, of_reads in built[1:]:
        classes, members = classes.unionByName(c), members.unionByName(of_reads)
    g = genes.cascade(classes.select(F.col("class_id").alias("id"), "chr", "strand", "x"), annotations.select("gene", "chr", "strand", "x"), options.exon_overlap, fusion, prefix=options.prefix)
    scored, own = scoring.score_classes(classes, g, annotations, sequence, options.default_models, options.fit_models, options.least_reads)
    if options.fit_models and own is None:
        told.append("no model could be trained on this sample; the default models are used")
    return written(scored), members, own, told


def save_classes(classes: DataFrame, members: DataFrame, folder: str, sample: str) -> str:
    """The read classes of a sample as <folder>/<sample>_readClasses.parquet (replaced if it is there), their reads beside it."""
    path = f"{folder.rstrip('/')}/{sample}_readClasses.parquet"
    classes.write.mode("overwrite").parquet(path)
    members.write.mode("overwrite").parquet(path.replace("_readClasses", "_readIds"))
    return path


def load_classes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(path), spark.read.parquet(path.replace("_readClasses", "_readIds"))


def run(
    spark: SparkSession, reads, annotations: DataFrame | str | None = None, sequence: str | tuple[DataFrame, DataFrame] | None = None, threshold: float | None = None, options: Options | dict | None = None,
    output: str | None = None, discovery: bool = True, quant: bool = True, stranded: bool = False, track_reads: bool = False, distances: bool = False, by_chromosome: bool = False, fusion: bool = False,
) -> Result:
    """The whole workflow.

    reads: a path of BAM, SAM or saved read classes (.parquet), several, or {sample: path or table of reads}. annotations: prepared ones or a path.
    sequence: a FASTA path, or (chunks, lengths). threshold: the novel discovery rate (None: recommended). output: a folder for read classes.
    Without quant and discovery only the classes are made, without quant also the annotation."""
    o = options if isinstance(options, Options) else Options().with_(**(options or {}))
    files = bam.sample_files(reads)
    if isinstance(annotations, str):
        annotations = written(prepare_annotations(spark, annotations))
    told = check_inputs(files, annotations, sequence, o.prefix)
    known = annotations if annotations is not None else spark.createDataFrame([], EMPTY)
    if isinstance(sequence, str):
        sequence = (genome.read_fasta(spark, sequence), genome.lengths(spark, sequence))
    by_sample: dict[str, tuple[DataFrame, DataFrame]] = {}
    warned: dict[str, list[str]] = {"": told} if told else {}
    for name, source in files.items():
        if isinstance(source, str) and source.rstrip("/").endswith(".parquet"):
            by_sample[name.removesuffix("_readClasses")] = load_classes(spark, source)
            continue
        classes, members, _, w = process_reads(_reads(spark, source), known, sequence[0], sequence[1], o, stranded, by_chromosome, fusion)
        if output:
            classes, members = load_classes(spark, save_classes(classes, members, output, name))
        by_sample[name] = classes, members
        if w:
            warned[name] = w
    every = None
    for name, (classes, _) in by_sample.items():
        c = classes.withColumn("sample", F.lit(name))
        every = c if every is None else every.unionByName(c)
    out = Result(every, warnings=warned)
    if discovery:
        bounds = {"least_reads": o.least_reads, "least_prop": o.least_share_of_gene, "least_multi": o.least_score_multi, "least_single": o.least_score_single}
        out.annotations, out.threshold = extend.extended(
            samples.candidates(every, stranded, **bounds), known, threshold, o.least_samples, o.exon_distance, o.exon_overlap, o.slack, o.slack_ends_discovery,
            o.drop_subsets, o.least_share_of_class, o.base_rate, fusion, o.prefix, o.default_models,
        )
        out.annotations = written(out.annotations)
    elif quant:
        out.annotations = written(extend.original(known))
    if not quant:
        return out
    if out.annotations.isEmpty():
        raise ValueError("there are no transcripts to count; try a higher threshold")
    for name, (classes, members) in by_sample.items():
        q = quantify.sample_counts(classes, out.annotations, o.degradation_bias, o.max_iterations, o.tolerance, o.exon_distance, o.slack, o.slack_ends_quant, o.places)
        tables = {"counts": q["counts"], "incompatible": q["incompatible"]}
        if distances:
            tables["distances"] = q["distances"]
        if track_reads:
            tables["read_maps"] = quantify.read_map(members, q["distances"])
        for key, d in tables.items():
            d, old = d.withColumn("sample", F.lit(name)), getattr(out, key)
            setattr(out, key, d if old is None else old.unionByName(d))
    return out


def train_models(classes: DataFrame, least_reads: int = 2, rounds: int = 50, threshold: float = 0.1) -> scoring.TranscriptModels | None:
    """Models from one sample's scored read classes, for Options.default_models of other samples; None where it has too few labels."""
    return scoring.train(classes.filter("num_reads is not null"), rounds, threshold, least_reads)


def transcript_to_gene_expression(result: Result) -> DataFrame:
    """gene, sample, counts, cpm."""
    return quantify.gene_expression(result.counts, result.incompatible)


def write_output(result: Result, path: str, prefix: str = "") -> None:
    gtf.write_output(result.annotations, result.counts, result.incompatible, path, prefix)
