"""Chromosome names, their order and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of the human assembly hg19, in the order in which chromosomes sort.
HG19 = {
    "chr1": 249250621, "chr2": 243199373, "chr3": 198022430, "chr4": 191154276, "chr5": 180915260,
    "chr6": 171115067, "chr7": 159138663, "chr8": 146364022, "chr9": 141213431, "chr10": 135534747,
    "chr11": 135006516, "chr12": 133851895, "chr13": 115169878, "chr14": 107349540, "chr15": 102531392,
    "chr16": 90354753, "chr17": 81195210, "chr18": 78077248, "chr19": 59128983, "chr20": 63025520,
    "chr21": 48129895, "chr22": 51304566, "chrX": 155270560, "chrY": 59373566, "chrM": 16571,
}
NAMES = tuple(HG19)


def canonical(chrom: Column) -> Column:
    """chrMT is another name of chrM; others stay."""
    return F.when(chrom == "chrMT", "chrM").otherwise(chrom)


def is_standard(chrom: Column) -> Column:
    """Exactly the 25 names (after canonical)."""
    return canonical(chrom).isin(*NAMES)


def order_of(chrom: Column) -> Column:
    """1 to 25, null for other names."""
    return F.when(is_standard(chrom), F.array_position(F.array(*(F.lit(n) for n in NAMES)), canonical(chrom)).cast("int"))


def name_of(order: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for n in NAMES)), order - 1)


def genome(spark: SparkSession, lengths: dict[str, int] | None = None) -> DataFrame:
    """chrom, ord, length: one row a chromosome."""
    rows = [(n, NAMES.index(n) + 1 if n in NAMES else i + 26, size) for i, (n, size) in enumerate((lengths or HG19).items())]
    return spark.createDataFrame(rows, "chrom string, ord int, length long").coalesce(1)
