"""Schemas and identifiers.

Positions are 0-based and half-open. Counts are sparse: a missing (cell, feature) is
zero. A cell is (sample, barcode), shown as "sample::barcode".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<start:bigint,end:bigint>>"
CIGAR = "array<struct<op:int,len:int>>"

READS = (
    "sample string, read_seq bigint, query_name string, flag int, chrom string, start bigint, end bigint, mapq int, "
    f"cigar {CIGAR}, blocks {BLOCKS}, mate_chrom string, mate_start bigint, tlen int, fwd_seq string, query_len int, "
    "bc string, grp string, umi string"
)
CONTIGS = "chrom string, length bigint, chrom_idx int"
REGIONS = f"chrom string, start bigint, end bigint, name string, strand string, exons {BLOCKS}"
BLACKLIST = "chrom string, start bigint, end bigint"
GROUPS = "sample string, barcode string, cluster string"
COUNTS = "cell_id string, feature_id string, count double"
OBS = "cell_id string, sample string, barcode string"
VAR = "feature_id string, chrom string, start bigint, end bigint, name string"

# Bits of a SAM flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, DUPLICATE = 1, 2, 4, 8, 16, 32, 64, 128, 256, 1024


def cell_id(sample: str | Column = "sample", barcode: str | Column = "bc") -> Column:
    return F.concat_ws("::", sample, barcode)


def feature_id(chrom="chrom", start="start", end="end", name=None) -> Column:
    """chrom_start_end::name, "None" for a bin. Display only: split typed columns, not this."""
    return F.concat_ws("::", F.concat_ws("_", chrom, F.col(start).cast("string"), F.col(end).cast("string")), F.lit("None") if name is None else F.col(name))


def has(mask: int, flag: str | Column = "flag") -> Column:
    """All bits of the mask are set."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return f.bitwiseAND(F.lit(mask)) == mask


def lacks(mask: int, flag: str | Column = "flag") -> Column:
    """No bit of the mask is set."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return f.bitwiseAND(F.lit(mask)) == 0
