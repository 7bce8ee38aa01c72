"""The summary's defaults and its text form."""

import math

import pytest

from seqloom.operators import reads
from seqloom.sources import sinks

COLUMNS = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, tags map<string,string>"


def test_defaults(spark):
    rows = [
        ("bare", 4, "*", 0, 0, "*", "*", {}), ("none", 0, "c", 5, 9, "*", "ACGT", None), ("t;c", 16, "c", 1, 60, "2S4M1D3M1S", "ACGTACGTAC", {"NM": "2", "bi": "f,1,2,3", "pa": "i,4,1,9"}),
        ("skip", 256, "c", 1, 0, "4M", "ACGT", {}), ("skip", 2064, "c", 1, 0, "4M", "ACGT", {}),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.read_id: r for r in reads.sequencing_summary(df).collect()}
    assert set(got) == {"bare", "none", "t;c"} and len(got["bare"]) == 58
    b = got["bare"].asDict()
    assert [b[c] for c in ("input_filename", "parent_read_id", "run_id", "pore_type", "experiment_id", "end_reason", "alias", "barcode_variant", "alignment_genome", "alignment_direction", "duplex_parent_template")] == ["unknown", "bare", "", "not_set", "unknown", "unknown", "unknown", "unknown", "*", "*", "-"]
    assert [b[c] for c in ("poly_tail_length", "poly_tail_start", "barcode_score", "barcode_rear_end_index", "alignment_genome_start", "alignment_strand_end", "alignment_identity", "template_start", "num_events_template", "sequence_length_template", "alignment_num_alignments")] == [-2, -1, -1, -1, -1, -1, 0, 0, 0, 0, 0]
    assert math.isnan(got["none"].alignment_identity) and got["none"].alignment_genome_end == 5 and got["none"].alignment_coverage == 1
    t = got["t;c"]
    assert (t.duplex_parent_template, t.duplex_parent_complement, t.alignment_direction) == ("t", "c", "-")
    assert (t.alignment_genome_start, t.alignment_genome_end, t.alignment_strand_start, t.alignment_strand_end) == (0, 8, 2, 9)
    assert (t.alignment_num_aligned, t.alignment_num_correct, t.alignment_num_deletions, t.alignment_accuracy) == (7, 6, 1, 0.75)
    assert (t.poly_tail_start, t.poly_tail_end, t.poly_tail2_start, t.barcode_score) == (1, 9, -1, -1)


def test_groups_of_columns_and_text(spark):
    df = spark.createDataFrame([("r", 0, "c", 5, 9, "*", "ACGT", {"du": "0.5", "ns": "1000", "ts": "100"})], COLUMNS)
    assert len(reads.sequencing_summary(df, fields=()).columns) == 10
    header, lines = sinks.summary_lines(reads.sequencing_summary(df, fields=("basecalling", "duplex")))
    assert header.split("\t")[-2:] == ["duplex_parent_template", "duplex_parent_complement"]
    assert lines.collect()[0].value.split("\t") == ["unknown", "0", "r", "r", "", "0", "0", "0", "0.000000", "0.500000", "FALSE", "0.050000", "0", "0.450000", "4", "0.000000", "-", "-"]
    with pytest.raises(ValueError):
        reads.sequencing_summary(df, fields=("general",))
    assert reads.sequencing_summary(df.limit(0)).collect() == []
