"""Per-read filters, summaries, trimming and modified-base tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalars import alignment_counts, barcode_name, cigar_ops, op_sum
from seqloom.session import ship


def read_filter(reads: DataFrame, id_: str, quality: str, length: str, min_quality: float = 0, min_length: int = 0, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): dropped if quality is too low (only for min_quality > 0), too short or blocked."""
    low = (F.col(quality) < min_quality) if min_quality > 0 else F.lit(False)
    out = reads.withColumn("_low", F.coalesce(low | (F.col(length) < min_length), F.lit(False)))
    if blocked is None:
        out = out.withColumn("_drop", F.col("_low"))
    else:
        ids = blocked.select(F.col("id").alias("_id")).distinct()
        out = out.join(ids, F.col(id_) == F.col("_id"), "left").withColumn("_drop", F.col("_low") | F.col("_id").isNotNull()).drop("_id")
    return out.where("NOT _drop").drop("_low", "_drop"), out.where("_drop").drop("_low", "_drop")


def drop_report(dropped: DataFrame, duplex: str, length: str) -> DataFrame:
    """(is_duplex, reads, bases) of what a filter dropped."""
    return dropped.groupBy(F.col(duplex).alias("is_duplex")).agg(F.count("*").alias("reads"), F.sum(length).alias("bases"))


def summary(reads: DataFrame, alignments: DataFrame, counts: DataFrame, groups: DataFrame | None = None, key: str = "read_id") -> DataFrame:
    """One wide row per primary alignment of a read: read, group, alignment and count columns.

    alignments: key, is_primary, matches, aligned, ref_length, length and
    columns to carry. Ratios with an empty divisor are 0; a read without
    alignment has genome `*`, -1 for places and 0 for counts.
    """
    out = reads.join(alignments.where("is_primary").drop("is_primary"), key, "left").join(counts, key, "left")
    if groups is not None:
        out = out.join(groups, "run_id", "left")
    return out

#: The groups of summary columns beside the general ones.
SUMMARY_GROUPS = ("basecalling", "polya", "experiment", "barcoding", "alignment", "duplex")


def sequencing_summary(records: DataFrame, groups: DataFrame | None = None, counts: DataFrame | None = None, fields: tuple[str, ...] = SUMMARY_GROUPS) -> DataFrame:
    """The summary of primary records: 10 general columns and those of the groups asked for, 58 in all.

    records: SAM columns with `tags` (values as text, arrays as `B` fields say
    them), and if there are any `barcode_name`, `barcode_alias`, `barcode_type`
    and `barcode_kit`. groups(rg_id, run_id, start_time_ms, is_pass, stride,
    experiment_id, sample_id) meets the RG tag, counts(name, mapped,
    secondary, supplementary) the read's name. Secondary and supplementary
    records have no row. What a record lacks has its default: `unknown`,
    `not_set`, `*`, `-` for parents, -1, -2 for the tail's length, 0 for numbers. Ratios of an
    alignment without matches are NaN; times without a duration are 0.
    """
    unknown = set(fields) - set(SUMMARY_GROUPS)
    if unknown:
        raise ValueError(f"no such summary columns: {sorted(unknown)}")
    r = records.where("(flag & 2304) = 0")
    for c in ("barcode_name", "barcode_alias", "barcode_type", "barcode_kit"):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast("string"))
    info = [("run_id", "string"), ("start_time_ms", "bigint"), ("is_pass", "boolean"), ("stride", "int"), ("experiment_id", "string"), ("sample_id", "string")]
    r = r.drop(*[c for c, _ in info])
    if groups is not None:
        r = r.withColumn("_rg", F.col("tags")["RG"]).join(groups.select(F.col("rg_id").alias("_rg"), *[c for c, _ in info]), "_rg", "left")
    else:
        r = r.withColumns({c: F.lit(None).cast(t) for c, t in info})
    if counts is not None:
        named = counts.select(F.col("name").alias("_name"), F.col("mapped").alias("_mapped"), F.col("secondary").alias("_secondary"), F.col("supplementary").alias("_supplementary"))
        r = r.join(named, F.col("qname") == F.col("_name"), "left")
    else:
        r = r.withColumns({c: F.lit(None).cast("bigint") for c in ("_mapped", "_secondary", "_supplementary")})
    out: dict[str, str] = {}
    tag = lambda t, kind, default: f"coalesce(try_cast(tags['{t}'] AS {kind}), {default})"
    numbers = lambda t, kind: f"transform(slice(split(tags['{t}'], ','), 2, 99), x -> try_cast(x AS {kind}))"
    start = "coalesce(start_time_ms, 0) / 1000D"
    rate = f"if({tag('du', 'double', '0D')} > 0, {tag('ns', 'int', '0')} / {tag('du', 'double', '0D')}, 0D)"
    samples = f"({tag('ns', 'int', '0')} - {tag('ts', 'int', '0')})"
    length = "if(seq = '*', 0, length(seq))"
    out |= {
        "input_filename": tag("fn", "string", "'unknown'"), "batch_id": "0", "parent_read_id": "coalesce(tags['pi'], qname)", "read_id": "qname", "run_id": "coalesce(run_id, '')",
        "channel": tag("ch", "int", "0"), "mux": tag("mx", "int", "0"), "minknow_events": tag("me", "bigint", "0L"), "start_time": start, "duration": tag("du", "double", "0D"),
    }
    if "basecalling" in fields:
        out |= {
            "passes_filtering": "coalesce(is_pass, false)", "template_start": f"if({rate} <> 0, {start} + {tag('ts', 'int', '0')} / {rate}, 0D)",
            "num_events_template": f"if(coalesce(stride, 0) > 0, {samples} div stride, 0L)", "template_duration": f"if({rate} <> 0, {samples} / {rate}, 0D)",
            "sequence_length_template": length, "mean_qscore_template": tag("qs", "double", "0D"),
        }
    if "polya" in fields:
        # the first number of `pa` is the anchor
        out["poly_tail_length"] = tag("pt", "int", "-2")
        for i, name in enumerate(("poly_tail_start", "poly_tail_end", "poly_tail2_start", "poly_tail2_end")):
            out[name] = f"coalesce(get({numbers('pa', 'int')}, {i + 1}), -1)"
    if "experiment" in fields:
        out |= {"pore_type": tag("po", "string", "'not_set'"), "experiment_id": "coalesce(nullif(experiment_id, ''), 'unknown')", "sample_id": "coalesce(sample_id, '')", "end_reason": tag("er", "string", "'unknown'")}
    if "barcoding" in fields:
        known = lambda x, default: f"if(barcode_name IS NULL, {default}, {x})"
        r = r.withColumn("_arrangement", F.when(F.col("barcode_name") == "unclassified", "unclassified").otherwise(barcode_name("barcode_name")))
        info_of = lambda i, kind, default: f"if(barcode_name IS NOT NULL AND size({numbers('bi', 'double')}) = 7, cast({numbers('bi', 'double')}[{i}] AS {kind}), {default})"
        out |= {
            "alias": known("coalesce(nullif(barcode_alias, ''), _arrangement)", "'unknown'"), "type": known("coalesce(barcode_type, '')", "'unknown'"), "barcode_arrangement": known("_arrangement", "'unknown'"),
            "barcode_kit": known("coalesce(barcode_kit, '')", "'unknown'"), "barcode_variant": known("coalesce(tags['bv'], 'n/a')", "'unknown'"), "barcode_score": info_of(0, "double", "-1D"),
            "barcode_front_score": info_of(3, "double", "-1D"), "barcode_front_foundseq_length": info_of(2, "int", "-1"), "barcode_front_begin_index": info_of(1, "int", "-1"),
            "barcode_rear_score": info_of(6, "double", "-1D"), "barcode_rear_foundseq_length": info_of(5, "int", "-1"), "barcode_rear_end_index": info_of(4, "int", "-1"),
        }
    if "alignment" in fields:
        r = r.withColumn("_ops", cigar_ops("cigar")).withColumn("_nm", F.expr(tag("NM", "int", "0")))
        r = r.withColumn("_c", alignment_counts("_ops", "_nm")).withColumn("_span", op_sum("_ops", "MDN=X")).withColumn("_right", F.expr("_c.matches - if(tags['NM'] IS NULL, 0, _c.substitutions)"))
        mapped = lambda x, default: f"if((flag & 4) = 0, {x}, {default})"
        ratio = lambda a, b: mapped(f"coalesce(try_divide(cast({a} AS double), {b}), double('NaN'))", "0D")
        to = f"({length} - _c.softclip_end)"
        out |= {
            "alignment_genome": mapped("rname", "'*'"), "alignment_direction": mapped("if((flag & 16) <> 0, '-', '+')", "'*'"), "alignment_genome_start": mapped("pos - 1", "-1"), "alignment_genome_end": mapped("pos - 1 + greatest(_span, 1)", "-1"),
            "alignment_strand_start": mapped("_c.softclip_start", "-1"), "alignment_strand_end": mapped(to, "-1"), "alignment_num_insertions": mapped("_c.insertions", "0"), "alignment_num_deletions": mapped("_c.deletions", "0"),
            "alignment_num_aligned": mapped("_c.matches", "0"), "alignment_num_correct": mapped("_right", "0"), "alignment_identity": ratio("_right", "_c.matches"), "alignment_accuracy": ratio("_right", "_c.matches + _c.insertions + _c.deletions"),
            "alignment_score": mapped(tag("AS", "int", "0"), "0"), "alignment_coverage": ratio(f"({to} - _c.softclip_start)", length), "alignment_bed_hits": mapped(tag("bh", "int", "0"), "0"), "alignment_mapping_quality": mapped("mapq", "0"),
            "alignment_num_alignments": mapped("coalesce(_mapped, 0L)", "0L"), "alignment_num_secondary_alignments": mapped("coalesce(_secondary, 0L)", "0L"), "alignment_num_supplementary_alignments": mapped("coalesce(_supplementary, 0L)", "0L"),
        }
    if "duplex" in fields:
        # a duplex read is named template;complement
        two = "split(qname, ';')"
        out |= {f"duplex_parent_{n}": f"if(size({two}) = 2, {two}[{i}], '-')" for i, n in enumerate(("template", "complement"))}
    return r.select(*[F.expr(e).alias(c) for c, e in out.items()])



def write_accounting(records: DataFrame, flag: str = "flag", duplex: str = "is_duplex", parent: str = "parent_read_id", subread: str = "subread_id") -> DataFrame:
    """One row of counters. Every record counts by its flag, a duplex one too.

    Only records that are not duplex count as split (they name a parent read)
    and as unique simplex reads (sub-read 0, unmapped or primary).
    """
    bit = lambda b: F.expr(f"({flag} & {b}) <> 0")
    is_duplex = F.coalesce(F.col(duplex), F.lit(False))
    primary = F.expr(f"({flag} & 2308) = 0")
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(bit(4)).alias("unmapped"),
        F.count_if(bit(256)).alias("secondary"),
        F.count_if(bit(2048)).alias("supplementary"),
        F.count_if(primary).alias("primary"),
        F.count_if(is_duplex).alias("duplex"),
        F.count_if(~is_duplex & F.col(parent).isNotNull()).alias("split"),
        F.count_if(~is_duplex & (F.coalesce(F.col(subread), F.lit(0)) == 0) & (bit(4) | primary)).alias("unique_simplex"),
    )


def _mux_ends(texts: pd.Series) -> pd.Series:
    def end(text: str | None) -> int | None:
        if text is None or len(text) < 100:
            return None if text is None else len(text)
        n = len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1]
        sums = np.cumsum(np.where(codes <= 40, -1, np.where(codes <= 45, 1, 10)))
        least = sums.min()
        # the last place of the least sum, seen from the 3' end
        cut = n - 1 if least > -1 else n - 2 - (n - 1 - int(np.argmin(sums[::-1])))
        return n if cut < n * 3 // 10 or cut >= n - 5 else cut

    return pd.Series([end(t) for t in texts], dtype="Int32")


def mux_trim_end(q: str) -> Column:
    """Number of bases kept of a read that a mux change ended, by its Phred+33 text.

    From the 3' end, qualities score -1 (<= 7), 1 (<= 12) or 10; the read is cut
    before the last place where the sum reaches its least value, -1 at most.
    All bases are kept if it has under 100, if under 30 % or all but 5 would stay.
    A text is one vector in its row's batch; the session needs ship().
    """
    return F.pandas_udf(_mux_ends, "int")(q)


def trim(reads: DataFrame, start: str, end: str) -> DataFrame:
    """Cuts seq, qual, moves, ts and ns of reads to bases [start, end); adds valid.

    stride samples belong to each move. Reads whose interval is not within the
    sequence are left as they are and not valid.
    """
    ok = F.expr(f"{start} >= 0 AND {start} <= {end} AND {end} <= length(seq)")
    bases = "filter(transform(moves, (m, i) -> if(m = 1, i, null)), x -> x IS NOT NULL)"
    first = f"coalesce(try_element_at({bases}, {start} + 1), size(moves))"
    last = f"coalesce(try_element_at({bases}, {end} + 1), size(moves))"
    out = reads.withColumns({"valid": ok, "_first": F.expr(first), "_last": F.expr(last)})
    cut = {
        "seq": f"substr(seq, {start} + 1, {end} - {start})",
        "qual": f"substr(qual, {start} + 1, {end} - {start})",
        "moves": "slice(moves, _first + 1, greatest(0, _last - _first))",
        "ts": "ts + _first * stride",
        "ns": "greatest(0, _last - _first) * stride + greatest(0, ts + _first * stride)",
    }
    return out.withColumns({c: F.expr(f"CASE WHEN valid THEN {e} ELSE {c} END") for c, e in cut.items()}).drop("_first", "_last")


def decode_modbases(reads: DataFrame, id_: str) -> DataFrame:
    """(id_, position, base, code, context, prob) from seq, MM (`C+m?,skip,...;`) and ML.

    A skip counts canonical bases passed over; probabilities follow in order
    over all groups. Several codes of one group share its skips and take their
    probabilities in turn.
    """
    ship(reads.sparkSession)
    kinds = [reads.schema[id_].dataType, reads.schema["ml"].dataType.elementType]
    schema = "id {0}, position int, base string, code string, context string, prob {1}".format(*(k.simpleString() for k in kinds))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = schema_of(batch.schema.field("id").type, batch.schema.field("ml").type.value_type)
            out = [[] for _ in schema]
            ids, seqs, mms = (_values(c) for c in batch.columns[:3])
            probs, ends = _values(batch.column(3).flatten()), [0, *np.cumsum(batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()]
            for name, seq, mm, i, j in zip(ids, seqs, mms, ends, ends[1:]):
                hits = _hits(seq or "", mm or "", probs[i:j])
                for column, found in zip(out, ([name] * len(hits[0]), *hits)):
                    column += found
                if len(out[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in schema]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    def schema_of(id_type: pa.DataType, prob: pa.DataType) -> pa.Schema:
        return pa.schema([("id", id_type), ("position", pa.int32()), ("base", pa.string()), ("code", pa.string()), ("context", pa.string()), ("prob", prob)])

    rows = reads.select(F.col(id_).alias("id"), "seq", "mm", "ml")
    return rows.mapInArrow(decode, schema).withColumnRenamed("id", id_)


#: Rows that go back to Spark at a time.
BATCH = 1 << 15
_CODES = re.compile("[+-]([a-zA-Z]+|[0-9]+)")


def _values(column: pa.Array) -> list:
    """A column as a list; without nulls by way of its array, which is quicker."""
    return column.to_pylist() if column.null_count or pa.types.is_nested(column.type) else column.to_numpy(zero_copy_only=False).tolist()


@lru_cache(4096)
def _head(head: str) -> tuple[str, list[str], str]:
    """(base, codes, context) of the first part of a group."""
    found = _CODES.search(head)
    found = found[1] if found else ""
    return head[:1], [found] if found[:1].isdigit() else list(found), head[-1] if head[-1:] in ("?", ".") else "."


def _hits(seq: str, mm: str, ml: Sequence) -> tuple[list, list, list, list, list]:
    """Positions, bases, codes, contexts and probabilities of a read; null where there are too few places or probabilities."""
    positions, bases, coded, contexts, places = [], [], [], [], {}
    for group in mm.split(";"):
        if not group:
            continue
        head, *skips = group.split(",")
        base, codes, context = _head(head)
        if base not in places:
            places[base] = range(len(seq)) if base == "N" else [i for i, c in enumerate(seq) if c == base]
        at, k, n = places[base], -1, len(codes)
        for skip in skips:
            k += int(skip) + 1
            positions += [at[k] if 0 <= k < len(at) else None] * n
        coded += codes * len(skips)
        bases += [base] * (n * len(skips))
        contexts += [context] * (n * len(skips))
    n = len(positions)
    return positions, bases, coded, contexts, ml[:n] if len(ml) >= n else [*ml, *[None] * (n - len(ml))]


def encode_modbases(mods: DataFrame, reads: DataFrame, id_: str) -> DataFrame:
    """(id_, mm, ml) from decode_modbases() rows; groups in order of base and code.

    A read's sequence and rows come one after another in its task and are written as they pass by.
    """
    ship(reads.sparkSession)
    kinds = {c: mods.schema[c].dataType.simpleString() for c in (id_, "prob")}
    null = F.lit(None)
    hits = mods.select(F.col(id_).alias("id"), null.cast("string").alias("seq"), "base", "code", "context", F.col("position").cast("bigint").alias("position"), "prob")
    seqs = reads.where("seq IS NOT NULL").select(F.col(id_).alias("id"), "seq", *[null.cast(t).alias(c) for c, t in (("base", "string"), ("code", "string"), ("context", "string"), ("position", "bigint"), ("prob", kinds["prob"]))])
    rows = hits.unionByName(seqs).where("id IS NOT NULL").repartition("id").sortWithinPartitions("id", F.col("seq").isNull(), "base", "code", "context", "position", "prob")
    # one text for what a group begins with; -1 for no place
    rows = rows.select("id", F.coalesce("seq", F.lit("")).alias("seq"), F.col("seq").isNotNull().alias("is_seq"), F.coalesce("base", F.lit("")).alias("base"), F.coalesce(F.concat("base", F.lit("+"), "code", "context", F.lit(",")), F.lit("")).alias("head"), F.coalesce("position", F.lit(-1).cast("bigint")).alias("position"), "prob")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, schema = None, None, None
        mm, key, last, skips, n = [], None, 0, [], 0
        ids, texts, ends, probs = [], [], [0], []

        def flush() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(probs[: ends[-1]], schema.field("ml").type.value_type))
            out = pa.RecordBatch.from_arrays([pa.array(ids, schema.field("id").type), pa.array(texts, pa.string()), lists.cast(schema.field("ml").type)], schema=schema)
            del probs[: ends[-1]]
            ids.clear()
            texts.clear()
            ends[:] = [0]
            return out

        def close() -> None:
            if key:
                mm.append(key + ",".join(skips) + ";")

        def done() -> None:
            close()
            ids.append(now)
            texts.append("".join(mm))
            ends.append(len(probs))

        for batch in batches:
            if schema is None:
                schema = pa.schema([("id", batch.schema.field("id").type), ("mm", pa.string()), ("ml", pa.list_(batch.schema.field("prob").type))])
            known = batch.column(6)
            columns = [_values(c) for c in batch.columns[:6]]
            # nulls of the rows that hold sequences, of which nothing is taken
            columns.append(known.to_pylist() if pc.sum(pc.and_(known.is_null(), pc.invert(batch.column(2)))).as_py() else known.fill_null(0).to_numpy(zero_copy_only=False).tolist())
            for name, seq, is_seq, base, head, position, prob in zip(*columns):
                if name != now:
                    if n:
                        done()
                        if len(probs) >= BATCH:
                            yield flush()
                    now, whole, mm, key, n = name, None, [], None, 0
                if is_seq:
                    whole = seq
                    continue
                if whole is None:
                    continue
                if key != head:
                    close()
                    key, last, skips = head, 0, []
                # bases from the last place, itself not counted, up to this one
                if position >= 0 and last >= 0:
                    skips.append(str((position - last if base == "N" else whole.count(base, last, position)) - (len(skips) > 0)))
                last = position
                probs.append(prob)
                n += 1
        if n:
            done()
        if ids:
            yield flush()

    return rows.mapInArrow(encode, f"id {kinds[id_]}, mm string, ml array<{kinds['prob']}>").withColumnRenamed("id", id_)


def trim_modbases(reads: DataFrame, id_: str, start: str, end: str) -> DataFrame:
    """(id_, mm, ml) of the bases [start, end): decoded, cut and encoded against the kept sequence."""
    kept = reads.select(id_, F.col(start).alias("_start"), F.col(end).alias("_end"), F.expr(f"substr(seq, {start} + 1, {end} - {start})").alias("seq"))
    mods = decode_modbases(reads, id_).join(kept.select(id_, "_start", "_end"), id_).where("position >= _start AND position < _end")
    return encode_modbases(mods.withColumn("position", F.col("position") - F.col("_start")).drop("_start", "_end"), kept, id_)


def modbase_mask(mods: DataFrame, keys: list[str], threshold: float, motif: str | None = None) -> DataFrame:
    """(keys, keep): any modification reaches the threshold; a base with a motif context keeps that mask."""
    out = mods.groupBy(*keys).agg(F.bool_or(F.col("prob") >= threshold).alias("keep"), *([F.bool_or(motif).alias("_motif")] if motif else []))
    return out.withColumn("keep", F.coalesce("_motif", "keep")).drop("_motif") if motif else out
