"""Column functions on sequences, qualities, CIGARs and tags; no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_qscore(q: str) -> Column:
    """Mean error of Phred+33 text as a quality, clamped to [1, 50]; empty gives 0."""
    errors = f"transform(filter(split({q}, ''), c -> c <> ''), c -> pow(10D, -(ascii(c) - 33) / 10D))"
    return F.expr(f"CASE WHEN {q} IS NULL THEN NULL WHEN length({q}) = 0 THEN 0D ELSE least(50D, greatest(1D, -10D * log10(aggregate({errors}, 0D, (a, x) -> a + x) / length({q})))) END")


def mean_qscore_from(q: str, start: int) -> Column:
    """mean_qscore() of the part after `start`; of all of it if it isn't longer."""
    return mean_qscore(f"if(length({q}) <= {start}, {q}, substr({q}, {start + 1}))")


def rna_poly_a_start(seq: str) -> Column:
    """0-based start of the last run of 5 or more A in the final 200 bases; length if none."""
    tail = f"right({seq}, 200)"
    head = f"regexp_extract({tail}, '(?s)^(.*(?:[^A]|^))A{{5,}}', 1)"
    return F.expr(f"CASE WHEN {tail} RLIKE 'A{{5,}}' THEN greatest(length({seq}) - 200, 0) + length({head}) ELSE length({seq}) END")


def reverse_complement(seq: str) -> Column:
    return F.reverse(F.translate(F.col(seq), "ACGTacgt", "TGCAtgca"))


def leading_count(seq: str, base: str) -> Column:
    return F.expr(f"length({seq}) - length(ltrim('{base}', {seq}))")


def trailing_count(seq: str, base: str) -> Column:
    return F.expr(f"length({seq}) - length(rtrim('{base}', {seq}))")


def moves_to_samples(moves: str, stride: str) -> Column:
    """Sample at which each base begins (moves equal to 1, times stride), and the end."""
    return F.expr(f"array_append(filter(transform({moves}, (m, i) -> if(m = 1, cast(i AS bigint) * {stride}, null)), x -> x IS NOT NULL), cast(size({moves}) AS bigint) * {stride})")


#: Elements whose running sums are made at once; an array that grows by one is copied each time.
SUM_BLOCK = 128


def sums_before(values: str) -> str:
    """SQL of an array: for each element of the array `values`, the sum of those before it, as bigint.

    Sums of blocks come first, then those within each, so the work grows with
    the length and not its square. Behind the last element's there may be one more.
    """
    blocks = f"sequence(0, (size(v_) - 1) div {SUM_BLOCK})"
    block = f"slice(v_, b_ * {SUM_BLOCK} + 1, {SUM_BLOCK})"
    grow = "(a_, x_) -> array_append(a_, element_at(a_, -1) + x_)"
    starts = f"aggregate({blocks}, array(0L), (a_, b_) -> array_append(a_, element_at(a_, -1) + aggregate({block}, 0L, (t_, x_) -> t_ + x_)))"
    # transform(array(x), v -> ...)[0] takes x once and calls it v
    return f"transform(array({values}), v_ -> transform(array({starts}), s_ -> flatten(transform({blocks}, b_ -> slice(aggregate({block}, array(s_[b_]), {grow}), 1, {SUM_BLOCK}))))[0])[0]"


def move_sums(moves: str) -> Column:
    """Running number of bases after each move."""
    return F.expr(f"transform(array({sums_before(moves)}), q_ -> transform({moves}, (m, i) -> q_[i] + m))[0]")


def base_to_move(moves: str, base: str) -> Column:
    """0-based index of the move that emits 0-based base; null if there are fewer."""
    return F.expr(f"try_element_at(filter(transform({moves}, (m, i) -> if(m = 1, i, null)), x -> x IS NOT NULL), cast({base} AS int) + 1)")


#: The IUPAC letters.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "[AG]", "Y": "[CT]", "S": "[GC]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}


def motif_regex(motif: str) -> str:
    return "".join(IUPAC[c] for c in motif.upper())


def motif_hits(seq: str, motif: str, offset: int = 0) -> Column:
    """0-based places of all overlapping hits, plus offset."""
    m = len(motif)
    # the inner array binds the characters once; cutting each piece from the text would be quadratic
    hits = f"transform(array(filter(split({seq}, ''), c -> c <> '')), cs -> filter(transform(sequence(0, size(cs) - {m}), i -> if(array_join(slice(cs, i + 1, {m}), '') RLIKE '^{motif_regex(motif)}$', i + {offset}, null)), x -> x IS NOT NULL))[0]"
    return F.expr(f"CASE WHEN length({seq}) < {m} THEN array() ELSE {hits} END").cast("array<int>")


def decode_contexts(text: str) -> Column:
    """Four `:`-separated motifs, `_` for none, X at the canonical base: array of (base, motif, offset)."""
    return F.expr(f"filter(transform(split({text}, ':'), (m, i) -> struct(substr('ACGT', i + 1, 1) AS base, replace(m, 'X', substr('ACGT', i + 1, 1)) AS motif, instr(m, 'X') - 1 AS offset)), x -> x.motif <> '_')")


def encode_contexts(contexts: str) -> Column:
    """The inverse of decode_contexts()."""
    one = f"try_element_at(filter({contexts}, c -> c.base = b), 1)"
    return F.expr(f"array_join(transform(array('A', 'C', 'G', 'T'), b -> coalesce(overlay({one}.motif PLACING 'X' FROM {one}.offset + 1 FOR 1), '_')), ':')")


def cigar_ops(cigar: str) -> Column:
    """array<struct<len: int, op: string>>; `*`, null and empty give no operations."""
    return F.expr(f"transform(regexp_extract_all(coalesce({cigar}, ''), '([0-9]+)([MIDNSHP=X])', 0), x -> struct(cast(left(x, length(x) - 1) AS int) AS len, right(x, 1) AS op))")


def format_cigar(ops: str) -> Column:
    return F.expr(f"array_join(transform({ops}, x -> concat(x.len, x.op)), '')")


def op_sum(ops: str, kinds: str) -> Column:
    return F.expr(f"aggregate(filter({ops}, x -> instr('{kinds}', x.op) > 0), 0, (a, x) -> a + x.len)")


def alignment_counts(ops: str, nm: str) -> Column:
    """struct of matches, insertions, deletions, soft clips at either end, substitutions."""
    clip = lambda i: f"coalesce(if(try_element_at({ops}, {i}).op = 'S', try_element_at({ops}, {i}).len, 0), 0)"
    ins, dele = f"aggregate(filter({ops}, x -> x.op = 'I'), 0, (a, x) -> a + x.len)", f"aggregate(filter({ops}, x -> x.op = 'D'), 0, (a, x) -> a + x.len)"
    return F.expr(f"named_struct('matches', aggregate(filter({ops}, x -> x.op IN ('M', '=', 'X')), 0, (a, x) -> a + x.len), 'insertions', {ins}, 'deletions', {dele}, 'softclip_start', {clip(1)}, 'softclip_end', if(size({ops}) > 1, {clip(-1)}, 0), 'substitutions', {nm} - {dele} - {ins})")


def accuracies(ops: str, nm: str) -> Column:
    """struct snp, total: 1 - substitutions / matches and 1 - NM / aligned length, in [0, 1]; 0 if degenerate."""
    m, i, d = op_sum(ops, "M=X"), op_sum(ops, "I"), op_sum(ops, "D")
    n = F.col(nm)
    clamp = lambda x: F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), F.lit(0.0))
    return F.struct(clamp(1 - F.try_divide(n - d - i, m)).alias("snp"), clamp(1 - F.try_divide(n, m + i + d)).alias("total"))


def barcode_name(name: str) -> Column:
    """barcodeNN from the last digits of a name."""
    return F.concat(F.lit("barcode"), F.regexp_extract(name, "([0-9]+)[^0-9]*$", 1))


def standard_barcode(kit: str, name: str) -> Column:
    return F.concat(F.col(kit), F.lit("_"), barcode_name(name))


def template_timing(ns: str, ts: str, du: str, start: str, stride: str) -> Column:
    """struct of sample_rate, template_start, template_duration, num_events."""
    rate = f"try_divide({ns}, {du})"
    return F.expr(f"named_struct('sample_rate', {rate}, 'template_start', {start} + try_divide({ts}, {rate}), 'template_duration', try_divide({ns} - {ts}, {rate}), 'num_events', ({ns} - {ts}) div nullif({stride}, 0))")


def read_group_attributes(ds: str) -> Column:
    """k=v tokens separated by spaces, as a map."""
    return F.expr(f"str_to_map({ds}, ' ', '=')")


RG_ID = r"^([0-9a-f-]+)_(.*@v\d+\.\d+\.\d+)(.*)$"


def read_group_id(rg: str) -> Column:
    """struct run_id, model, rest of a read group id; empty strings if it isn't one."""
    return F.struct(*[F.regexp_extract(rg, RG_ID, i + 1).alias(n) for i, n in enumerate(("run_id", "model", "rest"))])


def passes_recorded_qscore(qs: str, command: str) -> Column:
    """qs against the --min-qscore of a recorded command line (0 if it has none)."""
    least = F.regexp_extract(command, r'--min-qscore"?[ =]"?([0-9]+)', 1)
    return F.col(qs) >= F.coalesce(F.when(least != "", least.cast("int")), F.lit(0))


def relative_start_ms(start: str, acquired: str) -> Column:
    """Milliseconds between two ISO times; null if either can't be parsed."""
    return F.expr(f"unix_millis(try_to_timestamp({start})) - unix_millis(try_to_timestamp({acquired}))")


def derived_uuid(parent: str, index: str) -> Column:
    """A name-based id of a part: the same parent and index give the same id."""
    h = f"sha2(concat({parent}, '-', {index}), 256)"
    return F.expr(f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), concat('5', substr({h}, 14, 3)), concat('8', substr({h}, 18, 3)), substr({h}, 21, 12))")


def homopolymer_fractions(scale: str, shape: str, n: int) -> Column:
    """Weibull share of each run length 1..n, times 10000, truncated; zeros if a parameter is missing."""
    a, b = f"pow((x - 1) / {scale}, {shape})", f"pow(x / {scale}, {shape})"
    return F.expr(f"transform(sequence(1, {n}), x -> coalesce(cast(10000 * greatest(0D, -exp(-({a})) * expm1({a} - {b})) AS int), 0))")


def phred(error: Column, cap: float = 70.0) -> Column:
    """-10 log10(error) at most cap, to 3 places; error 0 gives the cap."""
    return F.round(F.when(error <= 0, F.lit(cap)).otherwise(F.least(F.lit(cap), -10 * F.log10(error))), 3)


def trimmed_interval_ok(start: str, end: str, size: str) -> Column:
    return F.expr(f"{start} >= 0 AND {start} <= {end} AND {end} <= {size}")
