"""Small hand-made tables and invariants."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalars as S
from seqloom.functions.placement import place
from seqloom.operators import consensus, fuzzy, intervals, joins, pairing, pileup, quality, reads, series
from seqloom.session import ship
from seqloom.sources import sinks, text
from seqloom.streaming import stateful


def one(spark, sql, expr):
    return spark.sql(f"SELECT {sql}").select(expr.alias("x")).first()["x"]


def test_mean_qscore(spark):
    assert one(spark, "'' AS q", S.mean_qscore("q")) == 0
    assert one(spark, "'++++' AS q", S.mean_qscore("q")) == pytest.approx(10)
    assert one(spark, "'+5' AS q", S.mean_qscore("q")) == pytest.approx(12.596, abs=1e-3)
    assert one(spark, "'~~' AS q", S.mean_qscore("q")) == 50
    assert one(spark, "'!!++' AS q", S.mean_qscore_from("q", 2)) == pytest.approx(10)
    assert one(spark, "'++' AS q", S.mean_qscore_from("q", 2)) == pytest.approx(10)
    assert one(spark, "cast(null AS string) AS q", S.mean_qscore("q")) is None


def test_sequences(spark):
    assert one(spark, "'AACGTt' AS s", S.reverse_complement("s")) == "aACGTT"
    rng = random.Random(1)
    seqs = [("".join(rng.choices("ACGT", k=rng.randint(0, 50))),) for _ in range(30)]
    df = spark.createDataFrame(seqs, "s string").withColumn("r", S.reverse_complement("s"))
    assert df.select(S.reverse_complement("r").alias("b"), "s").where("b <> s").count() == 0
    assert one(spark, "'CCAAAAAAGG' AS s", S.rna_poly_a_start("s")) == 2
    assert one(spark, "'CCAAAAGG' AS s", S.rna_poly_a_start("s")) == 8
    assert one(spark, "concat('AAAAAAA', repeat('C', 197), 'AAA') AS s", S.rna_poly_a_start("s")) == 207
    assert one(spark, "'TTTACTT' AS s", S.trailing_count("s", "T")) == 2 and one(spark, "'TTTACTT' AS s", S.leading_count("s", "T")) == 3


def test_moves(spark):
    m = "array(1, 0, 1, 1, 0) AS m, 5 AS stride, 2 AS b"
    assert one(spark, m, S.moves_to_samples("m", "stride")) == [0, 10, 15, 25]
    assert one(spark, m, S.move_sums("m")) == [1, 1, 2, 3, 3]
    assert one(spark, m, S.base_to_move("m", "b")) == 3
    assert one(spark, m, pileup.dwells("m")) == [2, 1, 2]


def test_motifs_and_contexts(spark):
    assert one(spark, "'ACACACA' AS s", S.motif_hits("s", "ACA")) == [0, 2, 4]
    assert one(spark, "'AGATCG' AS s", S.motif_hits("s", "RN", 1)) == [1, 2, 3]
    assert one(spark, "'AC' AS s", S.motif_hits("s", "ACG")) == []
    df = spark.sql("SELECT '_:XG:_:_' AS t").withColumn("c", S.decode_contexts("t"))
    assert [tuple(x) for x in df.first().c] == [("C", "CG", 0)]
    assert df.select(S.encode_contexts("c").alias("x")).first().x == "_:XG:_:_"


def test_cigar(spark):
    df = spark.sql("SELECT '3S10M2I5=1X4D2S' AS c, 9 AS nm").withColumn("o", S.cigar_ops("c"))
    assert df.select(S.format_cigar("o").alias("x")).first().x == "3S10M2I5=1X4D2S"
    assert tuple(df.select(S.alignment_counts("o", "nm").alias("x")).first().x) == (16, 2, 4, 3, 2, 3)
    acc = df.select(S.accuracies("o", "nm").alias("x")).first().x
    assert acc.snp == pytest.approx(1 - 3 / 16) and acc.total == pytest.approx(1 - 9 / 22)
    none = spark.sql("SELECT '*' AS c, 0 AS nm").withColumn("o", S.cigar_ops("c"))
    assert tuple(none.select(S.accuracies("o", "nm").alias("x")).first().x) == (0.0, 0.0)
    a = spark.createDataFrame([(1, 100, "3S10M2I5M4D6M")], "id int, pos int, cigar string").withColumns({"s": F.lit(5), "e": F.lit(17)})
    r = pileup.cut_to_query(a, "id", "s", "e").first()
    assert (r.cigar, r.pos) == ("8M2I2M", 102)


def test_tags_and_ids(spark):
    assert tuple(one(spark, "'0a1b_dna@v4.3.0_x' AS r", S.read_group_id("r"))) == ("0a1b", "dna@v4.3.0", "_x")
    assert one(spark, "10.5 AS q, 'run --min-qscore 11 x' AS c", S.passes_recorded_qscore("q", "c")) is False
    assert one(spark, "10.5 AS q, 'run x' AS c", S.passes_recorded_qscore("q", "c")) is True
    assert one(spark, "'2024-01-01T00:00:01.500Z' AS a, '2024-01-01T00:00:00Z' AS b", S.relative_start_ms("a", "b")) == 1500
    assert one(spark, "'unknown' AS a, '2024-01-01T00:00:00Z' AS b", S.relative_start_ms("a", "b")) is None
    assert one(spark, "'NB07' AS n, 'KIT' AS k", S.standard_barcode("k", "n")) == "KIT_barcode07"


def test_mux_trim(spark):
    assert one(spark, "repeat('#', 50) AS q", reads.mux_trim_end("q")) == 50
    assert one(spark, "concat(repeat('I', 100), repeat('#', 20)) AS q", reads.mux_trim_end("q")) == 99 + 0
    assert one(spark, "concat(repeat('I', 100), repeat('#', 3)) AS q", reads.mux_trim_end("q")) == 103
    assert one(spark, "concat(repeat('I', 30), repeat('#', 100)) AS q", reads.mux_trim_end("q")) == 130


def test_mux_trim_counts_code_points(spark):
    """A letter outside the basic plane is one base."""
    assert one(spark, "concat(repeat('\U0001F600', 100), repeat('#', 20)) AS q", reads.mux_trim_end("q")) == 99
    assert one(spark, "cast(null AS string) AS q", reads.mux_trim_end("q")) is None


def test_modified_bases(spark):
    r = spark.createDataFrame([(1, "AATCGGAC", "A+a?,1,0;C+m.,0;", [10, 20, 30], 1, 6)], "id int, seq string, mm string, ml array<int>, s int, e int")
    got = {(x.position, x.code, x.prob) for x in reads.decode_modbases(r, "id").collect()}
    assert got == {(1, "a", 10), (6, "a", 20), (3, "m", 30)}
    x = reads.encode_modbases(reads.decode_modbases(r, "id"), r, "id").first()
    assert (x.mm, x.ml) == ("A+a?,1,0;C+m.,0;", [10, 20, 30])
    x = reads.trim_modbases(r, "id", "s", "e").first()
    assert (x.mm, x.ml) == ("A+a?,0;C+m.,0;", [10, 30])
    mask = reads.modbase_mask(reads.decode_modbases(r, "id"), ["id", "position"], 15)
    assert {(x.position, x.keep) for x in mask.collect()} == {(1, False), (6, True), (3, True)}


def test_trim(spark):
    r = spark.createDataFrame([(1, "ACGT", "!!!!", [1, 0, 1, 1, 0, 1], 7, 60, 5, 1, 3), (2, "AC", "!!", [1, 1], 0, 10, 5, 1, 9)], "id int, seq string, qual string, moves array<int>, ts int, ns int, stride int, s int, e int")
    got = {x.id: x for x in reads.trim(r, "s", "e").collect()}
    assert (got[1].seq, got[1].moves, got[1].ts, got[1].ns, got[1].valid) == ("CG", [1, 1, 0], 17, 32, True)
    assert (got[2].seq, got[2].valid) == ("AC", False)


def test_overlaps_against_nested_loops(spark):
    rng = random.Random(3)
    a = [(i, rng.choice("xy"), s, s + rng.randint(0, 40)) for i in range(120) for s in [rng.randint(0, 900)]]
    b = [(i, rng.choice("xyz"), s, s + rng.choice([0, 5, 60, 900])) for i in range(80) for s in [rng.randint(0, 900)]]
    fa = spark.createDataFrame(a, "id int, k string, start int, end int")
    fb = spark.createDataFrame(b, "bid int, k string, b_start int, b_end int")
    for inclusive in (False, True):
        want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and (x[2] <= y[3] and y[2] <= x[3] if inclusive else max(x[2], y[2]) < min(x[3], y[3]))}
        got = [(r.id, r.bid) for r in intervals.overlap_pairs(fa, fb, ["k"], 4, inclusive).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    counts = intervals.overlap_counts(fa, fb, ["k"], "id", 16).collect()
    assert len(counts) == len(a)


def test_merged_ranges_are_disjoint(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("ab"), s, s + rng.randint(1, 9)) for s in rng.choices(range(200), k=60)], "k string, start int, end int")
    got = sorted((r.k, r.start, r.end) for r in intervals.merge_ranges(df, ["k"], 2).collect())
    assert all(x[0] != y[0] or y[1] > x[2] + 2 for x, y in zip(got, got[1:], strict=False))
    assert intervals.merge_ranges(df.where("false"), ["k"]).count() == 0


def test_runs_expand_back(spark):
    values = [None, None, 1, 1, 2, None, 2]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v int")
    got = intervals.runs(df, ["k"], ["i"], "v").orderBy("run").collect()
    assert [v for r in got for v in [r.v] * r.n] == values and got[0].first == 0 and got[-1].last == 6


def test_tiles_cover_without_overlap(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 99, 100, 101, 190, 191, 1000])], "id int, n int")
    for i, n in enumerate([1, 99, 100, 101, 190, 191, 1000]):
        got = intervals.tiles(df.where(F.col("id") == i), "n", 100, 10).orderBy("tile_start").collect()
        assert got[0].start_no_overlap == 0 and got[-1].end_no_overlap == n
        assert all(x.end_no_overlap == y.start_no_overlap for x, y in zip(got, got[1:], strict=False))
    with pytest.raises(ValueError):
        intervals.tiles(df, "n", 10, 5)


def test_chunks_stitch_back(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate([1, 9, 10, 11, 57, 200])], "id int, t string").withColumn("n", F.length("t"))
    c = series.chunk_offsets(df, "n", 10, 4).withColumn("p", F.expr("substr(t, cast(chunk_start AS int) + 1, cast(chunk_end - chunk_start AS int))"))
    back = series.stitch_chunks(c.drop("t").withColumnRenamed("p", "t"), "id", "chunk_start", "chunk_end", "t")
    assert back.join(df.withColumnRenamed("t", "u"), "id").where("t <> u").count() == 0 and back.count() == 6


def test_pairing(spark):
    df = spark.createDataFrame([("a", 1, 0, 100, 6000), ("a", 2, 150, 300, 6000), ("a", 3, 5000, 5100, 700), ("a", 4, 30000, 30100, 9000), ("b", 5, 0, 50, 100), ("b", 6, 60, 90, 100)], "k string, id int, s int, e int, n int")
    got = [(r.template, r.complement, r.early) for r in pairing.adjacent_pairs(df, ["k"], "s", "e", "id", "n").orderBy("template").collect()]
    assert got == [(1, 2, True), (2, 3, False)]
    links = "struct('t' AS id, 'pt' AS parent, '' AS prev_read, {} AS next_read) AS template, struct('c' AS id, 'pc' AS parent, {} AS prev_read, '' AS next_read) AS complement"
    for n, p, ok in (("'c'", "'x'", True), ("'x'", "'t'", True), ("'pc'", "'pt'", True), ("'pc'", "'x'", False), ("null", "null", False)):
        assert one(spark, links.format(n, p), pairing.adjacency_holds()) is ok


def test_joins(spark):
    r = spark.createDataFrame([("a",), ("b",), ("a;b",), ("c:0 x",)], "id string")
    assert {x.id for x in joins.tag_parents(r, "id").where("is_parent").collect()} == {"a", "b"}
    done = spark.createDataFrame([("a:0",), ("c 1",)], "id string")
    assert {x.id for x in joins.not_done(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), done, "id").collect()} == {"b"}
    c = joins.alignment_counts(spark.createDataFrame([("r", 0), ("r", 256), ("r", 2048), ("q", 4)], "n string, f int"), "n", "f").orderBy("n").collect()
    assert [tuple(x) for x in c] == [("q", 0, 0, 0), ("r", 3, 1, 1)]
    lines = spark.createDataFrame([("x", "SQ", "b", "1", 0), ("x", "SQ", "c", "1", 1), ("y", "SQ", "a", "1", 0), ("y", "SQ", "b", "1", 1)], "file string, kind string, key string, line string, o int")
    merged, bad = joins.merge_headers(lines)
    assert bad.count() == 0
    assert sorted((m.file, m.old, m.new) for m in joins.header_index_map(lines, merged, "o").collect()) == [("x", 0, 1), ("x", 1, 2), ("y", 0, 0), ("y", 1, 1)]


def test_pileup(spark):
    a = spark.createDataFrame([("r1", "c", 0, 10, 0, 60, "3M1I2M", "ACGTAC", {}), ("r2", "c", 16, 11, 0, 60, "2M2D1M", "CGN", {}), ("r3", "c", 4, 0, 0, 60, "*", "*", {})], "id string, rname string, flag int, pos int, x int, mapq int, cigar string, seq string, tags map<string,string>")
    got = {(r.major, r.minor, r.symbol): r.n for r in pileup.pileup(a.where(pileup.passes()), "id").collect()}
    assert got == {(10, 0, "A"): 1, (11, 0, "C"): 1, (12, 0, "G"): 1, (12, 1, "T"): 1, (13, 0, "A"): 1, (14, 0, "C"): 1, (11, 0, "c"): 1, (12, 0, "g"): 1, (13, 0, "d"): 1, (14, 0, "d"): 1}
    counts = pileup.pileup(a, "id")
    d = {(r.major, r.minor): r.depth for r in pileup.depth_features(counts).collect()}
    assert d[12, 1] == 2
    filled = {(r.major, r.minor, r.symbol): r.n for r in pileup.fill_symmetric_indels(counts).collect()}
    assert filled[12, 1, "d"] == 1 and (12, 1, "D") not in filled
    keep = pileup.passes(tag="DT", value="x", keep_missing=True, read_group="g")
    assert a.where(keep).count() == 2 and a.where(pileup.passes(tag="DT", value="x", keep_missing=True, read_group="g", missing_skips_group=False)).count() == 0


def test_consensus(spark):
    v = spark.createDataFrame([(1, "A", 2, "C"), (1, "C", 2, "C"), (2, "A", 1, "G"), (3, "T", 3, "A"), (3, "A", 1, "A")], "c int, s string, n int, t string")
    assert {r.c: r.consensus for r in pileup.vote(v, ["c"], "s", "n", "t").collect()} == {1: "C", 2: "G", 3: "T"}
    p = spark.createDataFrame([(1, "A", 0.5, 1), (1, "*", 0.5, 0), (2, "C", 1.0, 2)], "k int, symbol string, prob double, index int")
    got = {r.k: (r.symbol, r.quality) for r in consensus.decode(p, ["k"]).collect()}
    assert got[1] == ("*", pytest.approx(3.01)) and got[2] == ("C", 70.0)
    w = spark.createDataFrame([("a", 0, "AC"), ("a", 1, ""), ("a", 2, "GT"), ("a", 3, "T"), ("b", 0, "A"), ("c", 0, None)], "n string, w int, s string")
    assert sorted((r.record, r.seq) for r in consensus.concat_windows(w, "n", "w", "s").collect()) == [("a:0", "AC"), ("a:1", "GTT"), ("b", "A")]
    d = spark.createDataFrame([("x", "AACCGGTTAA")], "name string, draft string")
    s = spark.createDataFrame([("x", 2, 4, "TT"), ("x", 6, 8, "CC")], "name string, start int, end int, seq string")
    assert consensus.stitch(s, d).first().seq == "AATTGGCCAA" and consensus.stitch(s, d, fill="N").first().seq == "NNTTNNCCNN"
    assert sorted(r.seq for r in consensus.stitch(s, d, fill="split").collect()) == ["CC", "TT"]
    o = spark.createDataFrame([("x", 0, 10), ("x", 6, 20), ("x", 8, 12), ("x", 20, 25), ("x", 30, 31)], "k string, start int, end int")
    assert [(r.start, r.relation, r.keep_start, r.keep_end) for r in consensus.trim_overlaps(o, ["k"]).orderBy("start").collect()] == [(0, "first", 0, 8), (6, "overlap", 8, 20), (8, "within", 8, 8), (20, "abut", 20, 25), (30, "gap", 30, 31)]


def test_variants(spark):
    cols = spark.createDataFrame([("k", 1, 0, "A", "A"), ("k", 1, 1, "*", "G"), ("k", 2, 0, "C", "T"), ("k", 3, 0, "C", "C")], "k string, major int, minor int, ref string, c string")
    got = {(r.major, r.minor): r.is_variant for r in consensus.variant_columns(cols, ["k"], "ref", ["c"]).collect()}
    assert got == {(1, 0): False, (1, 1): True, (2, 0): True, (3, 0): False}
    r = consensus.variant_islands(cols, ["k"], "ref", ["c"]).first()
    assert (r.pos, r.ref, r.alts) == (1, "C", ["GT"])
    drafts = spark.createDataFrame([("x", "GCAAAAT")], "name string, draft string")
    v = spark.createDataFrame([("x", 5, "A", [""]), ("x", 2, "AA", ["CA"]), ("x", 1, "C", ["T"])], "name string, pos int, ref string, alts array<string>")
    assert sorted((r.pos, r.ref, r.alts[0]) for r in consensus.normalise(v, drafts).collect()) == [(1, "C", "T"), (1, "CA", "C"), (2, "A", "C")]
    g = spark.createDataFrame([("A", ["A", "T"], 20.4), ("A", ["A", "A"], 9.0), ("A", ["T", "C"], 1.0)], "ref string, calls array<string>, q double")
    assert [(r.alts, r.gt, r.gq, r.filter) for r in consensus.genotype(g, "ref", "calls", "q").collect()] == [(["T"], "0/1", 20, "PASS"), ([], "0/0", 9, "."), (["C", "T"], "1/2", 1, "LowQual")]


def test_series(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 9, 9, 0, 0, 8, 0, 0, 0, 9])], "k string, i int, v int")
    assert sorted((r.start, r.end, r.peak) for r in series.threshold_clusters(df, ["k"], "i", "v", 5, 3).collect()) == [(1, 6, 2), (9, 10, 9)]
    q = series.lower_quantiles(spark.createDataFrame([("a", float(x)) for x in [4, 1, 3, 2]], "k string, v double"), ["k"], "v", {"m": 0.5}).first()
    assert q.m == 2.0
    flat = [(1, i, v) for i, v in enumerate([50.0, -40.0] * 20 + [1.0] * 60 + [50.0, -40.0] * 20)]
    p = series.plateaus(spark.createDataFrame(flat, "k int, i int, v double"), "k", "i", "v", samples_per_base=6).first()
    assert (p.start, p.end, p.bases) == (40, 100, 10)
    s = series.split_at_spacers(spark.createDataFrame([("r", 100), ("q", 5)], "id string, n int"), spark.createDataFrame([("r", 0, 10), ("r", 50, 60)], "id string, s_start int, s_end int"), "id", "n")
    assert sorted((r.id, r.start, r.end) for r in s.collect()) == [("q", 0, 5), ("r", 10, 50), ("r", 60, 100)]


def test_placement(spark):
    ship(spark)

    def edits(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, x in enumerate(t):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x not in {"N": "ACGT"}.get(c, c))))
            row = new
        return min(row)

    rng = random.Random(6)
    rows = [("".join(rng.choices("ACGTN", k=rng.randint(1, 9))), "".join(rng.choices("ACGT", k=rng.randint(0, 20)))) for _ in range(60)] + [(None, "A")]
    got = spark.createDataFrame(rows, "p string, t string").withColumn("x", place(F.col("p"), F.col("t"))).collect()
    for r in got:
        if r.p is None:
            assert r.x.dist is None
        else:
            assert r.x.dist == edits(r.p, r.t) and 0 <= r.x.start <= r.x.end <= len(r.t)


def test_barcodes(spark):
    rng = random.Random(8)
    codes = {f"BC0{i}": "".join(rng.choices("ACGT", k=24)) for i in range(1, 5)}
    kit = spark.createDataFrame([(n, "GGTGCTG", c, "TTAACCT") for n, c in codes.items()], "name string, front string, barcode string, rear string")
    body = "".join(rng.choices("ACGT", k=400))
    rows = [(n, "AC" + "GGTGCTG" + c + "TTAACCT" + body) for n, c in codes.items()] + [("none", body)]
    got = {r.id: r.name for r in fuzzy.classify_barcodes(spark.createDataFrame(rows, "id string, seq string"), kit, "id").collect()}
    assert got == {n: n for n in codes} | {"none": "unclassified"}
    u = spark.createDataFrame([("a", "CC" + "TTTACGATTCAGCTTGGCATTACAGTTT" + "ACGTACGTACGT", 6)], "id string, seq string, t int")
    assert fuzzy.umi(u, "id", "t").first().umi == "TTTACGATTCAGCTTGGCATTACAGTTT"
    q = spark.createDataFrame([("ad", "ACGTTGCAACGT")], "name string, seq string")
    found = fuzzy.adapters(spark.createDataFrame([("r", "TTACGTTGCAACGT" + "G" * 300)], "id string, seq string"), q, "id").collect()
    assert [(r.side, r.name, r.start, r.end) for r in found] == [("front", "ad", 2, 14)]

def test_fasta_header_with_an_angle(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a A>G change\nAC\nGT\n>b\n>c\r\nTT\r\n")
    want = {"a": "ACGT", "b": "", "c": "TT"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "1", "7"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = text.read_fasta(spark, str(tmp_path / "a.fa")).collect()
            assert len(rows) == 3 and {r.name: r.seq for r in rows} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_in_splits_and_compressed(spark, tmp_path):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGU", k=rng.randint(0, 90))) for _ in range(400)]
    # qualities begin with @ and +, which also begin headers and third lines
    body = "".join(f"@r{i} qs:f:{i}\n{s}\n+\n{('@' if i % 2 else '+') * len(s)}\n" for i, s in enumerate(seqs))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_text(body + "\n")
    with gzip.open(tmp_path / "in" / "b.fastq.gz", "wt") as f:
        f.write(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 10
        rows = text.read_fastq(spark, str(tmp_path / "in")).collect()
        assert text.read_fastq(spark, str(tmp_path / "in"), max_reads=7).count() == 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for end in ("a.fastq", "b.fastq.gz"):
        got = {r.read_id: (r.seq, len(r.qual), r.tags) for r in rows if r.file.endswith(end)}
        assert got == {f"r{i}": (s.replace("U", "T"), len(s), {"qs": str(i)}) for i, s in enumerate(seqs)}
    assert len(rows) == 800
    for bad in ("@r\nAC\n+\n", "r\nAC\n+\n!!\n", "@r\nAC\n+\n!\n"):
        (tmp_path / "bad.fastq").write_text(bad)
        with pytest.raises(Exception, match="does not begin a record"):
            text.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()



def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 RG:Z:g\tqs:f:9.5\nACGU\n+\n@!!+\n@r2\nAC\n+\n!!\n")
    got = {r.read_id: r for r in text.read_fastq(spark, str(tmp_path / "a.fastq")).collect()}
    assert got["r1"].seq == "ACGT" and got["r1"].tags == {"RG": "g", "qs": "9.5"} and got["r2"].tags == {}
    lines = sinks.fastq_lines(text.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("read_id")).collect()
    assert lines[1].value == "@r2\nAC\n+\n!!"
    (tmp_path / "a.fa").write_text(">c1 et:Z:x\nACG\nT\n>c2\nGG\n")
    fa = text.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r.name, r.length) for r in text.fasta_index(fa).collect()) == [("c1", 4), ("c2", 2)]
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:50\nr\t0\tc1\t3\t60\t4M1I2M\t*\t0\t0\tACGTACG\t!!!!!!!\tNM:i:2\nq\t4\t\t0\t0\t*\t*\t0\t0\tA\t!\ns\t0\tc1\t1\t9\t1M\t*\t0\t0\tA\t!\n")
    recs, refs = text.read_sam(spark, str(tmp_path / "a.sam"))
    assert recs.where("qname = 'q'").first().rname == "*" and refs.first().ln == 50
    m, bad = text.alignment_metrics(recs, refs)
    r = m.first()
    assert (r.matches, r.insertions, r.substitutions, r.genome_end) == (6, 1, 1, 8) and bad.first().qname == "s"
    assert sinks.sam_lines(recs, refs).first().value == "@SQ\tSN:c1\tLN:50"
    assert [x.value.split("\t")[0] for x in sinks.sam_lines(recs, refs).collect()] == ["@SQ", "s", "r", "q"]
    (tmp_path / "order.sam").write_text("@SQ\tSN:c2\tLN:50\n@SQ\tSN:c1\tLN:50\na\t0\tc1\t3\t60\t1M\t*\t0\t0\tA\t!\tNM:i:2\tqs:f:1.5\tRG:Z:g\tpa:B:i,1,2\nb\t0\tc2\t9\t60\t1M\t*\t0\t0\tA\t!\nc\t0\tc0\t1\t60\t1M\t*\t0\t0\tA\t!\n")
    lines = [x.value for x in sinks.sam_lines(*text.read_sam(spark, str(tmp_path / "order.sam"))).collect()]
    assert [x.split("\t")[0] for x in lines] == ["@SQ", "@SQ", "b", "a", "c"] and lines[0].startswith("@SQ\tSN:c2")
    assert lines[3].endswith("\tNM:i:2\tRG:Z:g\tpa:B:i,1,2\tqs:f:1.5")
    many = "\t".join(f"{a}{b}:i:{n}" for n, (a, b) in enumerate([(a, b) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" for b in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"]))
    (tmp_path / "tags.sam").write_text(f"@SQ\tSN:c1\tLN:50\nr\t0\tc1\t3\t60\t1M\t*\t0\t0\tA\t!\t{many}\n")
    assert len(text.read_sam(spark, str(tmp_path / "tags.sam"))[0].first().tags) == 1872
    (tmp_path / "a.paf").write_text("q\t10\t0\t5\t+\tt\t20\t1\t6\t5\t5\t60\tNM:i:0\tcg:Z:5M\n")
    paf = text.read_paf(spark, str(tmp_path / "a.paf"))
    assert paf.first().cigar == "5M" and sinks.paf_lines(paf).first().value.endswith("60\tcg:Z:5M")
    (tmp_path / "a.bed").write_text("track x\n# c\nc\t1\t5\tn\t0\t-\nc\t9\t5\tn\t0\t-\nc\t1\t2\nc\t1\t2\tn\t0\tx\n")
    rows, rejects = text.read_bed(spark, str(tmp_path / "a.bed"))
    assert rows.count() == 1 and sorted(r.reason for r in rejects.collect()) == ["bounds", "strand", "width differs"]
    reg = text.parse_regions(spark.createDataFrame([("a,b:,c:2-9,d:5-,e:-7",)], "t string"), "t").collect()
    assert [tuple(r) for r in reg] == [("a", None, None), ("b", None, None), ("c", 1, 9), ("d", 4, None), ("e", None, 7)]
    (tmp_path / "s.csv").write_text("experiment_id,kit,flow_cell_id,barcode,alias\r\ne,k,f,barcode01,a b\re,k,f,barcode01,barcode02\n")
    sheet = text.read_sheet(spark, str(tmp_path / "s.csv"))
    assert sorted(r.rule for r in text.sheet_violations(sheet).collect()) == ["alias has other characters or over 40", "alias is reserved", "barcode comes twice"]
    v = spark.createDataFrame([("c1", 4, "A", ["T"], 12.5, "PASS", "0/1", 12, 7)], "chrom string, pos int, ref string, alts array<string>, quality double, filter string, gt string, gq int, dp int")
    out = [r.value for r in sinks.vcf_lines(v, spark.createDataFrame([("c1", 50)], "name string, length int")).collect()]
    assert out[0] == "##fileformat=VCFv4.2" and out[1] == "##contig=<ID=c1,length=50>" and out[-1] == "c1\t5\t.\tA\tT\t12.500\tPASS\tDP=7\tGT:GQ\t0/1:12"
    sinks.write_partitioned(spark.range(10).withColumn("p", F.col("id") % 2), str(tmp_path / "out"), ["p"])
    assert spark.read.parquet(str(tmp_path / "out")).where("p = 1").count() == 5


def test_coordinate_order(spark):
    df = spark.createDataFrame([(1, 5), (-1, 0), (0, 9), (0, 2), (1, 1)], "tid int, pos int")
    assert [tuple(r) for r in sinks.coordinate_sorted(df, "tid", "pos", 3).collect()] == [(0, 2), (0, 9), (1, 1), (1, 5), (-1, 0)]


def test_comparison(spark):
    a = spark.createDataFrame([(1, 10.0, "x"), (2, 5.0, "y"), (3, 1.0, "z")], "k int, v double, t string")
    got = {r.column: r for r in quality.compare_frames(a, a.where("k < 3").withColumn("t", F.lit("x")), "k").collect()}
    assert (got["v"].only_a, got["v"].within, got["t"].differing, got["t"].within) == (1, True, 1, False)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(k, i, 1_000_000 + 1_000 * i + 7 * k) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, i bigint, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = stateful.run_to_table(stateful.stream_pairs(s, "k", "ts", "i", "i", 1500), "t").collect()
    assert sorted((r.k, r.template, r.complement, r.gap_ms) for r in got) == [(k, i, i + 1, 1000) for k in range(3) for i in range(19)]
    g = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("want", F.when(F.col("k") == 1, 20).otherwise(21))
    assert [(r.k, r.n) for r in stateful.run_to_table(stateful.stream_complete_groups(g, "k", "want", "ts"), "g").collect()] == [(1, 20)]
    assert stateful.remaining_seconds(10, 50, {"a": 100}, 2, True) == pytest.approx(30)


def test_modbases_are_read_without_a_shuffle_and_written_with_one(spark):
    rows = [("r1", "ACGTCCNA", "C+mh?,0,1;A+a.,1;N+7,2", [1, 2, 3, 4, 5, 6]), ("r2", "AAAA", "C+m,3;;", [9]), ("r3", None, "A+a,0", [7]), ("r4", "CCC", None, [1]), ("r5", "CC", "C+m,0,0", None)]
    r = spark.createDataFrame(rows, "id string, seq string, mm string, ml array<int>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    mods = reads.decode_modbases(r, "id")
    assert "Exchange" not in plan(mods) and "Window" not in plan(mods)
    got = sorted(((x.id, x.position, x.base, x.code, x.context, x.prob) for x in mods.collect()), key=str)
    want = [("r1", 1, "C", "m", "?", 1), ("r1", 1, "C", "h", "?", 2), ("r1", 5, "C", "m", "?", 3), ("r1", 5, "C", "h", "?", 4), ("r1", 7, "A", "a", ".", 5), ("r1", 2, "N", "7", ".", 6), ("r2", None, "C", "m", ".", 9), ("r3", None, "A", "a", ".", 7), ("r5", 0, "C", "m", ".", None), ("r5", 1, "C", "m", ".", None)]
    assert got == sorted(want, key=str)
    written = reads.encode_modbases(mods.where("position IS NOT NULL"), r, "id")
    assert "Join" not in plan(written)
    assert {x.id: (x.mm, x.ml) for x in written.collect()} == {"r1": ("A+a.,1;C+h?,0,1;C+m?,0,1;N+7.,2;", [5, 2, 4, 1, 3, 6]), "r5": ("C+m.,0,0;", [None, None])}
