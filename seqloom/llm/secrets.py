"""Secret scan: candidate strings judged by a random forest, all on the JVM.

Candidates are runs of at least 16 token characters, and shorter ones of any
kind that are assigned to a credential word. A forest over their length,
character transitions, dictionary coverage, path and neighbouring words removes
false positives. It learns from labelled findings: given ones, or seeded ones,
which are lines made from known secrets and known harmless strings, so that a
label says what was put there and isn't derived from the features.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import drop, table

WORD = r"(?:api[_-]?key|access[_-]?key|private[_-]?key|token|secret|password|passwd|passphrase|pass|pwd|credential|auth|bearer|passwort|kennwort|contraseña|clave|motdepasse|mot de passe)"
#: Credential words are bounded by anything but letters, so by _ too.
CREDENTIAL = rf"(?i)(?<![a-z]){WORD}(?![a-z])"
RUN = r"[A-Za-z0-9_+/-]{16,}+={0,2}"
#: After a credential word and a sign: any 6 characters or more that are not space, quote or bracket.
GIVEN = rf"""(?<=(?i:{WORD})["'`]?\s{{0,2}}[=:]\s{{0,2}}["'`]?)[^\s"'`<>=:][^\s"'`<>]{{4,}}[^\s"'`<>.,;:)\]]"""
#: What stands between a user's name and the host in an address.
LOGIN = r"""(?<=[a-z]://[^\s:/@"'`]{1,40}:)[^\s:/@"'`]{4,}(?=@)"""
BOTH = f"{GIVEN}|{RUN}"
ASSIGNED = r"""[=:]\s*["'`]?$"""
TEST_PATH = r"(?i)\b(test|tests|example|examples|sample|mock|fixture|docs?)\b"
#: Bound of the labelled rows a forest is fitted on, those with the least hash.
SAMPLE = 20_000
#: Seeded lines.
SEEDED = 4_000
TREES, DEPTH, SEED = 20, 6, 42
#: Documents that must hold a word before it counts as one of the dictionary.
MIN_DOCS = 5
THRESHOLD = 0.5
MASK = "[SECRET]"
FEATURES = ("length", "digits", "uppers", "symbols", "transitions", "distinct", "hex", "coverage", "path", "test_path", "keyword", "assigned", "quoted", "word_before", "word_after")


def _may_log_in():
    """Whether a text can have a password in an address; a search of each place is spared where it can't."""
    return F.coalesce(F.col("text").contains("://") & F.col("text").contains("@"), F.lit(False))


def parts(docs: DataFrame) -> DataFrame:
    """docs with arrays _found, the candidates of text in order, and _between, what stands around them.

    Null and empty texts have no candidates.
    """
    # the wide patterns are tried where a login or a credential word is there at all
    named = F.coalesce(F.col("text").rlike(CREDENTIAL), F.lit(False))
    by = lambda f: F.when(_may_log_in(), f(f"{LOGIN}|{BOTH}")).when(named, f(BOTH)).otherwise(f(RUN))
    return docs.withColumns({"_found": by(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))), "_between": by(lambda p: F.split("text", p, -1))})


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, source, nth, start, candidate, before, after), one row per candidate.

    start counts code points from 0. before and after are up to 48 and 16
    characters of the text around it, a candidate just before included.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(_may_log_in() | F.col("text").rlike(f"{CREDENTIAL}|{RUN}")).select("doc_id", F.xxhash64("text").alias("text_hash"), source.alias("source"), "text")
    found = parts(rows).drop("text").where("size(_found) > 0").withColumn("_sizes", F.expr("transform(_found, (x, i) -> length(_between[i]) + length(x))"))
    # where each candidate's stretch begins: sums of blocks of 256, then within the blocks
    blocks = "sequence(0, (size(_sizes) - 1) div 256)"
    found = found.withColumn("_at", F.expr(f"aggregate({blocks}, array(0L), (a, b) -> array_append(a, element_at(a, -1) + aggregate(slice(_sizes, b * 256 + 1, 256), 0L, (t, x) -> t + x)))"))
    found = found.withColumn("_at", F.expr(f"flatten(transform({blocks}, b -> slice(aggregate(slice(_sizes, b * 256 + 1, 256), array(_at[b]), (a, x) -> array_append(a, element_at(a, -1) + x)), 1, 256)))"))
    one = "struct(i AS nth, _at[i] + length(_between[i]) AS start, x AS candidate, right(concat(if(i > 0, _found[i - 1], ''), _between[i]), 48) AS before, left(_between[i + 1], 16) AS after)"
    return found.select("doc_id", "text_hash", "source", F.explode(F.expr(f"transform(_found, (x, i) -> {one})")).alias("x")).select("doc_id", "text_hash", "source", "x.*")


def coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(candidate, coverage): share of its characters in dictionary words.

    The dictionary is every run of 3 to 12 letters that at least MIN_DOCS
    documents have as a word, counted over all documents.
    """
    runs = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,12}"), F.lit(0))).alias("word"))
    asked = runs.select("word").distinct()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9])[a-z]{3,12}(?![a-z0-9])"), F.lit(0)))).alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).join(asked, "word", "left_semi").select("word")
    hit = runs.join(known, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("chars"))
    return hit.select("candidate", (F.col("chars") / F.length("candidate")).alias("coverage"))


def featured(found: DataFrame, covered: DataFrame) -> DataFrame:
    """candidates() with the columns FEATURES, all double; covered: their coverage()."""
    c = F.col("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / F.length(c)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.join(covered.withColumnRenamed("candidate", "_candidate"), c == F.col("_candidate"), "left").drop("_candidate").withColumns({
        "length": F.length(c).cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "transitions": share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$") & c.rlike("[A-Fa-f]") & c.rlike("[0-9]")),
        "coverage": F.coalesce("coverage", F.lit(0.0)),
        "path": flag(c.contains("/") | F.col("before").rlike("[/.]$") | F.col("after").rlike("^[/.][A-Za-z]")),
        "test_path": flag(F.col("source").rlike(TEST_PATH)),
        "keyword": flag(F.col("before").rlike(CREDENTIAL) | F.col("before").rlike(r"://[^\s/@]{1,40}:$")),
        "assigned": flag(F.col("before").rlike(ASSIGNED)),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "word_before": flag(F.col("before").rlike(r"\p{L}{2,}[,.]?\s+$")),
        "word_after": flag(F.col("after").rlike(r"^[,.]?\s+\p{L}{2,}")),
    })


#: Names that secrets are given to, and those that harmless values have.
SECRET_NAMES = ("token", "api_key", "apiKey", "secret", "client_secret", "password", "db_password", "DB_PASS", "passwd", "passwort", "clave", "AWS_SECRET_ACCESS_KEY", "access_key", "auth_token", "GITHUB_TOKEN", "private_key")
OTHER_NAMES = ("commit", "sha256", "md5", "checksum", "digest", "etag", "build", "revision", "trace_id", "request", "order", "invoice", "card", "tel", "file", "path", "image", "name", "secretary", "author", "passage")
PLACEHOLDERS = ("your_token_here", "changeme-please", "xxxxxxxxxxxxxxxx", "<redacted>-value", "example-password", "${SECRET_TOKEN}", "os.environ.get", "process.env.TOKEN", "getpass.getpass", "insert-key-here", "None-required", "placeholder_value", "password", "required", "optional", "string", "undefined", "unchanged", "secretstore", "settings.auth")
PROSE = ("the", "and", "was", "seen", "here", "for", "with", "this", "from", "there", "und", "les", "para", "when")
PREFIXES = ("ghp_", "sk_live_", "xoxb-", "glpat-", "npm_", "hf_")
PEOPLE = ("Margaret", "Anton", "Lucia", "Pierre", "Hannah", "Miguel", "Thompson", "Schneider", "Fernandez", "Lefebvre", "Johnson", "Baumann")


def seeded(spark: SparkSession, rows: int = SEEDED) -> DataFrame:
    """(doc_id, source, text, value, label): lines with one known value each, half of them secrets.

    Every choice follows from a digest of the row's number. Secrets: hexadecimal
    and base-62 keys of several lengths, keys of known prefixes, passwords
    with symbols, after a credential word in several spellings, and passwords in addresses; keys with
    a prefix also without a word. Harmless: digests and ids under other names, card
    and telephone numbers, paths, addresses, people's names, long words, and placeholders and
    lookups under credential words.
    """
    of = lambda names, die: F.element_at(F.lit(list(names)), (die % len(names) + 1).cast("int"))
    # dice and digests are written first, so that what is made of them stays small as code
    dice = {f"d{i}": F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10**9)) for i in range(22)}
    sha = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    raw = {**dice, "hex_a": sha("s"), "hex_b": sha("n"), "wide": F.translate(F.base64(F.unhex(sha("w"))), "+/=", "xY7"), "digits": F.lpad(F.pmod(F.xxhash64("id", F.lit("d")), F.lit(10**16)).cast("string"), 16, "4")}
    made = table(spark.range(rows).withColumns(raw), "dice")
    d = lambda i: F.col(f"d{i}")
    word = F.concat(*[of(PROSE, d(i)) for i in range(6)])
    made = table(made.select("id", *[f"d{i}" for i in range(6, 22)], "hex_a", "hex_b", "wide", "digits", word.alias("word")), "words")
    kind, other_kind, prefix = d(6) % 8, d(7) % 8, d(8) % 7
    wide = lambda n: F.left("wide", F.lit(n))
    key = F.when(prefix == 6, F.concat(F.lit("AKIA"), F.upper(wide(16)))).otherwise(F.concat(of(PREFIXES, prefix), wide(36)))
    password = F.concat(wide(4), F.lit("!"), F.substring("wide", 9, 3), of(("#", "$", "%", "."), d(9)), F.left("hex_a", F.lit(3)))
    secret = F.when(kind == 0, F.left("hex_a", F.lit(32))).when(kind == 1, F.left("hex_a", F.lit(40))).when(kind == 2, wide(40)).when(kind == 3, wide(24)).when((kind == 4) | (kind == 5), key).otherwise(password)
    path = F.concat(F.lit("/usr/"), of(PROSE, d(10)), F.lit("/lib/"), of(PROSE, d(11)), F.lit("/"), F.col("word"))
    ident = F.concat_ws("-", F.left("hex_b", F.lit(8)), F.substring("hex_b", 9, 4), F.substring("hex_b", 13, 4), F.substring("hex_b", 17, 4), F.substring("hex_b", 21, 12))
    person = F.concat_ws("-", of(PEOPLE, d(10)), of(PEOPLE, d(11)))
    harmless = F.when(other_kind == 0, F.left("hex_b", F.lit(40))).when(other_kind == 1, F.col("hex_b")).when(other_kind == 2, F.col("digits")).when(other_kind == 3, path).when(other_kind == 4, ident).when(other_kind == 5, F.col("word")).when(other_kind == 6, of(PLACEHOLDERS, d(12))).otherwise(person)
    is_secret = F.col("id") % 2 == 0
    made = table(made.select("id", *[f"d{i}" for i in range(13, 22)], is_secret.alias("is_secret"), kind.alias("kind"), other_kind.alias("other_kind"), F.when(is_secret, secret).otherwise(harmless).alias("value")), "values")
    quote = of(("", '"', "'", '"'), d(13))
    named = F.concat(of(SECRET_NAMES, d(14)), of((" = ", "=", ": ", " : "), d(15)), quote)
    other = F.concat(of(OTHER_NAMES, d(14)), of((" = ", "=", ": ", " ", " "), d(16)), quote)
    login = F.concat(of(("https://", "postgres://", "ftp://"), d(14)), of(PROSE, d(15)), F.lit(":"))
    bare = d(17) % 2 == 0
    lead = F.when(F.col("is_secret") & (F.col("kind") == 7), login).when(F.col("is_secret") & F.col("kind").isin(4, 5) & bare, F.lit("")).when(F.col("is_secret") | (F.col("other_kind") == 6), named).when(bare, F.lit("")).otherwise(other)
    tail = F.when(F.col("is_secret") & (F.col("kind") == 7), F.lit("@db.example.org/main")).when(lead == "", F.lit("")).otherwise(quote)
    line = F.concat_ws(" ", of(PROSE, d(18)), of(PROSE, d(19)), F.concat(lead, "value", tail), of(PROSE, d(20)), of(PROSE, d(21)))
    return made.select(F.col("id").alias("doc_id"), F.lit("seeded").alias("source"), line.alias("text"), "value", F.col("is_secret").cast("double").alias("label"))


def seeded_candidates(spark: SparkSession, rows: int = SEEDED) -> DataFrame:
    """candidates() of seeded lines with their label, doc_id being the line's number.

    A candidate that is not the value put there, or a part of it, is harmless.
    """
    lines = table(seeded(spark, rows), "lines")
    held = candidates(lines).join(lines.select("doc_id", "value", F.col("label").alias("_label")), "doc_id")
    return table(held.withColumn("label", F.when(F.col("value").contains(F.col("candidate")), F.col("_label")).otherwise(0.0)).drop("value", "_label"), "seeded")


def seeded_findings(docs: DataFrame, rows: int = SEEDED) -> DataFrame:
    """FEATURES and label of seeded_candidates(), with docs' dictionary."""
    found = seeded_candidates(docs.sparkSession, rows)
    return featured(found, coverage(found, docs)).select("doc_id", "candidate", *FEATURES, "label")


def fit(labelled: DataFrame):
    """A forest from FEATURES and label (0 or 1), or None if a class is missing.

    At most SAMPLE rows of each class are used, those with the least hash.
    """
    drawn = None
    for kind in (0.0, 1.0):
        rows = labelled.where(F.col("label") == kind).select(*FEATURES, "label").orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(SAMPLE)
        drawn = rows if drawn is None else drawn.unionByName(rows)
    drawn = table(drawn, "labelled").persist()
    try:
        if drawn.select("label").distinct().count() < 2:
            return None
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(drawn))
    finally:
        drawn.unpersist()


def judged(found: DataFrame, model) -> DataFrame:
    """found(FEATURES) with probability; without a model it is 0."""
    if model is None:
        return found.withColumn("probability", F.lit(0.0))
    return model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)).withColumn("probability", F.round(vector_to_array("probability")[1], 6))


def _scan(docs: DataFrame, labelled: DataFrame | None, threshold: float) -> DataFrame:
    found = table(candidates(docs), "found")
    seeds = seeded_candidates(docs.sparkSession) if labelled is None else None
    # the words of all documents are counted once, for both kinds of candidate
    asked = found.select("candidate") if seeds is None else found.select("candidate").unionByName(seeds.select("candidate"))
    covered = table(coverage(asked, docs), "covered")
    model = fit(labelled if seeds is None else featured(seeds, covered))
    rows = table(featured(found, covered), "candidates")
    drop(found)
    return judged(rows, model).withColumn("is_secret", F.col("probability") >= threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, candidate, probability, is_secret) for every candidate.

    `labelled`: findings with FEATURES and label (0 or 1); by default seeded
    ones. Labels of one class only fit nothing, and no candidate is a secret.
    """
    return _scan(docs, labelled, threshold).select("doc_id", "start", "candidate", "probability", "is_secret")


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret in text masked where it stands; no row goes, n_chars follows the text.

    A row is known by doc_id and text, so rows of one id don't share findings.
    Other columns keep their values whatever their names; equal rows are
    masked alike and all stay; null and empty texts, and an empty table, are
    given back as they are.
    """
    # other columns go by names that no inner one has
    other = {c: f"_kept{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    columns = [F.col(other.get(c, c)).alias(c) for c in docs.columns]
    flags = _scan(docs, labelled, threshold).groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).agg(F.array_sort(F.collect_set(F.struct("nth", "is_secret"))).alias("_flags"), F.bool_or("is_secret").alias("_any")).where("_any").drop("_any")
    named = docs.select(*[F.col(f"`{c}`").alias(other.get(c, c)) for c in docs.columns])
    out = named.join(flags, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_hash")), "left")
    clean = out.where("_flags IS NULL").select(*columns)
    masked = parts(out.where("_flags IS NOT NULL")).withColumn("text", F.expr(f"concat(array_join(transform(_found, (x, i) -> concat(_between[i], if(_flags[i].is_secret, '{MASK}', x))), ''), element_at(_between, -1))"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(masked.select(*columns))


def op2_secret_scan(spark, sf_dir) -> DataFrame:
    """Every candidate of every document; the string itself only as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return scan(docs).select("doc_id", "start", F.length("candidate").cast("bigint").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")
