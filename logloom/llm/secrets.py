"""Secret scan: candidate strings, judged by a random forest.

Only DataFrame functions are used.  A regular expression marks candidates:
values assigned to names such as token or password, private key blocks, tokens
of three parts with dots, and runs of 16 or more key characters with a digit.  Length, character transitions, dictionary
coverage, path signs and the neighbouring words of a candidate go to a random
forest trained on labelled findings, which tells secrets from checksums,
identifiers, numbers and paths.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import BROADCAST_ROWS, write_shared

#: Names whose assigned values are candidates, and words that speak for or against a secret (fixed values).
SECRET_NAMES = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth"]
BENIGN_NAMES = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "revision", "version", "hash", "etag", "session", "phone", "call", "card", "isbn", "order", "ticket", "build"]
DICTIONARY = ["test", "example", "sample", "user", "name", "file", "path", "index", "value", "data", "your", "here", "key", "token", "password", "change", "config", "python", "packages", "release", "notes", "version", "public", "default", "placeholder", "dummy", "http", "html", "image", "page", "the", "and", "for", "with", "tion", "ing"]
KNOWN_PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ", "-----BEGIN"]

_NAMES = "|".join(SECRET_NAMES)
_RUN = r"[A-Za-z0-9_+/=\-]"
_NAMED = rf"(?i:{_NAMES})[\"']?[ \t]{{0,2}}[:=][ \t]{{0,2}}[\"']?"
_VALUE = r"[^\s\"'\x01\x02]"
#: A private key with its header and footer, and a token of three parts with dots.
_KEY_BLOCK = r"-----BEGIN[A-Z ]{0,20} PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,40}+-----END[A-Z ]{0,20} PRIVATE KEY-----"
_DOTTED = rf"(?<!{_RUN})eyJ[A-Za-z0-9_\-]{{8,}}+\.[A-Za-z0-9_\-]{{8,}}+\.[A-Za-z0-9_\-]{{8,}}+"
#: A listed name may end a longer one (DB_PASSWORD, client_secret). A run doesn't begin before such a name, and leaves out "NAME=" before a value.
CANDIDATE = (
    rf"({_NAMED})(?!-----BEGIN)({_VALUE}{{8,}}+)"
    rf"|({_KEY_BLOCK}|{_DOTTED})"
    rf"|(?<!{_RUN})(?=[A-Za-z_+/=\-]*+[0-9])(?={_RUN}{{16}})(?![A-Za-z0-9_+/\-]*{_NAMED}{_VALUE}{{8}})([A-Za-z0-9_\-]++=(?={_RUN}{{8}}))?({_RUN}++)"
)

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_distinct", "f_turns", "f_case_turns", "f_words", "f_hex", "f_number", "f_uuid", "f_path", "f_known", "f_named", "f_benign", "f_quoted", "f_link"]
TREES, DEPTH, SEED = 24, 7, 11


def candidates(documents: DataFrame, *keys: str) -> DataFrame:
    """One row for each candidate: doc_id, row, start (from 0, in characters), candidate, before, after.

    Bulk text is dropped inside the row; only candidates with 60 characters of
    context are dealt out to number their starts.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    marked = F.regexp_replace(F.translate("text", "\x01\x02", "  "), CANDIDATE, "$1$4\x01$2$3$5\x02")
    parts = docs.select("doc_id", *keys, "row", F.split(marked, "\x01").alias("parts")).filter(F.size("parts") > 1)

    def brief(p: Column) -> Column:
        return F.struct(
            F.substring_index(p, "\x02", 1).alias("head"),
            F.length(F.replace(p, F.lit("\x02"), F.lit(""))).alias("width"),
            F.right(p, F.lit(60)).alias("tail"),
            F.substring(F.element_at(F.split(p, "\x02", 2), -1), 1, 40).alias("after"),
        )

    short = parts.select("doc_id", *keys, "row", F.posexplode(F.transform("parts", brief)).alias("nth", "part"))
    by_row = Window.partitionBy("row").orderBy("nth")
    placed = short.select(
        "doc_id",
        *keys,
        "row",
        "nth",
        F.coalesce(F.sum("part.width").over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.col("part.head").alias("candidate"),
        F.element_at(F.split(F.lag("part.tail").over(by_row), "\x02"), -1).alias("before"),
        F.col("part.after").alias("after"),
    )
    return placed.filter("nth > 0").drop("nth")


def with_features(found: DataFrame) -> DataFrame:
    """Adds the forest's inputs; a null context counts as empty."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    def yes(x: Column) -> Column:
        return x.cast("double")

    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    return found.withColumns(
        {
            "f_length": F.least(n, F.lit(200.0)),
            "f_digits": share("[0-9]"),
            "f_upper": share("[A-Z]"),
            "f_lower": share("[a-z]"),
            "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "f_turns": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
            "f_case_turns": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
            "f_words": 1 - F.length(F.regexp_replace(F.lower(c), words, "")) / n,
            "f_hex": yes(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
            "f_number": yes(c.rlike(r"^[0-9\-]+$")),
            "f_uuid": yes(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
            "f_path": share("/"),
            "f_known": yes(c.rlike("^(" + "|".join(KNOWN_PREFIXES) + ")")),
            "f_named": yes(before.rlike(rf"(?i)({_NAMES})\W{{0,6}}$")),
            "f_benign": yes(before.rlike(rf"(?i)\b({'|'.join(BENIGN_NAMES)})\W{{0,4}}(?:\w{{0,12}}\W{{1,3}})?$")),
            "f_quoted": yes(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            "f_link": yes(before.rlike(r"(://\S*|[/.@\\])$") | after.rlike(r"^[@\\/]")),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Findings with a label (1: a secret), invented from templates: candidate, before, after, label.

    Stands in for findings that reviewers labelled; any table of this shape does.
    """
    i = F.col("id")

    def rand(k: int) -> Column:
        return F.sha2(F.concat(F.lit(f"{k}/"), i.cast("string")), 512)

    b64 = F.translate(F.substring(F.base64(F.unhex(rand(1))), 1, 44), "\n", "")
    alnum = F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(rand(2))), "[+/=]", "7"), 1, 16))
    mixed = F.substring(F.regexp_replace(F.base64(F.unhex(rand(3))), "[+/=]", "x"), 1, 36)
    hexes = F.substring(rand(4), 1, 40)
    pick = F.pmod(F.xxhash64(i, F.lit(5)), F.lit(1000)) / 1000.0
    filler = F.element_at(F.array(*[F.lit(x) for x in ["the value of ", "and then ", "see also ", "it was. ", "of the ", ""]]), (F.pmod(F.xxhash64(i, F.lit(6)), F.lit(6)) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in SECRET_NAMES]), (F.pmod(F.xxhash64(i, F.lit(7)), F.lit(len(SECRET_NAMES))) + 1).cast("int"))
    benign = F.element_at(F.array(*[F.lit(x) for x in BENIGN_NAMES]), (F.pmod(F.xxhash64(i, F.lit(8)), F.lit(len(BENIGN_NAMES))) + 1).cast("int"))
    word = F.element_at(F.array(*[F.lit(x) for x in DICTIONARY]), (F.pmod(F.xxhash64(i, F.lit(9)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    compound = F.concat(F.element_at(F.array(*[F.lit(x) for x in ["DB_", "client_", "GITHUB_", "AWS_SECRET_", "my-", '"user_']]), (F.pmod(F.xxhash64(i, F.lit(13)), F.lit(6)) + 1).cast("int")), name)
    short = F.concat(F.substring(mixed, 1, 5), F.element_at(F.array(*[F.lit(x) for x in "!@#$%&*?"]), (F.pmod(F.xxhash64(i, F.lit(14)), F.lit(8)) + 1).cast("int")), F.substring(mixed, 7, 3))
    phrase = F.substring(F.translate(rand(15), "0123456789abcdef", "etaoinshrdlucmwp"), 1, F.pmod(F.xxhash64(i, F.lit(16)), F.lit(12)).cast("int") + 10)
    sign = F.when(pick < 0.5, " = ").otherwise(": ")
    uuid = F.regexp_replace(F.substring(rand(10), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    digits = F.substring(F.translate(rand(11), "abcdef", "123456"), 1, 16)
    dotted = F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit(".eyJ"), F.substring(mixed, 5, 30), F.lit("."), mixed)
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, F.lit("\n"), F.base64(F.unhex(rand(17))), F.lit("\n-----END RSA PRIVATE KEY-----"))
    kinds: list[tuple[Column, Column, Column, int]] = [
        (F.when(pick < 0.5, hexes).otherwise(b64), F.concat(filler, name, sign, F.lit('"')), F.lit('" more'), 1),
        (F.when(pick < 0.5, hexes).otherwise(mixed), F.concat(filler, name, sign), F.lit(" more"), 1),
        (F.concat(F.lit("AKIA"), alnum), filler, F.lit(" more"), 1),
        (F.concat(F.when(pick < 0.3, "ghp_").when(pick < 0.6, "sk-").otherwise("xoxb-"), mixed), filler, F.lit(". more"), 1),
        (F.when(pick < 0.6, mixed).otherwise(b64), F.concat(filler, F.lit('"')), F.lit('"'), 1),
        (F.when(pick < 0.5, short).otherwise(phrase), F.concat(filler, compound, F.when(pick < 0.25, ' = "').when(pick < 0.6, ": ").when(pick < 0.8, '": "').otherwise("=")), F.when(pick < 0.25, '" more').when(pick < 0.6, " more").when(pick < 0.8, '", ').otherwise(" more"), 1),
        (F.when(pick < 0.7, dotted).otherwise(block), F.concat(filler, F.when(pick < 0.3, "Bearer ").otherwise("")), F.lit(" more"), 1),
        (F.when(pick < 0.5, F.concat(F.lit("ghp_"), mixed)).otherwise(b64), F.concat(filler, compound, F.lit("=")), F.lit(" more"), 1),
        (hexes, F.concat(filler, benign, F.lit(" ")), F.lit(" more"), 0),
        (F.substring(rand(12), 1, 64), F.concat(filler, benign, F.lit(": ")), F.lit(" more"), 0),
        (F.when(pick < 0.5, hexes).otherwise(F.substring(rand(12), 1, 32)), filler, F.lit(" more"), 0),
        (uuid, F.concat(filler, F.when(pick < 0.5, F.lit("id=")).otherwise(F.lit(""))), F.lit(" more"), 0),
        (digits, F.concat(filler, F.when(pick < 0.3, F.concat(benign, F.lit(" "))).otherwise(F.lit(""))), F.lit(" more"), 0),
        (F.concat(F.lit("usr/lib/"), word, F.lit("3/"), word, F.lit("/index")), F.concat(filler, F.lit("/")), F.lit(".py"), 0),
        (F.concat(word, F.lit("_example_"), word, F.lit("_"), F.substring(digits, 1, 2)), F.concat(filler, F.when(pick < 0.4, F.concat(name, sign)).otherwise(F.lit(""))), F.lit(" more"), 0),
        (F.concat(F.lit("your_"), word, F.lit("_here_123")), F.concat(name, sign, F.lit('"')), F.lit('"'), 0),
        (F.concat(word, word, word, F.substring(digits, 1, 4), word), F.concat(filler, F.when(pick < 0.5, F.lit("https://site/")).otherwise(F.lit(""))), F.lit("/more"), 0),
    ]
    which = F.pmod(i, F.lit(len(kinds)))

    def choose(k: int) -> Column:
        out = F.lit(None)
        for j, row in enumerate(kinds):
            out = F.when(which == j, row[k] if isinstance(row[k], Column) else F.lit(row[k])).otherwise(out)
        return out

    return spark.range(0, n, 1, 1).select(choose(0).alias("candidate"), choose(1).alias("before"), choose(2).alias("after"), choose(3).cast("double").alias("label"))


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """The forest; findings hold candidate, before, after and label."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings.filter("length(candidate) > 0")))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows.select("features", "label"))


def judged(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Candidates with the forest's score."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def scan(documents: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: doc_id, row, start, length, candidate, score, is_secret.

    Null and empty texts have none; repeated rows are told apart by ``row``;
    other columns are ignored; an empty table gives no rows.  Texts of any
    length are searched whole, inside their row.
    """
    columns = ["doc_id", "row", F.col("start").cast("long").alias("start"), F.length("candidate").alias("length"), "candidate", "score"]
    return judged(candidates(documents), model).select(*columns, (F.col("score") >= threshold).alias("is_secret"))


def redact(documents: DataFrame, model: RandomForestClassificationModel, mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """documents with every secret in text replaced by the mask; all rows and other columns stay.

    Candidates don't overlap.  Null and empty texts stay as they are; rows that
    repeat are masked alike; an empty table stays empty.

    Rows are matched by their texts' digests.  A list of secrets that was
    counted and is small is broadcast; a larger one meets the texts in a
    shuffle join.
    """
    key = [F.xxhash64("text").alias("k1"), F.sha2("text", 256).alias("k2")]
    found = candidates(documents.select("doc_id", "text", *key), "k1", "k2")
    start = F.col("start").cast("int").alias("start")
    hits = write_shared(judged(found, model).filter(F.col("score") >= threshold).select("k1", "k2", start, F.length("candidate").alias("length")).distinct())
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    whole = documents.select(F.struct("*").alias("d"), *key)
    text = F.col("d.text")

    def end(s: Column) -> Column:
        return s["start"] + s["length"]

    def piece(s: Column, i: Column) -> Column:
        last = F.when(i > 0, end(F.get("spans", i - 1))).otherwise(0)
        return F.concat(F.substring(text, last + 1, s["start"] - last), F.lit(mask))

    tail = F.substring(text, end(F.element_at("spans", -1)) + 1, F.length(text))
    clean = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(F.transform("spans", piece), ""), tail)).otherwise(text)
    joined = whole.join(F.broadcast(spans) if few else spans, ["k1", "k2"], "left").select("d", clean.alias("clean"))
    return joined.select(*[F.col("clean").alias(c) if c == "text" else F.col(f"d.`{c}`") for c in documents.columns])
