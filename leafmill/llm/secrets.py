"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of ``LEAST`` or more characters of keys and tokens that has
both a letter and a digit, or any value of ``ASSIGNED_LEAST`` characters and more
that is assigned to a word for secrets, whatever it is made of. Its features are
its length, the shares of character kinds, transitions between them, distinct
characters, how much of it frequent words of the corpus cover, whether it begins
as known keys do, whether it stands in a path or address, and the words before
and after it. The forest (Spark ML, on the JVM) is trained on labelled findings: a
table with value, before, after and label, or the generated one below, whose rows
follow from their numbers. There, secrets and other strings share forms and
contexts: a part of the secrets stands beside no word for secrets, and a part of
the others (stand-ins, calls, types, variables, digests) beside one. Everything is
DataFrame functions.

Edge cases: null and empty texts have no candidates; repeated rows are reported
each; a null doc_id is carried along; without candidates there are no rows.
Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import common
from leafmill.llm.spans import document_counts, spans

LEAST, ASSIGNED_LEAST, BEFORE, AFTER = 16, 6, 40, 20
#: Documents that must hold a word for it to be in the dictionary.
MIN_DOCUMENTS = 5
TREES, DEPTH, SEED, THRESHOLD = 30, 6, 17, 0.5
#: Rows of the generated table of labelled findings.
FINDINGS = 4000
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{%d,}+={0,2}" % LEAST
#: Words beside secrets, beside other long strings, and of stand-ins.
SECRET_WORDS = "token|secret|password|passwd|pwd|apikey|api_key|api-key|key|auth|bearer|credential|credentials|access|private"
OTHER_WORDS = "sha|sha1|sha256|md5|checksum|commit|hash|digest|uuid|guid|rev|revision|version|etag|build|isbn|serial|fingerprint|integrity|id"
STANDINS = "example|sample|dummy|placeholder|changeme|your|xxxx|test|redacted"
#: How keys of well-known services begin.
BEGINNINGS = "AKIA|ASIA|gh[pousr]_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|eyJ"
#: A value behind a word for secrets and a sign of assignment.
ASSIGNED = rf"""(?<=[=:"'\s])(?<=(?i:{SECRET_WORDS})["']?\s{{0,2}}[=:]\s{{0,2}}["']?)(?<![=:]["']?[=:]["']?)[^\s"'<>=:][^\s"'<>]{{{ASSIGNED_LEAST - 1},}}+"""
FEATURES = ["known_beginning", "symbols", "call", "length", "digits", "capitals", "hexadecimal", "transitions", "distinct", "covered", "in_path", "extension", "secret_word", "other_word", "assigned", "quoted", "standin"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, value, before, after) of every candidate."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = F.lower("text").rlike(SECRET_WORDS)
    found = text.select("doc_id", "text", spans(F.col("text"), CANDIDATE).alias("runs"), spans(F.col("text"), ASSIGNED, named).alias("assigned"))
    apart = F.filter("assigned", lambda a: ~F.exists("runs", lambda r: (r["start"] < a["end"]) & (a["start"] < r["end"])))
    found = found.select("doc_id", "text", F.sort_array(F.concat("runs", apart)).alias("found"))

    def beside(s: Column) -> Column:
        begin = F.greatest(s["start"] - BEFORE, F.lit(0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.substring("text", begin + 1, s["start"] - begin).alias("before"), F.substring("text", s["end"] + 1, F.lit(AFTER)).alias("after"))

    # the outer form of explode: the plain one pushes a filter down that searches every text once more
    out = found.select("doc_id", F.explode_outer(F.transform("found", beside)).alias("c")).where("c is not null")
    return out.select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"), "c.value", "c.before", "c.after")


def parts(value: Column) -> Column:
    """The runs of letters in a candidate that could be words."""
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z]{4,}"), F.lit(0))


def dictionary(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term): the words in candidates that are frequent in the corpus."""
    terms, _ = common.stage(found.select(F.explode_outer(parts(F.col("value"))).alias("term")).where("term is not null").distinct(), "parts")
    frequent, _ = common.stage(document_counts(docs, terms).where(F.col("n") >= MIN_DOCUMENTS).select("term"), "dictionary")
    return frequent


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the features."""
    named = found.withColumn("__row", F.xxhash64("value"))
    pieces = named.select("__row", "value").distinct().select("__row", F.explode_outer(parts(F.col("value"))).alias("term")).where("term is not null")
    covered = pieces.join(words, "term").groupBy("__row").agg(F.sum(F.length("term")).alias("n_covered"))
    value, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda test: test.cast("double")
    before = F.lower("before")
    return named.join(covered, "__row", "left").withColumns({
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "hexadecimal": share("[0-9a-f]"),
        "transitions": share("(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "covered": F.coalesce(F.col("n_covered"), F.lit(0)) / n,
        "known_beginning": flag(value.rlike(f"^(?:{BEGINNINGS})")),
        "symbols": share("[^A-Za-z0-9]"),
        "call": flag(value.rlike(r"[(){}$\[\]]|^[A-Z_]+$|\.[a-z_]+")),
        "in_path": flag(value.rlike("/.*/") | F.col("before").rlike(r"(?:[/\\]|://\S*)$")),
        "extension": flag(F.col("after").rlike(r"^\.[a-z]{1,5}\b")),
        "secret_word": flag(before.rlike(rf"(?<![a-z])(?:{SECRET_WORDS})(?![a-z])[^a-z]{{0,6}}\S{{0,12}}$")),
        "other_word": flag(before.rlike(rf"(?<![a-z])(?:{OTHER_WORDS})(?![a-z])[^a-z]{{0,6}}\S{{0,12}}$")),
        "assigned": flag(F.col("before").rlike(r"[=:]\s?[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "standin": flag(F.lower("value").rlike(STANDINS) | before.rlike(rf"(?:{STANDINS})\W*$")),
    }).drop("__row", "n_covered")


#: Words of the generated contexts: those of fits, and others of held-out figures. Each: of secrets, of other strings, of neither.
CONTEXTS = {
    "fit": (
        ['token = "', "token: ", 'api_key="', "password=", "secret: '", "Authorization: Bearer ", 'access key = "', "private_key = ", "PASSWORD=", "pwd: "],
        ["commit ", "sha256:", "checksum = ", "in the file ", "https://host.example/", "uuid ", 'the version "', "md5 = ", 'id="', "revision: "],
        [" and of ", "the value is ", "use ", "export X=", '"', "then ", "(", "see "],
    ),
    "held": (
        ['auth_token="', "passwd: ", "db.password = '", "client_secret=", "credentials: ", "SECRET_KEY=", "bearer ", "key='"],
        ["fingerprint ", "digest: ", "etag=", "build ", "stored under ", "http://files.example/a/", "serial ", "guid: "],
        ["with ", "it was ", "= ", "set to ", "[", "value: "],
    ),
}


def findings(spark: SparkSession, n: int = FINDINGS, of: str = "fit") -> DataFrame:
    """(value, before, after, label): generated findings, alike in every session; ``of`` names the words of their contexts.

    Seven secrets in ten stand beside a word for secrets, and two other strings in
    ten; keys of known beginnings and readable passwords aside, both have the same forms.
    """
    i, salted = F.col("id"), lambda salt: F.xxhash64(F.col("id"), F.lit(f"{of}{salt}"))
    at = lambda salt, n: F.pmod(salted(salt), F.lit(n)).cast("int")
    pick = lambda salt, options: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), at(salt, len(options)) + 1)
    hexed = F.sha2(F.concat(F.lit(of), i.cast("string")), 256)
    base64 = F.base64(F.unhex(F.sha2(F.concat(F.lit(f"b{of}"), i.cast("string")), 512)))
    size = at("n", 25) + 16
    words = ["data", "model", "train", "report", "image", "index", "release", "config", "user", "block", "river", "copper"]
    word = lambda k: pick(f"w{k}", words)
    uuid = F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12))
    name = F.concat_ws("_", word(0), word(1), word(2), at("d", 100).cast("string"))
    strings = [F.substring(hexed, 1, 40), F.substring(hexed, 1, 18), F.substring(base64, F.lit(1), size)]
    readable = F.concat(F.initcap(word(0)), at("d", 1000).cast("string"), pick("s", ["!", "&", "#", "$", "."]), word(1))
    phrase = F.concat_ws("-", word(0), word(1), word(2))
    prefixed = F.concat(pick("p", ["AKIA", "ghp_", "sk-", "xoxb-"]), F.upper(F.substring(hexed, F.lit(1), size)))
    secret = pick("v", [*strings, prefixed, prefixed, readable, phrase])
    standin = pick("t", ["your_api_key_here", "changeme123", "get_token()", "os.environ", "${PASSWORD}", "required", "string", "example-key-0000", "settings.SECRET"])
    other = pick("o", [uuid, hexed, name, F.concat(F.lit("src/"), F.replace(name, F.lit("_"), F.lit("/"))), *strings, standin, standin])
    good, bad, none = CONTEXTS[of]
    chance = at("c", 10)
    before = F.when(F.col("label") == 1, F.when((chance < 7) | F.col("readable"), pick("g", good)).otherwise(pick("u", none)))
    before = F.when(F.col("label") == 1, before).otherwise(F.when(F.col("standin") | (chance < 2), pick("g", good)).when(chance < 7, pick("h", bad)).otherwise(pick("u", none)))
    rows = spark.range(n).withColumn("label", (i % 2).cast("double")).withColumn("secret", secret).withColumn("other", other)
    rows = rows.withColumn("readable", (F.col("secret") == readable) | (F.col("secret") == phrase)).withColumn("standin", F.col("other") == standin)
    rows = rows.withColumn("value", F.when(F.col("label") == 1, F.col("secret")).otherwise(F.col("other"))).withColumn("before", before)
    rows = rows.withColumn("after", F.when(F.col("before").rlike("\"$"), F.lit('" and')).when(F.col("before").rlike("'$"), F.lit("' and")).when(F.col("before") == "in the file ", F.lit(".txt is")).otherwise(F.lit(" and")))
    return rows.select("value", "before", "after", "label")


def train(labelled: DataFrame, words: DataFrame) -> PipelineModel:
    """The forest of labelled findings."""
    rows, _ = common.stage(described(labelled, words).select(*FEATURES, "label"), "findings")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, value, score, is_secret) of every candidate."""
    spark = docs.sparkSession
    found, _ = common.stage(candidates(docs), "candidates")
    labelled = findings(spark) if labelled is None else labelled
    words = dictionary(docs, reduce(DataFrame.union, [found.select("value"), labelled.select("value")]))
    model = train(labelled, words)
    scored = model.transform(described(found, words)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select("doc_id", "start", "end", "value", "score", (F.col("score") >= threshold).alias("is_secret"))
