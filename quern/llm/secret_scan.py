"""Secret scan with a random forest that removes false positives, in DataFrame functions and Spark ML alone.

A candidate is one of: 16 or more of A-Z a-z 0-9 _ + / - with single dots between them and up to two = at the end;
8 or more characters other than blanks, quotes, comma and semicolon right behind a secret's name and an assignment sign;
the password of a url (user:password@). Its features:
length; share of neighbouring characters that change class (lower, upper, digit,
other); share of digits, of capitals, of hexadecimal digits, of distinct characters; share that short
words of a dictionary cover, and that frequent letter pairs cover; whether it begins like a well-known kind of key; whether it is part of a path or url; whether the words just before it name
a secret, or name a checksum, commit, file or id; whether an assignment and a quote stand before it.
Names count as whole words ("key" is not in "keyboard") among the CONTEXT characters of the same line.
The forest is trained from labelled findings, a table of (candidate, before, after, label); at
most `fit_rows` rows of it are used, in the order of a hash. Without a table of one's own,
`labelled_findings` makes one by seeded hashes: keys and passwords with a name before them and bare, and look-alikes (checksums,
ids, paths, numbers, long words, placeholders) bare and with names and assignments before them. What is found and judged covers all rows and whole texts.

Null text has no candidates; null ids and repeated rows pass through. Each row is judged by itself, so
hot sources and copies don't matter. A very long text is cut once by the pattern; its candidates, not the text, are shuffled to be counted.
Columns besides id and text are not read, whatever their names. An empty table gives no findings.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Words that name a secret, words that name something else, and how well-known keys begin.
SECRET_NAMES = ("access", "accesskey", "api", "apikey", "auth", "authtoken", "bearer", "credential", "key", "passphrase", "passwd", "password", "private", "pwd", "secret", "secretkey", "token")
OTHER_NAMES = ("bank", "build", "card", "checksum", "commit", "digest", "etag", "file", "guid", "hash", "id", "integrity", "invoice", "isbn", "keyboard", "md5", "order", "page", "phone", "ref", "revision", "serial", "session", "sha", "sha1", "sha256", "sha512", "tracking", "uuid", "version")
PREFIXES = ("AIza", "AKIA", "ASIA", "SG.", "eyJ", "gho_", "ghp_", "ghs_", "github_pat_", "glpat-", "npm_", "pk_live_", "rk_live_", "sk-", "sk_live_", "sk_test_", "whsec_", "xapp-", "xoxb-", "xoxp-")
#: Short words and word parts of the dictionary, and frequent pairs of letters.
DICTIONARY = ("able", "about", "access", "and", "api", "base", "build", "change", "class", "client", "code", "con", "data", "der", "die", "ence", "ent", "ess", "est", "example", "factory", "file", "for", "from", "heit", "here", "index", "ing", "insert", "ion", "ique", "ist", "ité", "keit", "key", "les", "ment", "my", "name", "not", "object", "ous", "page", "pass", "placeholder", "que", "request", "sch", "secret", "server", "service", "some", "test", "that", "the", "tion", "token", "und", "ung", "user", "value", "ver", "with", "word", "your")
PAIRS = ("an", "ar", "at", "ch", "de", "ed", "el", "en", "er", "es", "ge", "ha", "he", "hi", "ie", "in", "is", "it", "la", "le", "me", "nd", "ne", "ng", "nt", "on", "or", "ou", "ra", "re", "ri", "se", "st", "te", "th", "ti", "to", "un", "ur", "ve")

_NAMES = "|".join(SECRET_NAMES)
_RUN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-](?:\.?[A-Za-z0-9_+/-]){15,}+={0,2}"
_ASSIGNED = rf"""(?<=[=:][ \t]{{0,2}}["'`]?)(?<=(?<![A-Za-z])(?i:{_NAMES})s?["'`\]]{{0,2}}[ \t]{{0,2}}[=:][ \t]{{0,2}}["'`]?)[^\s"'`,;]{{8,}}+"""
_IN_URL = r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/:@]{4,}+(?=@)"
SHAPE = f"{_IN_URL}|{_ASSIGNED}|{_RUN}"
CONTEXT, FIT_ROWS, TREES, DEPTH, SEED = 40, 8000, 30, 8, 11
FEATURES = ("length", "changes", "digits", "capitals", "hex", "distinct", "words", "pairs", "prefix", "path", "named", "other_name", "assigned", "quoted")


def _any(words) -> str:
    return "|".join(sorted((w.replace(".", r"\.") for w in words), key=lambda w: (-len(w), w)))


def features(found: DataFrame) -> DataFrame:
    """found (candidate, before, after, ...) with the features added."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.char_length(c)

    def share(pattern):
        return (n - F.char_length(F.regexp_replace(c, pattern, ""))) / n

    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[_+/=.-])(?=[A-Za-z0-9])"
    near = F.right(F.substring_index(F.right(before, F.lit(CONTEXT)), "\n", -1), F.lit(24))
    names = {k: rf"(?i)(?<![a-z])({_any(words)})s?(?![a-z])" for k, words in (("named", SECRET_NAMES), ("other_name", OTHER_NAMES))}
    return found.select(
        "*", n.cast("double").alias("length"), ((F.char_length(F.regexp_replace(c, change, " ")) - n) / n).alias("changes"), share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"), share("[0-9A-Fa-f]").alias("hex"), (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        share(f"(?i)({_any(DICTIONARY)})").alias("words"), share(f"(?i)({_any(PAIRS)})").alias("pairs"), c.rlike(f"^({_any(PREFIXES)})").cast("double").alias("prefix"),
        (c.rlike(r"^/|\w/\w+/\w|\.[a-z]{2,4}$") | before.rlike(r"(://|[/\\.])\S*$") | after.rlike(r"^[./\\]\w")).cast("double").alias("path"),
        *[near.rlike(pattern).cast("double").alias(k) for k, pattern in names.items()],
        before.rlike(r"""[=:][ \t]{0,2}["'`]?$""").cast("double").alias("assigned"), before.rlike(r"""["'`]$""").cast("double").alias("quoted"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, place (from 0), start (characters before it), candidate, before, after."""
    # the pattern's finds are set between zero characters (in the text these become \x01), so the text is searched once
    marked = F.regexp_replace(F.translate(F.col(text_col), "\x00", "\x01"), f"({SHAPE})", "\x00$1\x00")
    # a generator's output is not repeated inside the functions below
    x = docs.select(F.col(id_col).alias("id"), F.explode(F.array(F.split(marked, "\x00", -1))).alias("parts")).filter(F.size("parts") > 1)

    def find(i):
        gap, c = F.get("parts", i - 1), F.get("parts", i)
        return F.struct(
            F.floor(i / 2).alias("place"), c.alias("candidate"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.get("parts", i + 1), F.lit(CONTEXT)).alias("after"),
            (F.char_length(gap) + F.char_length(c)).cast("long").alias("step"),
        )

    x = x.withColumn("row", F.monotonically_increasing_id())
    x = x.select("id", "row", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2)), find)).alias("e")).select("id", "row", "e.*")
    end = F.sum("step").over(Window.partitionBy("row").orderBy("place"))
    return x.select("id", "place", (end - F.char_length("candidate")).alias("start"), "candidate", "before", "after")


def labelled_findings(spark: SparkSession, rows: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """candidate, before, after, label: half secrets, half look-alikes, from seeded hashes."""

    def h(n):
        return F.sha2(F.concat_ws("|", F.lit(seed), F.col("id"), F.lit(n)), 256)

    def pick(n, *values):
        return F.get(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), F.pmod(F.xxhash64(h(n)), F.lit(len(values))))

    def letters(n, size):
        return F.left(F.regexp_replace(F.base64(F.unhex(F.concat(h(n), h(n + "+")))), "[+/=]", ""), F.lit(size))

    def syllables(n, count):
        return F.concat(*[pick(f"{n}{i}", *PAIRS, "e", "s") for i in range(count)])

    hexa = pick("c", h("b"), F.upper(h("b")))
    digest = pick("d", F.left(hexa, F.lit(32)), F.left(hexa, F.lit(40)), hexa)
    uuid = F.concat_ws("-", *[F.substring(h("u"), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    number = F.lpad(F.conv(F.left(h("n"), F.lit(13)), 16, 10), 16, "4")
    mixed = pick("m", letters("m1", 20), letters("m2", 24), letters("m3", 32), letters("m4", 43), F.base64(F.unhex(h("m5"))))
    known = F.concat(pick("p", *[p for p in PREFIXES if p[-1] in "_-a"]), pick("k3", letters("k", 24), letters("k4", 36), F.left(h("k5"), F.lit(40)), F.concat(letters("k6", 8), F.left(h("k7"), F.lit(28)))))
    aws, jwt = F.concat(pick("w", "AKIA", "ASIA"), F.upper(letters("a", 16))), F.concat(F.lit("eyJ"), letters("j1", 30), F.lit(".eyJ"), letters("j2", 40), F.lit("."), letters("j3", 43))
    short = F.concat(syllables("s", 3), pick("s!", "!", "#", "$9", "_", "@", "."), F.left(h("s#"), F.lit(3)), pick("s?", "", "X", "Zq", "!"))
    name = F.concat(pick("n", "my_", "db_", "aws ", "", "", "", "the "), pick("n2", "token", "api_key", "secret", "password", "auth", "access_key", "client_secret", "TOKEN", "SECRET", "bearer", "passwd", "API key", "private key", "Token"))
    sign = pick("g", ' = "', '="', '": "', " = '", ": ", "=", "=", ' = "', ": ")
    talk = pick("t", "The result was used. ", "und dann ", "avec le ", "no hay ", "see the list\n", "it is, ", "", "ereti on ", "{", "Réponse | ", "!! ", "// ")
    words = syllables("v", 9)
    camel = F.concat(pick("c1", "Abstract", "Simple", "Default", "Request"), pick("c2", "Factory", "Service", "Value", "Server"), pick("c3", "BeanProvider", "ErrorHandler", "TestRunner", "Index"))
    path = F.concat(pick("f", "static/files/", "/assets/img/", "src/main/java/", "var/log/app/"), pick("f2", F.left(h("b"), F.lit(16)), syllables("f", 4)), pick("f3", ".png", ".html", "", ".min.js"))
    site = F.concat(F.lit("www."), syllables("q", 5), F.lit(".com/"), syllables("q2", 4), pick("q3", "", "/index", "-2023"))
    blank = pick("b", "your_api_key_here", "xxxxxxxxxxxxxxxx", "insert-your-token-here", "****************", "${SECRET_TOKEN}", "<your-password>", "changeme_placeholder", "process.env.API_TOKEN", "example-password", "0000000000000000", "some_secret_value", "test-token-example")
    phrase = F.concat(syllables("r", 4), pick("r2", "-", "_", ""), syllables("r3", 5))
    other = F.concat(pick("o", "commit", "sha1", "checksum", "file", "md5", "order", "card", "build", "uuid", "etag", "keyboard", "request_id", "session id", "version", "tracking", "integrity", "sha256"), pick("o2", " ", ": ", "=", '="', " = '", ' = "'))
    case, positive = F.floor(F.col("id") / 2) % 20, F.col("id") % 2 == 0
    named, behind = F.concat(talk, name, sign), F.concat(talk, other)
    bare = F.concat(talk, pick("y", "", "", "id ", "AWS id ", 'x = "', "value: "))
    word = F.concat(syllables("e", 4), pick("e4", "", "er", "ing", "ment"))

    def by(*cases):  # (first case that it is not for, value)
        found = F
        for end, value in cases:
            found = found.when(case < end, value)
        return found

    yes = by((6, digest), (9, mixed), (11, short), (13, known), (14, known), (15, aws), (16, aws), (17, jwt), (18, mixed), (20, short))
    yes_before = by((11, named), (13, named), (14, bare), (15, named), (16, bare), (17, bare), (18, talk), (20, F.concat(talk, F.lit("https://user:"))))
    no = by((4, digest), (6, digest), (7, uuid), (8, uuid), (10, number), (12, path), (13, site), (15, blank), (16, phrase), (17, words), (18, camel), (20, word))
    no_before = by((4, behind), (6, talk), (7, behind), (8, talk), (9, behind), (10, talk), (13, F.concat(talk, pick("z1", "", "https://", "/", "file "))), (16, named), (17, talk), (18, talk), (20, named))
    closing = F.when(sign.contains('"'), '"').when(sign.contains("'"), "'").otherwise("")
    before = F.when(positive, yes_before).otherwise(no_before)
    after = F.concat(F.when(before.endswith('"') | before.endswith("'"), closing).otherwise(""), F.when(positive & (case >= 18), "@").otherwise(pick("z", ". Then", "\nnext", " and", "")))
    return spark.range(rows).select(F.when(positive, yes).otherwise(no).alias("candidate"), before.alias("before"), after.alias("after"), positive.cast("double").alias("label"))


def train(findings: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """A forest on at most fit_rows findings."""
    rows = cut(features(findings.orderBy(F.xxhash64("candidate", "before", "after"), "label").limit(fit_rows)))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def judge(found: DataFrame, model: PipelineModel) -> DataFrame:
    """found with probability (of a secret) and is_secret."""
    names = found.columns
    scored = model.transform(features(found))
    return scored.select(*names, F.round(vector_to_array("probability")[1], 6).alias("probability")).withColumn("is_secret", F.col("probability") >= 0.5)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, place, start, candidate, before, after, probability, is_secret of every candidate."""
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    return judge(candidates(docs, id_col, text_col), model).withColumnRenamed("id", id_col)


def op9_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", "start", F.char_length("candidate").cast("long").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("finding_sha256"), "probability", "is_secret")
