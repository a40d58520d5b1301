"""Secret scan with a random forest that removes false positives. DataFrame and SQL functions only.

Candidates are values behind an announcing word and an equals sign or colon, and long runs of key characters with a digit. Features of a candidate: its length, its transitions between character classes and
its digits, how much of it dictionary words cover, what path it stands in and the words next to it. The forest is fitted on labelled
findings and then written out as CASE expressions, so that scoring stays within code generation.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intentdeck.llm._common import read_table

#: Characters before and after a candidate that its features see.
CONTEXT = 48
THRESHOLD = 0.5
REDACTED = "[SECRET]"
TREES, TREE_DEPTH, SEED = 15, 5, 5
#: The most labelled findings that a forest is fitted on.
TRAINING_ROWS = 20_000

#: Words that keys do not hold, words that announce a secret, and words that announce something else of that look.
DICTIONARY = "about account address admin after again also article before build cache change check class client cluster code color commit config content count create current custom data date debug default delete demo dummy email error event example false field file first format from function group header host html http https image import index info input insert internal item json language level library license list local location login main master message method model module name network node null number object option order output package page param parent path placeholder plugin point post private process product profile project public query read record release remote report request resource response result root sample schema script search section select server service session setting source start state static status string style system table target task template test text this time title tool true type update upload user value version video view void volume world write your".split()
SECRET_WORDS = "token secret password passwd pwd apikey api_key api-key access_key access-key auth credential credentials bearer private_key client_secret signing".split()
PLAIN_WORDS = "uuid guid commit revision sha sha1 sha256 md5 checksum digest hash etag version build isbn phone order invoice number card page ref utm id src href url".split()
TEST_PATHS = "test tests spec example examples sample samples doc docs fixture fixtures mock demo".split()

FEATURES = ("length", "transitions", "digits", "upper", "hexadecimal", "distinct", "covered", "repeats", "symbols", "in_path", "test_path", "secret_near", "secret_before", "plain_near", "assigned")


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


#: What stands between an announcing word and its value.
ASSIGN = r"[\"']?\s{0,3}(?:[:=]|=>|:=)\s{0,3}[\"'`]?"
#: A value of six characters or more behind an announcing word; else a run of at least 16 key characters with a digit, in up to five parts between dots.
CANDIDATE = (
    r"(?<=[:=>\s\"'`])(?<=[:=>]\s{0,3}[\"'`]{0,1})(?<=(?i:" + _any(SECRET_WORDS) + ")" + ASSIGN + r")(?![\s:=>\"'`])[^\s\"'`,;<>(){}\[\]]{6,}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9+/_-]{16,}){0,4}={0,2}"
)


def features(secret: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The FEATURES of a candidate, all doubles; nulls of the context count as empty."""
    empty = F.lit("")
    before, after, path = F.coalesce(before, empty), F.coalesce(after, empty), F.lower(F.coalesce(path, empty))
    n = F.length(secret).cast("double")
    count = lambda rx: F.regexp_count(secret, F.lit(rx)).cast("double")
    flag = lambda c: c.cast("double")
    low = F.lower(secret)
    tail = F.lower(before)
    return [
        n,
        count(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=-])(?=[^+/_=-])") / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        flag(F.rlike(low, F.lit("^(?:[0-9a-f]{32,}|0x[0-9a-f]+)$"))),
        F.size(F.array_distinct(F.split(secret, ""))).cast("double") / n,
        (n - F.length(F.regexp_replace(low, _any(DICTIONARY), ""))) / n,
        F.regexp_count(secret, F.lit(r"(.)\1")).cast("double") / n,
        count("[+/_=-]") / n,
        flag(F.rlike(F.concat(F.right(before, F.lit(1)), secret), F.lit(r"^[/.\\@#?&]|/.*/.*/|\w/\w+-\w+-"))),
        flag(F.rlike(path, F.lit(r"(?:^|[^a-z])" + _any(TEST_PATHS) + r"(?:$|[^a-z])"))),
        flag(F.rlike(tail, F.lit(_any(SECRET_WORDS)))),
        flag(F.rlike(tail, F.lit(_any(SECRET_WORDS) + r"[\"']?\s{0,3}(?:[:=]|=>|:=|is)?\s{0,3}[\"'`]?$"))),
        flag(F.rlike(tail, F.lit(r"(?:^|[^a-z])" + _any(PLAIN_WORDS) + r"[^a-z0-9]{0,6}$"))),
        flag(F.rlike(before, F.lit(r"[:=]\s{0,3}[\"'`]?$")) | F.rlike(after, F.lit("^[\"'`]"))),
    ]


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Made findings with their label (secret, before, after, path, label), for when no reviewed ones are given.

    Everything follows from the row's number. Half are keys behind words that announce a secret, the rest the usual false
    positives: digests behind words such as commit, uuids, card and telephone numbers, placeholders, paths, versions and joined words.
    """
    h = lambda salt: F.xxhash64(F.lit(salt), "id")
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(h(salt), F.lit(len(words))) + 1).cast("int"))
    many = lambda salt, low, high: (F.pmod(h(salt), F.lit(high - low + 1)) + low).cast("int")
    hexa = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(hexa("b"))), "=+$", "")
    filler = F.concat(pick(DICTIONARY, "f1"), F.lit(" "), pick(DICTIONARY, "f2"), F.lit(" "), pick(DICTIONARY, "f3"), F.lit(" "))
    opens = pick(['"', "'", "", "`"], "q")
    says = F.concat(pick(SECRET_WORDS, "s"), pick([" = ", "=", ": ", ":", " => "], "e"), opens)
    case = lambda c: F.when(F.pmod(h("case"), F.lit(4)) == 0, F.upper(c)).otherwise(c)
    word = F.concat(pick(DICTIONARY, "w1"), many("w2", 0, 999).cast("string"), pick(["!", "#", "$", "", "_"], "w3"), pick(["x", "Q7", "correct", "zz"], "w4"))
    letters = F.regexp_replace(F.base64(F.unhex(hexa("y"))), "[^A-Za-z]", "")
    key = F.when(many("k", 0, 5) == 4, word).when(many("k", 0, 5) == 5, F.substring(letters, F.lit(1), many("n", 16, 30))).when(many("k", 0, 3) <= 1, case(F.substring(hexa("x"), F.lit(1), pick_len := F.when(many("l", 0, 2) == 0, 32).when(many("l", 0, 2) == 1, 40).otherwise(64)))).when(many("k", 0, 3) == 2, F.substring(b64, F.lit(1), many("n", 20, 43))).otherwise(F.concat(pick(["sk-", "ghp_", "AKIA", "xoxb-", ""], "p"), F.upper(F.substring(b64, F.lit(1), many("n", 18, 36)))))
    digits = F.regexp_replace(hexa("d"), "[a-f]", "")
    uuid = F.concat_ws("-", *[F.substring(hexa("u"), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kind = many("kind", 0, 7)
    plain_says = F.concat(pick(PLAIN_WORDS, "p2"), pick([" ", ": ", "=", " #", " = "], "e2"))
    joined = F.concat(pick(DICTIONARY, "j1"), F.lit("_"), pick(DICTIONARY, "j2"), F.lit("-"), pick(DICTIONARY, "j3"), many("j4", 1, 99).cast("string"))
    fake = (
        F.when(kind == 0, F.substring(hexa("x"), F.lit(1), pick_len))
        .when(kind == 1, uuid)
        .when(kind == 2, F.rpad(F.substring(digits, 1, 16), 16, "4"))
        .when(kind == 3, F.concat(pick(["xxxxxxxxxxxxxxxx", "0000000000000000", "example-placeholder-", "your-token-here-1", "changeme-changeme1", "changeme", "password", "placeholder", "required", "none-", "${TOKEN}", "<secret>", "example"], "ph"), many("j4", 1, 99).cast("string")))
        .when(kind == 4, F.concat(F.lit("/"), pick(DICTIONARY, "j1"), F.lit("/"), pick(DICTIONARY, "j2"), F.lit("/"), joined))
        .when(kind == 5, F.concat(F.lit("v1-2-"), joined))
        .when(kind == 6, F.rpad(F.substring(digits, 1, 20), 20, "7"))
        .otherwise(F.concat(joined, F.lit("-"), joined))
    )
    fake_before = F.when(kind == 3, F.concat(filler, says)).when(kind.isin(0, 1), F.concat(filler, plain_says)).when(F.pmod(h("pb"), F.lit(2)) == 0, F.concat(filler, plain_says)).otherwise(filler)
    true = F.pmod(h("label"), F.lit(2)) == 0
    bare = F.pmod(h("bare"), F.lit(12)) == 0
    path = F.when(F.pmod(h("path"), F.lit(5)) == 0, F.concat(pick(TEST_PATHS, "tp"), F.lit("/a.py"))).otherwise(F.concat(pick(["src", "conf", "app", "lib", "src0", "src7"], "tp"), F.lit("")))
    return spark.range(rows).select(
        F.when(true, key).otherwise(fake).alias("secret"),
        F.when(true, F.when(bare, F.concat(filler, opens)).otherwise(F.concat(filler, says))).otherwise(fake_before).alias("before"),
        F.when(true, F.concat(opens, F.lit(" and more"))).otherwise(F.lit(" and more")).alias("after"),
        path.alias("path"),
        true.cast("double").alias("label"),
    )


class Forest:
    """Trees as nested tuples: a probability, or (feature, threshold, left, right)."""

    def __init__(self, trees: list, model=None):
        self.trees, self.model = trees, model  # the fitted model that the trees were read from, if any

    @staticmethod
    def fit(findings: DataFrame, rows: int = TRAINING_ROWS, trees: int = TREES, depth: int = TREE_DEPTH, seed: int = SEED) -> Forest:
        """Fit on findings (secret, before, after, path, label 0/1). Rows with a null secret or label teach nothing; at most ``rows`` rows are used, by hash order."""
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        known = findings.where("secret is not null and secret <> '' and label in (0, 1)")
        known = known.select(*[c.alias(n) for c, n in zip(features(F.col("secret"), F.col("before"), F.col("after"), F.col("path")), FEATURES, strict=True)], F.col("label").cast("double").alias("label"), F.xxhash64("secret", "before").alias("h")).orderBy("h").limit(rows).drop("h")
        kinds = {r[0] for r in known.select("label").distinct().collect()}
        if len(kinds) < 2:
            return Forest([float(next(iter(kinds), 0.0))])
        table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known).coalesce(1)
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(table)

        def read(node):
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                return stats[1] / sum(stats)
            split = node.split()
            return (split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild()))

        return Forest([read(t.rootNode()) for t in model._java_obj.trees()], model)

    def score(self, values: list[Column]) -> Column:
        """The mean of the trees' probabilities."""

        def tree(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            at, threshold, left, right = t
            return F.when(values[at] <= threshold, tree(left)).otherwise(tree(right))

        total = tree(self.trees[0])
        for t in self.trees[1:]:
            total = total + tree(t)
        return F.round(total / len(self.trees), 6)


@lru_cache(maxsize=4)
def _made_forest(app: str) -> Forest:
    return Forest.fit(labelled_findings(SparkSession.getActiveSession()))


def default_forest(spark: SparkSession) -> Forest:
    """Fitted on labelled_findings(), once for each application."""
    return _made_forest(spark.sparkContext.applicationId)


def _candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _pieces and _cands: text == pieces[0] + cands[0] + pieces[1] + ... for every row with a candidate."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("_cands", F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1)))
    return df.withColumn("_pieces", F.when(F.size("_cands") > 0, F.split(text, CANDIDATE, -1)))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, length, secret, score, is_secret) for every candidate in every text; start counts characters from 0.

    A null or empty text has no candidates; null ids and repeated rows keep their findings; path_col None: no path is known.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    df = _candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), path.alias("_path")), "_text").where(F.size("_cands") > 0)
    zipped = F.zip_with(F.col("_cands"), F.slice("_pieces", F.lit(1), F.size("_cands")), lambda c, p: F.struct(c.alias("secret"), p.alias("piece")))
    df = df.select("doc_id", "_path", "_pieces", F.posexplode(zipped).alias("k", "z"), F.aggregate(zipped, F.array(F.lit(0)), lambda a, z: F.concat(a, F.array(F.element_at(a, -1) + F.length(z["piece"]) + F.length(z["secret"])))).alias("_ends"))
    df = df.select("doc_id", "_path", F.col("z.secret").alias("secret"), F.right(F.col("z.piece"), F.lit(CONTEXT)).alias("_before"), F.left(F.get("_pieces", F.col("k") + 1), F.lit(CONTEXT)).alias("_after"), (F.get("_ends", F.col("k")) + F.length("z.piece")).cast("long").alias("start"))
    df = df.select("doc_id", "start", "secret", *[c.alias(f"_f{i}") for i, c in enumerate(features(F.col("secret"), F.col("_before"), F.col("_after"), F.col("_path")))])
    scored = df.select("doc_id", "start", F.length("secret").cast("long").alias("length"), "secret", forest.score([F.col(f"_f{i}") for i in range(len(FEATURES))]).alias("score"))
    return scored.withColumn("is_secret", (F.col("score") >= threshold).cast("int"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret in text_col replaced by REDACTED, all else as it was; without any row-crossing work."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    # the row goes along as one column, so that no name clashes
    df = _candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"), path.alias("_path")), "_text")
    path = F.col("_path")
    at = F.sequence(F.lit(0), F.size("_cands") - 1)

    def seen(k):
        c = F.get("_cands", k)
        values = features(c, F.right(F.get("_pieces", k), F.lit(CONTEXT)), F.left(F.get("_pieces", k + 1), F.lit(CONTEXT)), path)
        return F.struct(k.alias("k"), *[v.alias(f"f{i}") for i, v in enumerate(values)])

    df = df.withColumn("_seen", F.when(F.size("_cands") > 0, F.transform(at, seen)))
    scored = F.transform("_seen", lambda s: F.concat(F.get("_pieces", s["k"]), F.when(forest.score([s[f"f{i}"] for i in range(len(FEATURES))]) >= threshold, F.lit(REDACTED)).otherwise(F.get("_cands", s["k"]))))
    text = F.when(F.size("_cands") > 0, F.concat(F.array_join(scored, ""), F.element_at("_pieces", -1))).otherwise(F.col("_row").getField(text_col))
    return df.select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op8_secret_scan(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(docs, default_forest(spark)).withColumn("secret_sha256", F.sha2("secret", 256)).drop("secret")
