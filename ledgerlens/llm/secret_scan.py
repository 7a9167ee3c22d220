"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a token core of 16 or more credential characters with a digit, a
private-key header, or by its place, whatever its characters, a value of six or
more after a name that announces a credential or in the user part of a URL.  A
token has as many candidates as it has such parts.  Its features: length, character transitions and
classes, spread of characters, dictionary coverage, path marks, and what the
neighbouring words say.  The forest learns from labelled findings: a seed of
known shapes in known surroundings plus all of the corpus's own candidates,
labelled where the shape or the surroundings settle it.

DataFrame functions and the DataFrame API of Spark ML only.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, free_name, small_side, stored, text_or_empty

#: A run of credential characters; "=" is its padding only where no value follows, else it ends a name.
CORE = r"[A-Za-z0-9_+/.~-]{14,}(?:={1,2}(?![\"'`]?[A-Za-z0-9_+/=.~-]))?"
#: What parts the fields of a token (JSON, CSV, query strings); never part of a core.
FIELD = r"[,;&?|{}()\[\]<>]+"
#: A field that brings its own name.
NAMED = r"^[\"'`\\]*[A-Za-z_][A-Za-z0-9_.-]*[\"'`\\]*[=:]"
KEY_START = "-----BEGIN"
KEY_BLOCK = "PRIVATE KEY"
KEY_HEADER = f"{KEY_START} {KEY_BLOCK}-----"
# Openings of credentials that providers issue.
PREFIXED = r"^(AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_](live|test)?[-_]?[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_.-]{8,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36})"
# Words that announce a credential, and words that announce a harmless digest or id.
ANNOUNCE = r"(?i)(token|secret|passw|api.?key|access.?key|auth|bearer|credential|private)"
HARMLESS = r"(?i)(commit|sha-?\d*|md5|checksum|digest|uuid|guid|etag|revision|build|example|sample|hash|version|isbn|doi)"
#: A name that announces its value, up to the sign before the value, and the value: up to a quote, comma,
#: semicolon or the next field of a query.
NAME_ENDS = ANNOUNCE + r"[A-Za-z0-9_.-]{0,24}[\"'`\\]*[=:]"
VALUE = r"[\"'`\\]*((?:(?!&[A-Za-z_]+=)[^\"'`\\\s,;]){6,})"
#: The password of a URL's user part.
URL_USER = r"://[^/\s:@\"'`]*:([^/\s\"'`]{6,})@"
#: Words and pieces whose presence speaks against a random string.
DICTIONARY = ("the and tion ing ment able com org net www http html index user home path file data test example sample name "
              "mail page list image config default main node value string number table version release build static public "
              "assets src lib bin usr var tmp doc pdf png jpg json xml que los las con por para ent ion der die das und "
              "ver ung lich keit heit aux eau elle ere en er es re or an on in at ti ha he nd st nt ea ed ou th sh ble ly "
              "xxxx abcd 1234 0000").split()

# Words for passphrases of the seed, and what stands for a credential in descriptions and templates.
WORDS = ("horse battery staple river window garden copper planet silver basket candle yellow forest bridge kitten marble orange "
         "pepper rocket saddle tunnel violet walnut winter").split()
PLACEHOLDERS = ("password changeme required optional username secret string undefined missing invalid expired default example "
                "refresh authentication mandatory protected encrypted <password> ${PASSWORD} your_password your-secret-here xxxxxxxx ******** "
                "process.env.SECRET os.environ getenv(").split()


def pieces(words: Column) -> Column:
    """Structs of position, token and neighbours for the tokens of ``words`` that may hold a core."""
    def at(i: Column) -> Column:
        return F.coalesce(F.get(words, i), F.lit(""))

    def named(i: Column) -> Column:
        """Whether the words before ``i`` end in a name that announces a value, and the sign."""
        last = at(i - 1)
        sign = last.endswith("=") | last.endswith(":")
        return sign & F.concat(F.when(F.length(last) < 4, at(i - 2)).otherwise(F.lit("")), last).rlike(NAME_ENDS + "$")

    def piece(t: Column, i: Column) -> Column:
        header = t.endswith(KEY_START) & F.concat_ws(" ", at(i + 1), at(i + 2), at(i + 3)).contains(KEY_BLOCK)
        inside = (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & (t.rlike(NAME_ENDS + VALUE) | t.rlike(URL_USER))
        by_place = (F.char_length(t) >= 6) & (named(i) | inside)
        return F.when(header | ((F.char_length(t) >= 16) & t.rlike("[0-9]")) | by_place, F.struct(
            i.alias("place"), t.alias("token"), header.alias("header"), ((F.char_length(t) >= 6) & named(i)).alias("named"),
            F.array(at(i - 3), at(i - 2), at(i - 1)).alias("earlier"), at(i + 1).alias("after")))

    return F.filter(F.transform(words, piece), lambda p: p.isNotNull())


def cores(fields: Column) -> Column:
    """Structs of core, its field (``part``) and neighbours for every core of a token's
    ``fields``.  A field after the first that brings its own name has no words
    before it; another one has the fields and words before it."""
    earlier, after = F.col("p.earlier"), F.col("p.after")
    # A provider's credential inside a path is a core beside the path.
    inner = "(?<=[/.~+])" + PREFIXED.removeprefix("^")

    def of_field(f: Column, j: Column) -> Column:
        before = (F.when(j == 0, F.concat_ws(" ", earlier)).when(f.rlike(NAMED), F.lit(""))
                  .otherwise(F.concat_ws(" ", F.slice(F.concat(earlier, F.slice(fields, 1, j)), -3, 3))))
        found = F.concat(F.regexp_extract_all(f, F.lit(CORE), F.lit(0)), F.regexp_extract_all(f, F.lit(inner), F.lit(0)))
        found = F.filter(found, lambda c: (F.char_length(c) >= 16) & c.rlike("[0-9]"))
        return F.transform(found, lambda c: F.struct(c.alias("core"), f.alias("part"), before.alias("before"),
                                                     F.when(j == F.size(fields) - 1, after).otherwise("").alias("after")))

    header = F.struct(F.lit(KEY_HEADER).alias("core"), F.col("p.token").alias("part"),
                      F.concat_ws(" ", earlier).alias("before"), after.alias("after"))
    found = F.concat(F.flatten(F.transform(fields, of_field)), F.filter(F.array(header), lambda _: F.col("p.header")))
    # Values by their place, each once and only where no core is that value.
    token, near = F.col("p.token"), F.concat_ws(" ", earlier)
    values = F.concat(F.regexp_extract_all(token, F.lit(NAME_ENDS + VALUE), F.lit(2)), F.regexp_extract_all(token, F.lit(URL_USER), F.lit(1)),
                      F.when(F.col("p.named"), F.slice(F.regexp_extract_all(token, F.lit("^" + VALUE), F.lit(1)), 1, 1))
                      .otherwise(F.array().cast("array<string>")))
    values = F.filter(F.array_distinct(F.transform(values, lambda v: F.regexp_replace(v, r"[.!?)}\]>]+$", ""))), lambda v: F.char_length(v) >= 6)
    return bind(found, lambda f: F.concat(f, F.transform(
        F.filter(values, lambda v: ~F.exists(f, lambda c: c["core"] == v)),
        lambda v: F.struct(v.alias("core"), token.alias("part"), near.alias("before"), after.alias("after")))))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, place, core, token, part, before, after``: every core and every
    value by its place of every token, as often as it stands there, with its field (``part``) and
    neighbouring words, from the whole text."""
    words = F.split(text_or_empty(), r"[\x20\x09-\x0D]+")
    tokens = docs.select("doc_id", F.explode(bind(words, pieces)).alias("p"))
    fields = F.filter(F.split("p.token", FIELD), lambda f: f != "")
    return (tokens.select("doc_id", "p", F.explode(bind(fields, cores)).alias("c"))
            .select("doc_id", "p.place", "c.core", "p.token", "c.part", "c.before", "c.after"))


def features(found: DataFrame) -> DataFrame:
    """``found`` with the vector column ``features``; surroundings are the core's
    field (``part``, in given findings ``token``) and neighbours."""
    core, low, part = F.col("core"), F.lower("core"), F.col("part" if "part" in found.columns else "token")
    n = F.char_length(core).cast("double")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    kinds = [F.char_length(F.regexp_replace(core, pattern, "")) / n for pattern in ("[^0-9]", "[^A-Z]", "[^a-z]", "[^/.]", "[A-Za-z0-9]")]
    longest = F.array_max(F.transform(F.regexp_extract_all(core, F.lit("([A-Za-z]+)"), F.lit(1)), lambda x: F.char_length(x)))
    columns = {
        "length": F.ln(n), "transitions": F.char_length(runs) / n,
        "digits": kinds[0], "upper": kinds[1], "lower": kinds[2], "path": kinds[3], "marks": kinds[4],
        "spread": F.size(F.array_distinct(F.split(core, ""))) / n,
        "coverage": 1 - F.char_length(F.regexp_replace(low, "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")) / n,
        "letters_run": F.coalesce(longest, F.lit(0)) / n,
        "hex": core.rlike("^[0-9a-fA-F]+$").cast("double"),
        "prefixed": (core.rlike(PREFIXED) | core.contains(KEY_BLOCK)).cast("double"),
        "announced": F.concat_ws(" ", "before", part).rlike(ANNOUNCE).cast("double"),
        "assigned": (F.col("before").rlike("[=:]$") | part.rlike(NAMED)).cast("double"),
        "quoted": part.rlike("[\"'`]").cast("double"),
        "harmless": F.concat_ws(" ", "before", part, "after").rlike(HARMLESS).cast("double"),
        "in_path": part.rlike("(://|^/|[a-z]/[a-z]|@)").cast("double"),
        "user_part": (F.regexp_extract(part, URL_USER, 1) == core).cast("double"),
        "value": F.endswith(F.regexp_extract(F.concat_ws(" ", "before", part), NAME_ENDS + "\\s*" + VALUE, 2), core).cast("double"),
        "classes": sum(core.rlike(x).cast("double") for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")),
        "letters": (F.lower(core).rlike("^[a-z]+$")).cast("double"),
        "uuid": core.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}").cast("double"),
    }
    wide = found.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{name}") for name, c in columns.items()])
    names = [f"f_{name}" for name in columns]
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def seed_findings(spark: SparkSession, each: int = 60) -> DataFrame:
    """Labelled findings of known shapes, ``each`` of every kind: ``core, token, before, after, label``."""
    h = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256)
    base = F.base64(F.unhex(h))
    uuid = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    kinds = [  # core, token text before and after it, words before, word after, label
        (F.concat(F.lit("AKIA"), F.upper(h.substr(1, 16))), "", "", "with this", "", 1),
        (F.concat(F.lit("ghp_"), h.substr(1, 36)), "", "", "set to", "", 1),
        (h.substr(1, 40), '"', '"', "a token =", "", 1),
        (h.substr(1, 32), "'", "'", "my api_key =", "", 1),
        (F.substring(base, 1, 40), '"', '"', "the secret :", "", 1),
        (h.substr(1, 40), "password=", "", "use the", "", 1),
        (h.substr(1, 40), "", "", "in commit", "", 0),
        (h, "sha256:", "", "image checksum", "", 0),
        (h.substr(1, 32), "", "", "the md5 digest", "matches", 0),
        (uuid, "", "", "request uuid", "", 0),
        (F.concat(F.lit("www.example.com/path/index"), h.substr(1, 3), F.lit(".html")), "https://", "", "see the page", "", 0),
        (F.concat(F.lit("mail"), h.substr(1, 1), F.lit("2.example.com")), "user.", "", "write to", "", 0),
        (F.concat(F.lit("/usr/lib/data/version-"), h.substr(1, 2), F.lit("1.json")), "", "", "in the file", "", 0),
        (F.substring(F.translate(h, "abcdef", "123456"), 1, 16), "", "", "card", "", 0),
        (F.substring(F.translate(h, "abcdef", "123456"), 1, 20), "", "", "of the", "and", 0),
        (F.concat(F.lit("internationalization"), h.substr(1, 1), F.lit("2")), "", "", "of the", "and", 0),
        (F.concat(F.lit("2024-01-01T00.00."), F.conv(h.substr(1, 6), 16, 10)), "", "", "dated", "", 0),
    ]
    # Short values and passphrases by their place, and what stands there in descriptions and templates.
    strong = F.concat(F.substring(base, 3, 4), F.lit("!"), F.substring(base, 9, 3), F.substring(h, 60, 2), F.lit("#"))
    mixed = F.concat(F.upper(F.substring(h, 3, 1)), F.substring(F.translate(h, "0123456789", "ghjkmnpqrs"), 5, 4), F.substring(F.translate(h, "abcdef", "234567"), 11, 2),
                     F.substring(F.translate(h, "0123456789", "ghjkmnpqrs"), 20, 3), F.lit("&"), F.substring(F.translate(h, "abcdef", "234567"), 31, 1))

    def drawn(words: list[str], k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), F.conv(h.substr(k, 6), 16, 10).cast("int") % len(words) + 1)

    phrase = F.concat(*[drawn(WORDS, k) for k in (1, 6, 11, 16)])
    short = F.concat(F.substring(base, 5, 4), F.substring(F.translate(h, "abcdef", "234567"), 7, 2), F.upper(F.substring(F.translate(h, "0123456789", "ghjkmnpqrs"), 3, 2)))
    leet = F.concat(F.translate(drawn(WORDS, 2), "aeio", "4310"), F.initcap(F.substring(F.translate(drawn(WORDS, 9), "aeio", "4310"), 1, 4)))
    marked = F.concat(F.substring(F.translate(h, "0123456789", "ghjkmnpqrs"), 9, 2), F.upper(F.substring(h, 15, 1)), F.lit("7$"), F.substring(base, 7, 2), F.lit("!"), F.substring(h, 40, 2))
    letters = F.substring(F.translate(h, "0123456789", "ghjkmnpqrs"), 1, 32)
    word = drawn(WORDS + PLACEHOLDERS, 1)
    values = [(strong, 1), (mixed, 1), (phrase, 1), (letters, 1), (short, 1), (leet, 1), (marked, 1), (word, 0), (drawn(PLACEHOLDERS, 4), 0)]
    for name, sign in (("password", "="), ("db_password", ":"), ("SECRET", "="), ("auth_token", ":")):
        for value, label in values:
            kinds += [(value, name + sign, "", "", "", label), (value, "", "", f"{name}{sign}", "", label), (value, "", "", f"the {name} {sign}", "", label)]
    for value, label in values:
        kinds.append((value, "postgres://admin:", "@db.internal/main", "connect to", "", label))
        kinds.append((value, '{"user":"x","password":"', '","n":1}', "", "", label))
    # The strings of every kind, then each kind's surroundings.
    strings = list({str(core): core for core, *_ in kinds}.items())
    place = {name: i for i, (name, _) in enumerate(strings)}
    around = json.dumps([[place[str(core)], *rest] for core, *rest in kinds])
    drawn_rows = spark.range(0, each, 1, 1).select(F.posexplode(F.array(*[core for _, core in strings])).alias("kind", "core"))
    shown = spark.range(1).select(F.explode(F.from_json(F.lit(around), "array<array<string>>")).alias("a")).select(
        F.col("a")[0].cast("int").alias("kind"), *[F.col("a")[i + 1].alias(c) for i, c in enumerate(("left", "right", "before", "after", "label"))])
    return drawn_rows.join(shown, "kind").select("core", F.concat("left", "core", "right").alias("token"), "before", "after",
                                                 F.col("label").cast("double").alias("label"))


def label_findings(found: DataFrame, background: int) -> DataFrame:
    """All of the corpus's candidates whose shape and surroundings settle the label,
    with the same strings in harmless surroundings as counter-examples.

    ``weight`` is the one power of two (so that sums are exact in any order) at which
    they weigh together as about ``background`` findings would, or 1 if there are
    fewer; ``deal`` is what :func:`train` deals them by."""
    core, part, near = F.col("core"), F.col("part"), F.concat_ws(" ", "before", "part")
    hard = core.rlike("^[0-9a-fA-F]{32,64}$|^[A-Za-z0-9+/=_-]{32,}$")
    # What stands in a credential's place is settled by the seed alone.
    by_place = (F.regexp_extract(part, URL_USER, 1) == core) | F.endswith(F.regexp_extract(near, NAME_ENDS + "\\s*" + VALUE, 2), core)
    label = (F.when(core.rlike(PREFIXED) | core.contains(KEY_BLOCK), 1.0)
             .when(hard & near.rlike(ANNOUNCE) & ~near.rlike(HARMLESS), 1.0)
             .when(by_place, F.lit(None).cast("double"))
             .when(core.rlike("^[0-9.-]+$"), 0.0)
             .when(part.rlike("(://|@)") | (near.rlike(HARMLESS) & hard), 0.0)
             .when(~core.rlike("[0-9].*[0-9].*[0-9]"), 0.0))
    settled = found.withColumn("label", label).where("label IS NOT NULL")
    n = settled.count()
    weight = 2.0 ** -max(0, round(math.log2(max(1, n) / background)))
    settled = settled.select("core", part.alias("token"), "before", "after", "label", F.lit(weight).alias("weight"),
                             F.xxhash64("doc_id", "place", "core").alias("deal"))
    moved = (settled.where((F.col("label") == 1) & core.rlike("^[0-9a-fA-F]{32,64}$"))
             .select("core", F.col("core").alias("token"), F.lit("of commit").alias("before"), F.lit("").alias("after"), F.lit(0.0).alias("label"),
                     "weight", "deal"))
    return settled.unionByName(moved)


def train(findings: DataFrame, trees: int = 30, depth: int = 6, seed: int = 17, part_rows: int = 50_000) -> RandomForestClassificationModel:
    """The forest over all labelled findings (``core, token, before, after, label`` and,
    if there, ``weight, deal``).  They are dealt by a hash into partitions of about
    ``part_rows`` and sorted there, so the same findings give the same forest."""
    columns = ["core", "token", "before", "after", "label"]
    if "weight" not in findings.columns:
        findings = findings.withColumn("weight", F.lit(1.0))
    if "deal" not in findings.columns:
        findings = findings.withColumn("deal", F.xxhash64(*columns))
    parts = max(1, math.ceil(findings.count() / part_rows))
    rows = features(findings.repartition(parts, "deal").sortWithinPartitions(*columns, "weight")).select("features", "label", "weight")
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(docs: DataFrame, background: int = 10_000, threshold: float = 0.5, findings: DataFrame | None = None) -> DataFrame:
    """``doc_id, place, core, token, probability, is_secret``: every candidate with the
    forest's verdict; ``place`` is the token's index in its text (a token with
    several cores has several rows).

    Learns from ``findings`` if given, else from the seed and all of the corpus's
    settled candidates, which weigh together as ``background`` of the seed's would.
    Null or empty texts have no candidates; repeated rows repeat; no rows give none."""
    found = stored(candidates(docs), "secret-candidates")
    if findings is None:
        seed = seed_findings(docs.sparkSession).withColumn("weight", F.lit(1.0)).withColumn("deal", F.xxhash64("core", "token"))
        findings = stored(seed.unionByName(label_findings(found, background)), "secret-findings")
    model = train(findings)
    scored = model.transform(features(found)).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "place", "core", "token", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, background: int = 10_000, threshold: float = 0.5, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every confirmed secret overwritten by ``mask`` in ``text``
    (``n_chars`` follows where the column exists); rows without one are unchanged.
    Secrets are matched to rows by the whole text's hash, so repeated or null
    ids do no harm."""
    digest = F.xxhash64(text_or_empty())
    found = scan(docs.select(digest.alias("doc_id"), "text"), background, threshold).where("is_secret")
    own, key, cores = (free_name(docs, name) for name in ("_own", "_key", "_cores"))
    lists = stored(found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("core").alias(cores)), "secret-lists")
    out = docs.withColumn(own, digest)
    out = out.join(small_side(lists), F.col(own) == F.col(key), "left")
    some = F.col(cores).isNotNull()
    longest = F.array_sort(F.col(cores), lambda a, b: F.char_length(b) - F.char_length(a))
    block = F.regexp_replace(F.col("text"), r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(-----END [A-Z ]*PRIVATE KEY-----|$)", mask)
    clean = F.aggregate(longest, F.when(F.array_contains(cores, KEY_HEADER), block).otherwise(F.col("text")),
                        lambda t, c: F.replace(t, c, F.lit(mask)))
    out = out.withColumn("text", F.when(some, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(some, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
