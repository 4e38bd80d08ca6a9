"""Personal data in texts: fixed base patterns, and further spans by boosted trees.

One pass over the texts finds the base spans and proposes, by generous patterns, further
spans that may overlap them and each other. Every proposal has features of its format, in
which marks that set a base span apart (``@``, ``+``, the kind of separator) do not show,
and of the text around it. Gradient-boosted trees learn from a bounded sample which
proposals look like the confirmed ones, the same number of each generator and label where
there are enough; a threshold per generator, calibrated on all proposals of the documents
held out, selects the redactions. Base spans always stay.

Everything on the data is built-in column functions; the trees are Spark's own.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.staging import Staging

LOCAL = "A-Za-z0-9._%+-"
# Base patterns. Possessive quantifiers and the start conditions only save work: none of
# the repeated classes holds the character that must follow it.
BASE = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
GENERATORS = {
    "contact": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)*+",
    "number": r"\+?[0-9](?:[\x20.()-]{0,2}[0-9]){6,}+",
    "secret": r"(?:\G|(?<![A-Za-z0-9_-]))(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+",
}
KINDS = [*BASE, *GENERATORS]
FEATURES = [
    "generator", "size", "digits", "letters", "upper", "marks", "groups", "dots", "tail", "luhn",
    "quoted", "assigned", "named", "spaced", "letter_after", "mark_after",
]
#: words that tell what stands behind them
TELLING = {
    "contact": r"(?i)\b(e-?mail|mail|contact|write to|courriel|correo)\W{0,6}$",
    "number": r"(?i)\b(tel|phone|telephone|call|fax|mobile|cell|card|iban|ssn)\W{0,6}$",
    "secret": r"(?i)(token|secret|key|password|passwd)\W{0,6}$",
}
ADDRESS = r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"
NATIONAL = (
    r"^(?:[0-9]{2,5}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}"
    r"|0[0-9]{1,4}[)\x20.-]{1,2}(?:[0-9]{2,4}[\x20.-]){1,3}[0-9]{2,4})$"
)
#: proposals that the trees see at most; thresholds cover all held-out ones
MOST_PROPOSALS = 20_000
PRECISION = 0.9
CHUNK = 128


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _running(values: Column) -> Column:
    """Sums of all elements before each one."""
    return F.aggregate(
        values,
        F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")),
        lambda acc: acc["a"],
    )


def _offsets(sizes: Column) -> Column:
    """:func:`_running` in chunks, so that the cost stays near linear."""
    chunks = F.when(
        F.size(sizes) > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")),
            lambda i: F.slice(sizes, i * CHUNK + 1, CHUNK),
        ),
    ).otherwise(F.array().cast("array<array<int>>"))
    starts = _running(F.transform(chunks, _sum))
    return F.flatten(F.zip_with(chunks, starts, lambda c, s: F.transform(_running(c), lambda x: x + s)))


def _find(df: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """``df`` with an array ``name`` of all matches in ``text``: ``start``, ``end`` (code
    points), ``m`` and the text ``before`` (up to 24 characters) and ``after`` (one)."""
    text = F.col("text")
    asked = text.contains(needs) if needs else text.rlike("@|[(\\[]at[)\\]]" if name == "contact" else "[0-9]")
    df = df.withColumn(f"_{name}", F.when(asked, F.split(text, F.lit(pattern), -1)))
    df = df.withColumn(f"_{name}_m", F.when(F.size(f"_{name}") > 1, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    parts, found = F.col(f"_{name}"), F.col(f"_{name}_m")
    sizes = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
    df = df.withColumn(f"_{name}_at", _offsets(sizes))
    at = F.col(f"_{name}_at")
    spans = F.transform(
        found,
        lambda m, i: F.struct(
            (F.get(at, i) + F.length(F.get(parts, i))).alias("start"),
            (F.get(at, i) + F.length(F.get(parts, i)) + F.length(m)).alias("end"),
            m.alias("m"),
            F.substring(F.get(parts, i), -24, 24).alias("before"),
            F.substring(F.get(parts, i + 1), 1, 1).alias("after"),
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    return df.withColumn(name, F.coalesce(spans, empty)).drop(f"_{name}", f"_{name}_m", f"_{name}_at")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 1, 2).otherwise(1),
    )
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).cast("int") <= 255))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _plain(kind: str, m: Column) -> Column:
    """The proposal without disguise: an address as it is commonly written, a number with
    one kind of separator and without a plus."""
    if kind == "contact":
        bare = F.regexp_replace(F.regexp_replace(m, r"[(\[]at[)\]]", "@"), r"[(\[]dot[)\]]", ".")
        return F.regexp_replace(bare, "\\x20", "")
    if kind == "number":
        return F.regexp_replace(F.regexp_replace(m, r"^\+", ""), r"[\x20.()-]+", "-")
    return m


def _checked(m: Column) -> Column:
    """True for 13 to 19 digits with a check digit, whatever separates them."""
    return _valid("card", m)


def _told(kind: str, x: Column) -> Column:
    """What shows a proposal to be right without a base span: a telling word before it, the
    form of an address under any disguise, of a national phone number or a check digit."""
    named = x["before"].rlike(TELLING[kind])
    if kind == "contact":
        return named | _plain(kind, x["m"]).rlike(ADDRESS)
    if kind == "number":
        alone = ~x["before"].rlike("[A-Za-z0-9_.-]$") & ~x["after"].rlike("[A-Za-z0-9_]")
        return named | (alone & (x["m"].rlike(NATIONAL) | _checked(x["m"])))
    return named


def _features(kind: str, x: Column) -> Column:
    m, before, after = _plain(kind, x["m"]), x["before"], x["after"]

    def without(pattern: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, pattern, ""))

    digits, letters = without("[0-9]"), without("[A-Za-z]")
    values = [
        F.lit(list(GENERATORS).index(kind)), F.length(m), digits, letters, without("[A-Z]"),
        F.length(m) - digits - letters, F.size(F.split(m, "[^0-9]+")), without("[.]"),
        F.length(F.regexp_extract(m, "([A-Za-z]+|[0-9]+)$", 1)), _checked(m) if kind == "number" else F.lit(False),
        before.rlike("[\"']$"), before.rlike(r"[=:]\s*[\"']?$"), before.rlike(TELLING[kind]),
        (before == "") | before.rlike(r"\s$"), after.rlike("[A-Za-z]"), after.rlike(r"[^A-Za-z0-9\s]"),
    ]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def proposals(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id``, ``text_key`` (a hash of the text),
    ``base`` (its valid base spans, in order of kind and place) and ``proposed`` spans with
    ``features`` and the weak labels ``covered``, true if a base span covers the proposal, and
    ``told``, true if its form or the words before it show that it is right."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, needs) in BASE.items():
        rows = _find(rows, kind, pattern, needs)
    for kind, pattern in GENERATORS.items():
        rows = _find(rows, kind, pattern, None)
    spans = [_confirmed(kind) for kind in BASE]
    key = F.xxhash64("text", F.length("text")).alias("text_key")
    rows = rows.select("doc_id", key, *GENERATORS, F.concat(*spans).alias("base"))
    return rows.select("doc_id", "text_key", "base", F.concat(*map(_offered, GENERATORS)).alias("proposed"))


def _confirmed(kind: str) -> Column:
    number = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(
        F.filter(kind, lambda x: _valid(kind, x["m"])),
        lambda x: F.struct(number, x["start"].alias("start"), x["end"].alias("end")),
    )


def _offered(kind: str) -> Column:
    number = F.lit(KINDS.index(kind)).alias("kind")

    def offer(x: Column) -> Column:
        covered = F.exists("base", lambda b: (b["start"] <= x["start"] + 1) & (b["end"] >= x["end"]))
        return F.struct(
            number, x["start"].alias("start"), x["end"].alias("end"),
            _features(kind, x).alias("features"), covered.alias("covered"), _told(kind, x).alias("told"),
        )

    return F.transform(kind, offer)


def _sample(seen: DataFrame) -> DataFrame:
    """At most an equal part of ``MOST_PROPOSALS`` of each generator and label, those of the
    lowest hash; a proposal of copied texts counts once."""
    most = MOST_PROPOSALS // (2 * len(GENERATORS))
    place, cell = F.xxhash64("text_key", "kind", "start"), ["kind", "label"]
    totals = seen.groupBy(*cell).agg(F.approx_count_distinct(place, 0.01).alias("n")).collect()  # six rows
    bound = F.lit(True)
    for r in totals:
        if r["n"] > 2 * most:
            low = int(2 * most / r["n"] * 2**64) - 2**63
            bound = bound & ((F.col("kind") != r["kind"]) | (F.col("label") != r["label"]) | (place < low))
    few_rows = seen.where(bound).dropDuplicates(["text_key", "kind", "start"])
    order = Window.partitionBy(*cell).orderBy(place, "text_key", "start")
    return few_rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth")


def _bound(bins: list) -> float | None:
    """The lowest probability from which on the held-out proposals, and those of them that
    could be added, are right often enough; a row of ``bins`` has both counts."""
    n = right = n_free = right_free = 0.0
    bound = None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        n, right = n + r["n"], right + r["right"]
        n_free, right_free = n_free + r["n_free"], right_free + r["right_free"]
        if right >= PRECISION * n and right_free >= PRECISION * n_free:
            bound = r["bin"] / 20
    return bound


def _fit(rows: DataFrame, staging: Staging) -> tuple | None:
    """The trees and a threshold per generator; None where nothing can be learned."""
    y = (F.col("covered") | F.col("told")).cast("double").alias("label")
    columns = [F.get("features", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)]
    held = F.pmod(F.xxhash64(F.lit("held"), "text_key"), F.lit(5)) == 0
    seen = rows.select("text_key", "kind", "start", y, held.alias("held"), _free().alias("free"), *columns)
    sample = _sample(seen.where("not held"))
    sample = staging.keep(sample.select("kind", "label", *FEATURES), "proposals")
    train = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample)
    if train.select("label").distinct().count() < 2:
        staging.drop(sample)
        return None
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=6, maxDepth=3, seed=7).fit(train)
    judged = _judge(seen.where("held"), model)
    free = F.col("free").cast("int")
    table = judged.groupBy("kind", F.floor(F.col("p") * 20).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("label").alias("right"),
        F.sum(free).alias("n_free"), F.sum(free * F.col("label")).alias("right_free"),
    ).collect()  # at most 21 bins for each generator
    staging.drop(sample)
    bounds = {kind: _bound([r for r in table if r["kind"] == kind]) for kind in {r["kind"] for r in table}}
    return model, {kind: bound for kind, bound in bounds.items() if bound is not None}


def _free() -> Column:
    """True for a proposal that overlaps no base span."""
    return ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))


def _judge(rows: DataFrame, model) -> DataFrame:
    vector = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)
    return model.transform(vector).withColumn("p", vector_to_array("probability")[1])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` for every row of ``docs(doc_id, text)``: arrays of
    ``kind`` (its place in ``KINDS``), ``start`` and ``end`` (code points, end exclusive),
    in order of kind and place; ``spans`` holds the base spans and the added ones.

    Added spans reach their generator's threshold and overlap no base span. A null text
    is empty; repeated rows get the same spans, rows without doc_id are handled alike.
    Other columns are ignored; without proposals of both kinds nothing is added.
    """
    staging = Staging(docs.sparkSession)
    found = staging.keep(proposals(docs), "personal")
    rows = found.select("doc_id", "text_key", "base", F.explode("proposed").alias("x")).select(
        "doc_id", "text_key", "base", "x.*"
    )
    fitted = _fit(rows, staging)
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    if fitted is None or not fitted[1]:
        return found.select("doc_id", "base", F.array_sort("base").alias("spans"))
    model, bounds = fitted
    columns = [F.get("features", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)]
    judged = _judge(rows.where(_free()).select("doc_id", "text_key", "kind", "start", "end", *columns), model)
    enough = F.lit(False)
    for kind, bound in bounds.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("p") >= bound))
    added = judged.where(enough).groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("added")
    )
    same = found["doc_id"].eqNullSafe(added["_doc"]) & (found["text_key"] == added["_key"])
    return found.join(added, same, "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans")
    )


def told(spans: str | Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
