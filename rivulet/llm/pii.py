"""Personal data, found by column expressions only.

Fixed formats are always reported. In what they leave of a text, generators of high recall propose overlapping stretches, one generator for each
format that numbers are written in and one for any run of digits; boosted
trees judge each by its format and the words around it, and a threshold per generator, calibrated on held-out
rows, selects them. Of those that overlap the one farthest above its threshold is reported. The trees are trained on a generated labelled sample of ``SAMPLE`` sentences and become
nested conditions, so that a document is judged inside its own row, without a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of the labelled sample, trees, depth, and the precision that held-out rows must reach.
SAMPLE, TREES, DEPTH, PRECISION = 6000, 12, 4, 0.95
# Characters in front of a candidate that count as its context.
CONTEXT = 30
# The formats that are always reported, in their order. Loops never give back, and a start inside
# a longer run is skipped, which finds the same matches in one pass over any text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "mail_like": r"[^\s@<>()\[\]\"',;|]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[^\s@<>()\[\]\"',;|]{1,64}+(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,12}+)?",
    "phone_like": r"(?<![0-9])[(]?[0-9]{3}[)]?[ .-]{0,2}[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "grouped": r"(?<![0-9])[0-9]{3,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "ssn_like": r"(?<![0-9])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9])",
    "card_like": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,7}(?![0-9])",
    "digit_run": r"(?<![0-9])[(]?[0-9](?:[ ().-]{0,2}[0-9]){8,18}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hardware": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
}
WORDS = {
    "contact": r"(?i)\b(?:call|tel|telephone|phone|mobile|cell|fax|whatsapp|text|dial|e-?mail|mail|contact|write|reach)\b",
    "identity": r"(?i)\b(?:card|visa|mastercard|iban|account|ssn|social|passport|licen[cs]e|identity|tax|bank|pay|born)\b",
    "neutral": r"(?i)\b(?:order|invoice|ref|reference|isbn|issn|version|release|page|item|ticket|price|total|sku|part|serial|build|tracking|batch|id|code|pi)\b",
}
FEATURES = ["generator", "length", "digits", "letters", "marks", "opens", "luhn", "octets", "glued_before", "glued_after",
            "contact", "identity", "neutral", "groups", "dots", "at"]
# Labelled sentence patterns; # is a digit, @ with letters as they stand, | parts two values. The last value is the label, L: a valid checksum.
# A proposal is right when it is one of the values, whole.
PATTERNS = [
    ("call me on ", "(###) ###-####", "1"), ("my mobile: ", "###-###-####", "1"), ("tel. ", "### ### ####", "1"), ("phone ", "#### ### ###", "1"),
    ("see you, ", "(###) ###-####", "1"), ("or ", "###-###-####", "1"), ("fax ", "##########", "1"), ("dial ", "0## #### ####", "1"),
    ("my visa is ", "#### #### #### ####", "1"), ("pay by card ", "################", "1"), ("the card ", "####-####-####-####", "1"),
    ("text then ", "################", "L"), ("on which ", "#### #### #### ####", "L"), ("and so ", "###############", "L"),
    ("ssn ", "###-##-####", "1"), ("social security ", "###-##-####", "1"), ("her number ", "###-##-####", "1"), ("tax ", "### ## ####", "1"),
    ("write to ", "ann.lee (at) mail##.example.org", "1"), ("mail ", "joe[at]site#.example (dot) com", "1"), ("contact: ", "bob@mail##", "1"),
    ("iban ", "DE## #### #### #### #### ##", "1"), ("bank account ", "GB##WEST##############", "1"), ("paid from ", "FR## #### #### #### #### #### ###", "1"),
    ("device ", "0#:1#:a#:##:b#:##", "1"), ("adapter ", "##:##:##:##:##:##", "1"),
    ("numbers ", "###-###-####|###-###-####", "1"), ("call ", "(###) ###-####|(###) ###-####", "1"), ("card and phone ", "#### #### #### ####|(###) ###-####", "1"),
    ("tel ", "### ### ####|#### ### ###", "1"), ("ssn and phone ", "###-##-####|###-###-####", "1"), ("mobile ", "###.###.####", "1"), ("from ", "### ###-####", "1"),
    ("order ", "##########", "0"), ("invoice no. ", "############", "0"), ("isbn ", "978-#-##-######-#", "0"), ("isbn ", "978##########", "0"),
    ("version ", "#.#.##.####.####", "0"), ("build ", "####.##.##.####", "0"), ("tracking ", "################", "0"), ("ticket ", "### ### ###", "0"),
    ("serial ", "###-##-####", "0"), ("part ", "###-###-####", "0"), ("pi is ", "3.#########", "0"), ("total ", "###.###.###", "0"),
    ("on ", "20##-##-##-####", "0"), ("from ", "19## 20## 19##", "0"), ("thus ", "############", "0"), ("the ", "0.############", "0"),
    ("follow ", "news @channel#", "0"), ("price ", "#@##", "0"), ("code ", "AB## #### #### ####", "0"), ("sku ", "XY##ABCD##########", "0"),
]


def located(text: Column, pattern: str) -> Column:
    """start, end (code points) and text of all matches, leftmost and without overlaps."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.lit(None).cast("array<struct<start:int,end:int,v:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["pos"] + F.length(pair["b"])
        end = start + F.length(pair["f"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["f"].alias("v")))).alias("out"))

    pairs = F.arrays_zip(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))).alias("b"), found.alias("f"))
    begin = F.struct(F.lit(0).alias("pos"), F.coalesce(none, F.array().cast("array<struct<start:int,end:int,v:string>>")).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<start:int,end:int,v:string>>"))


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """The conditions a match must meet besides its format."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda s: valid(kind, s["v"])


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def with_base(docs: DataFrame, text: Column) -> DataFrame:
    """Add ``_text`` and, per fixed format, the array ``_<kind>`` of its valid spans."""
    none = F.array().cast("array<struct<start:int,end:int,v:string>>")
    gate = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+"))}
    out = docs.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_digits", F.col("_text").rlike("[0-9]"))
    for kind, pattern in BASE.items():
        out = out.withColumn(f"_{kind}", F.when(gate.get(kind, F.lit(True)) & (F.col("_digits") | F.lit(kind == "email")), located(F.col("_text"), pattern)).otherwise(none))
        if kind != "email":
            out = out.withColumn(f"_{kind}", F.filter(f"_{kind}", _valid_span(kind)))
    return out


def features(text: Column, number: int, span: Column) -> Column:
    """Format and context of one candidate."""
    v, number_of = span["v"], digits(span["v"])
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(F.lit(CONTEXT), span["start"]))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    four = F.regexp_count(v, F.lit("[0-9]+")) == 4
    values = [
        F.lit(number), F.length(v), F.length(number_of), F.length(F.regexp_replace(v, r"[^\p{L}]", "")),
        F.length(F.regexp_replace(v, r"[^ ().:-]", "")), flag(v.rlike(r"^[+(]")),
        flag(F.length(number_of).between(13, 19) & luhn(number_of)), flag(four & F.contains(v, F.lit("."))),
        flag(before.rlike(r"[\p{L}\p{N}.,$€£]$")), flag(after.rlike(r"[\p{L}\p{N}]")),
        *[flag(before.rlike(w)) for w in WORDS.values()],
        F.regexp_count(v, F.lit("[0-9]+")), F.regexp_count(v, F.lit(r"\.")), flag(v.rlike(r"@|\(at\)|\[at\]")),
    ]
    return F.struct(*[x.cast("double").alias(n) for n, x in zip(FEATURES, values)])


def candidates(text: Column, context: Column | None = None) -> Column:
    """All candidates of all generators, with their features; the words around them are those of ``context``, a text with the same places."""
    parts = []
    for number, (name, pattern) in enumerate(GENERATORS.items()):
        parts.append(F.transform(located(text, pattern), _described(text if context is None else context, number, name)))
    return F.concat(*parts)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _described(text: Column, number: int, name: str):
    return lambda s: F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), features(text, number, s).alias("x"))


def labelled(spark: SparkSession, rows: int = SAMPLE, patterns: list[tuple[str, str, str]] = PATTERNS) -> DataFrame:
    """The labelled sample: candidates of generated sentences. It is the same at every call."""
    pattern = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(y).alias("y")) for a, b, y in patterns])
    filler = F.array(*[F.lit(w) for w in ("we met at noon", "the report of", "nothing more", "see below", "it was late", "in the end")])
    picked = spark.range(rows).withColumn("p", F.get(pattern, F.pmod("id", F.lit(len(patterns))).cast("int")))
    value = F.array_join(F.transform(F.split("p.b", ""), lambda c, i: F.when(
        c == "#", F.pmod(F.xxhash64("id", i), F.lit(10)).cast("string")).otherwise(c)), "")
    made = picked.withColumn("v", value).withColumn("front", F.concat(F.get(filler, F.pmod(F.xxhash64("id"), F.lit(6)).cast("int")), F.lit(". "), "p.a"))
    made = made.withColumn("text", F.concat("front", F.replace("v", F.lit("|"), F.lit(" ")), F.lit(" "), F.get(filler, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(6)).cast("int"))))
    # The values end at the bars and at the end, and begin behind the one before.
    parts = F.split("v", r"\|")
    begin = F.struct(F.length("front").alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    true = F.aggregate(parts, begin, lambda acc, x: F.struct((acc["pos"] + F.length(x) + 1).alias("pos"), F.concat(
        acc["out"], F.array(F.struct(acc["pos"].alias("start"), (acc["pos"] + F.length(x)).alias("end")))).alias("out")), lambda acc: acc["out"])
    right = F.when(F.col("p.y") == "L", luhn(digits(F.col("v")))).otherwise(F.col("p.y") == "1")
    found = made.withColumns({"true": true, "right": right}).select("id", "true", "right", F.explode(candidates(F.col("text"))).alias("c"))
    whole = F.exists("true", lambda t: (t["start"] == F.col("c.start")) & (t["end"] == F.col("c.end")))
    return found.select("id", (F.col("right") & whole).cast("double").alias("label"), "c.kind", "c.start", "c.end", "c.x.*")


def _conditions(tree: str, x: Column) -> Column:
    """One tree out of its description as nested conditions over a feature struct."""
    lines = [line for line in tree.splitlines()[1:] if line.strip()]

    def read(at: int) -> tuple[Column, int]:
        line = lines[at].strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1])), at + 1
        feature, bound = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line).groups()
        low, at = read(at + 1)
        high, at = read(at + 1)  # past "Else"
        return F.when(x[FEATURES[int(feature)]] <= float(bound), low).otherwise(high), at

    return read(0)[0]


class Model:
    """Trees and the threshold of each generator."""

    def __init__(self, trees: list[str], weights: list[float], bars: dict[str, float]):
        self.trees, self.weights, self.bars = trees, weights, bars

    def margin(self, x: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(w) * _conditions(t, x) for t, w in zip(self.trees, self.weights)])

    def above(self, candidate: Column) -> Column:
        """By how much a candidate passes the threshold of its generator; negative if it does not."""
        m = self.margin(candidate["x"])
        return m - reduce(lambda rest, kind: F.when(candidate["kind"] == kind, self.bars[kind]).otherwise(rest), self.bars, F.lit(float("inf")))

    def accepts(self, candidate: Column) -> Column:
        return self.above(candidate) >= 0


def train(spark: SparkSession, rows: int = SAMPLE) -> Model:
    """Boosted trees on four fifths of the sample, thresholds on the rest: the lowest that keeps the precision."""
    sample = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled(spark, rows).coalesce(1))
    held = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5).fit(sample.where(~held).select("label", "features"))
    model = Model([t.toDebugString for t in fitted.trees], list(fitted.treeWeights), {})
    scored = sample.where(held).select("kind", "label", model.margin(F.struct(*FEATURES)).alias("m"))
    ranked = scored.collect()  # a fifth of the sample
    for kind in GENERATORS:
        own = sorted(((r.m, r.label) for r in ranked if r.kind == kind), reverse=True)
        bar, good = float("inf"), 0.0
        for i, (m, label) in enumerate(own, 1):
            good += label
            if good / i >= PRECISION and (i == len(own) or own[i][0] < m):
                bar = m
        model.bars[kind] = bar
    return model


def blanked(text: Column, spans: Column) -> Column:
    """The text with line breaks in place of the spans, so that all other places stay."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        start, end = F.greatest(s["start"], acc["pos"]), F.greatest(s["end"], acc["pos"])
        piece = F.concat(F.substring(text, acc["pos"] + 1, start - acc["pos"]), F.repeat(F.lit("\n"), end - start))
        return F.struct(end.alias("pos"), F.concat(acc["out"], piece).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))).otherwise(text)


def chosen(judged: Column) -> Column:
    """Of candidates ``above, kind, start, end`` those that no better one overlaps, best first; equal ones go by start and length."""
    order = F.array_sort(judged, lambda x, y: (
        F.when(x["above"] != y["above"], F.when(x["above"] > y["above"], -1).otherwise(1))
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .when(x["end"] > y["end"], -1).when(x["end"] < y["end"], 1).otherwise(0)))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def step(acc: Column, c: Column) -> Column:
        free = ~F.exists(acc, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.when(free, F.concat(acc, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))).otherwise(acc)

    return F.aggregate(order, none, step)


def scan(docs: DataFrame, model: Model | None, text: str = "text", into: str = "pii") -> DataFrame:
    """Add ``into``: kind, start, end (code points, end exclusive) of all spans, by kind in the order of the formats and
    generators, then start.

    Stretches are proposed in what the fixed spans leave of the text: those stay as they are. A null or empty text has no
    spans; other columns pass through, one named ``into`` is replaced.
    """
    others = [c for c in docs.columns if c != into]
    out = with_base(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")), F.col("_doc")[text])
    named = [F.transform(f"_{k}", _named(k)) for k in BASE]
    out = out.withColumn("_base", F.concat(*named))
    if model is None:
        out = out.withColumn("_found", F.col("_base"))
    else:
        none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
        out = out.withColumn("_rest", F.when(F.col("_digits") | F.col("_text").rlike(r"@|\((?:at)\)|\[at\]"), blanked(F.col("_text"), F.col("_base"))))
        out = out.withColumn("_c", F.when(F.col("_rest").isNotNull(), candidates(F.col("_rest"), F.col("_text"))))
        judged = F.transform("_c", lambda c: F.struct(model.above(c).alias("above"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        out = out.withColumn("_j", F.filter(judged, lambda c: c["above"] >= 0))
        # In the order of the generators, then by start.
        best = F.when(F.size("_j") > 0, chosen(F.col("_j")))
        out = out.withColumn("_m", best).withColumn("_found", F.concat("_base", *[
            F.array_sort(F.filter(F.coalesce("_m", none), _of_kind(k))) for k in GENERATORS]))
    return out.select(*[F.col("_doc")[c].alias(c) for c in others], F.col("_found").alias(into))


def redact(docs: DataFrame, spans: str = "pii", text: str = "text") -> DataFrame:
    """Replace every span of the text by its kind in brackets; spans that overlap become one mark."""
    source = F.col(text)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["pos"]
        piece = F.concat(F.substring(source, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(apart, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    full = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(source, acc["pos"] + 1, F.length(source))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, full).otherwise(source))


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``documents``: counts by fixed format, their digest, and all spans."""
    found = scan(docs.select("doc_id", "text"), train(docs.sparkSession)).drop("text")
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", name), ",").alias("spans"))
