"""Personal data by candidate gradient boosting, in DataFrame functions alone.

High-recall generators propose spans that may overlap: the four base patterns with all their matches,
and looser ones (e-mail addresses with a spelled-out sign, groups of digits, keys followed by a value). Boosted trees
score a candidate by its format and context: digits, groups, separators, letters, length, the words
before. They learn from every base match of the corpus, right ones against those that fail their check
(digit counts, octets, check digit), from the loose candidates whose label follows from the text, and from fixed
examples of forms that a corpus may lack. A loose candidate that meets a right base span is right if that span is
of its kind (the inner digits of a phone number) and wrong if it is of another (those of an address); a key's value is right
if it mixes letters and digits and wrong if it is one word of letters. Other loose candidates have no label and are
only scored. Candidates are counted by their features first, so the fit sees the counts of all documents; a cell is a
combination of small feature values, so their number is bounded whatever the corpus (226,000 for a generator, in
practice some hundred). Thresholds are calibrated for each generator on the quarter of the documents that the fit
leaves out, and on the fixed examples too where that quarter holds no right candidate of the generator. Base spans
always stay; scored candidates that overlap none of them and reach their threshold are added.

Everything happens inside a row, so no text is shuffled. Places of matches come from the lengths of the
pieces between them. Patterns are written without backtracking into what they have matched, and start
only where a run starts or where the last match ended; this finds the same matches in linear time.

Defined cases: a null text is empty and has no spans; a null id stays a row; repeated rows stay rows; an empty
table gives no rows and a fit on the fixed examples alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import documents, quoted, text_of

MARK, OTHER = "\x01", "\x02"
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "spelled": rf"(?:(?<!{LOCAL})|\G){LOCAL}++ ?[\[({{] ?(?:at|AT) ?[\])}}] ?{HOST}++(?: ?(?:\.|[\[({{] ?(?:dot|DOT) ?[\])}}]) ?{HOST}++)++",
    "digits": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?(?:[ .-]{1,2}[0-9]{2,5}){2,4}+(?![0-9A-Za-z]|[.-][0-9])",
    "keyed": r"(?:(?i:passwor[dt]|passwd|pwd|secret|token|api[_-]?key))[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[^\s\"',;]{6,}+",
}
GENERATORS = {**BASE, **LOOSE}
KIND = {"spelled": "email", "digits": "phone", "keyed": "secret"}
KINDS = ("email", "ip", "card", "phone", "secret")
OCTET = "(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"      # zeros, then nothing or 1 to 255
CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|cell|mail|contact|card|visa|ssn|password|token|secret|key|tél|téléphone|telefon|correo)[^a-z0-9]{0,4}$"
BLOCK = 256
FEATURES = ("generator", "digits", "groups", "letters", "separators", "length", "context", "dated", "glued")
ROUNDS, RATE, LEAST, PRECISION = 24, 0.4, 1e-3, 0.9
SEED_WEIGHT = 4.0
# Fixed examples: generator, what stands before, span, whether it is personal.
EXAMPLES = (
    ("spelled", "write to ", "jane.doe [at] mail.example.com", 1), ("spelled", "mail: ", "bob (at) site (dot) org", 1),
    ("spelled", "", "sales(at)shop.example.net", 1), ("spelled", "look ", "x (at) y.z", 0),
    ("digits", "call ", "555-123-4567", 1), ("digits", "phone: ", "(555) 123-4567", 1), ("digits", "tel ", "030 1234 5678", 1),
    ("digits", "fax ", "555.123.4567", 1), ("digits", "Tel: ", "01 23 45 67 89", 1), ("digits", "ssn ", "123-45-6789", 1),
    ("digits", "", "555-867-5309", 1), ("digits", "or ", "(212) 555-0147", 1),
    ("digits", "on ", "2024-01-31", 0), ("digits", "", "1999-12-24", 0), ("digits", "from ", "10-12-2020", 0), ("digits", "", "31.12.1999", 0),
    ("digits", "pages ", "10 20 30", 0), ("digits", "", "12 34 56", 0), ("digits", "scores ", "21-19 21-17", 0), ("digits", "", "100 200 300", 0),
    ("digits", "in ", "2001 2002 2003", 0), ("digits", "", "1000 2000 3000", 0), ("digits", "version ", "10.12.24", 0),
    ("keyed", "", "password=7602ad27cf5550", 1), ("keyed", "my ", "token = \"0641917ea4e8", 1), ("keyed", "", "api_key: abcd1234efgh", 1),
    ("keyed", "the ", "secret: q8w7e6r5", 1),
    ("keyed", "", "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", 1), ("keyed", "", "secret=da39a3ee5e6b4b0d3255bfef95601890afd80709", 1),
    ("keyed", "x ", "api-key: 5baa61e4c9b93f3f0682250b6cf8331b", 1), ("keyed", "", "pwd=0a1b2c3d4e5f60718293a4b5", 1), ("keyed", "a ", "token: something", 0), ("keyed", "", "password: required", 0),
    ("keyed", "the ", "secret: nothing", 0), ("keyed", "", "password = string", 0),
)


def prefix_sums(sizes: Column) -> Column:
    """Sum of all sizes before each place, in blocks so that the work stays near linear."""
    blocks = F.sequence(F.lit(0), ((F.size(sizes) - 1) / BLOCK).cast("int"))
    run = lambda values: F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    inner = F.transform(blocks, lambda b: run(F.slice(sizes, b * BLOCK + 1, BLOCK)))
    totals = lambda parts: run(F.transform(parts, lambda p: F.element_at(p, -1)))
    joined = F.struct(inner.alias("p"))
    return F.flatten(F.element_at(F.transform(F.array(joined), lambda s: F.transform(
        F.arrays_zip(s["p"].alias("p"), F.slice(totals(s["p"]), F.lit(1), F.size(s["p"])).alias("t")),
        lambda z: F.transform(F.slice(z["p"], F.lit(1), F.size(z["p"]) - 1), lambda x: x + z["t"]))), 1))


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, F.lit(0) + i, F.lit(1)).cast("int")
    weigh = lambda i: F.when((n - i) % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weigh(i)) % 10 == 0


def holds(kind: str, span: Column) -> Column:
    """Whether a base match is right."""
    count = F.length(digits_of(span))
    if kind == "ip":
        return span.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when((count >= 13) & (count <= 19), luhn(digits_of(span))).otherwise(False)
    if kind == "phone":
        return (count >= 9) & (count <= 15)
    return F.lit(True)


def features(generator: int, span: Column, before: Column, after: Column) -> list[Column]:
    has = lambda c, weight: F.when(F.instr(span, c) > 0, weight).otherwise(0)
    flag = lambda test: F.when(test, 1).otherwise(0)
    return [
        F.lit(generator), F.least(F.length(digits_of(span)), F.lit(20)),
        F.least(F.length(F.regexp_replace(F.regexp_replace(span, "[0-9]+", "0"), "[^0]", "")), F.lit(6)),
        flag(span.rlike("[A-Za-z]")), has(" ", 1) + has(".", 2) + has("-", 4) + has("(", 8),
        F.least((F.length(span) / 8).cast("int"), F.lit(5)), flag(before.rlike(CONTEXT)),
        flag(span.rlike(r"^(?:19|20)[0-9]{2}(?![0-9])|(?:^|[ .-])(?:19|20)[0-9]{2}$")),
        flag(before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"))]


def matches(text: Column, generator: str, marked: Column) -> Column:
    """start, end, span, before, after of each match, from the text with its matches between marks."""
    parts = F.split(marked, MARK, -1)
    spans = lambda s: F.transform(F.sequence(F.lit(1), F.size(s["parts"]) - 1, F.lit(2)), lambda i: F.struct(
        F.get(s["at"], i).alias("start"), (F.get(s["at"], i) + F.length(F.get(s["parts"], i))).alias("end"), F.get(s["parts"], i).alias("span"),
        F.right(F.get(s["parts"], i - 1), F.lit(24)).alias("before"), F.left(F.get(s["parts"], i + 1), F.lit(1)).alias("after")))
    placed = lambda p: F.struct(p.alias("parts"), prefix_sums(F.transform(p, F.length)).alias("at"))
    return F.element_at(F.transform(F.transform(F.array(parts), placed), spans), 1)


def candidates(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The kept columns and, per generator, its matches (null where there are none)."""
    rows = docs.select(*keep, F.replace(text_of(text), F.lit(MARK), F.lit(OTHER)).alias("__t"))
    quick = {"email": F.col("__t").contains("@"), "phone": F.col("__t").contains("+")}
    marked = rows.select("*", *[
        F.when(quick.get(g, F.lit(True)), F.regexp_replace("__t", p, f"{MARK}$0{MARK}")).alias(f"__m_{g}") for g, p in GENERATORS.items()])
    return marked.select(*[c for c in rows.columns if c != "__t"], *[
        F.when(F.col(f"__m_{g}").contains(MARK), matches(F.col("__t"), g, F.col(f"__m_{g}"))).alias(f"__c_{g}") for g in GENERATORS])


# -- the trees ---------------------------------------------------------------------------------------------------


def cell_of(place: int, generator: str):
    return lambda m: F.struct(F.array(*features(place, m["span"], m["before"], m["after"])).alias("x"),
                              holds(generator, m["span"]).cast("int").alias("y"))


def label_of(generator: str, base: Column):
    """1, 0 or null: what the text itself says about a loose candidate."""
    kind = KINDS.index(KIND[generator])

    def label(m: Column) -> Column:
        if generator == "keyed":
            value = F.regexp_extract(m["span"], r"[:=][ \t]*[\"']?(.*)$", 1)
            return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), 1).when(value.rlike("^[A-Za-z]+$"), 0)
        meets = lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])
        return F.when(F.exists(base, lambda b: meets(b) & (b["kind"] == kind)), 1).when(F.exists(base, meets), 0)

    return label


def labelled(place: int, generator: str, base: Column) -> Column:
    """The loose candidates of a row that have a label, as cells."""
    label = label_of(generator, base)
    cells = F.transform(f"__c_{generator}", lambda m: F.struct(
        F.array(*features(place, m["span"], m["before"], m["after"])).alias("x"), label(m).alias("y")))
    return F.filter(cells, lambda c: c["y"].isNotNull())


def corpus_cells(docs: DataFrame, doc_id: str, text: str) -> list[tuple[list[int], int, int, int]]:
    """features, label, fold, count: labelled candidates of all documents."""
    found = candidates(docs, text, [F.pmod(F.xxhash64(quoted(doc_id)), F.lit(4)).alias("part")])
    found = found.filter(F.coalesce(*[F.col(f"__c_{g}") for g in GENERATORS]).isNotNull())
    none, no_spans = F.array().cast("array<struct<x:array<int>,y:int>>"), F.array().cast(SPANS)
    based = found.withColumn("__base", F.concat(*[F.coalesce(F.transform(F.filter(f"__c_{g}", rightly(g)), span_of(g)), no_spans) for g in BASE]))
    known = F.concat(*[F.coalesce(F.transform(f"__c_{g}", cell_of(i, g)) if g in BASE else labelled(i, g, F.col("__base")), none)
                       for i, g in enumerate(GENERATORS)])
    counts = (based.select((F.col("part") == 0).cast("int").alias("held"), F.explode(known).alias("k"))
              .groupBy("k.x", "k.y", "held").count().collect())       # bounded by the feature values
    return sorted((list(r["x"]), r["y"], r["held"], r["count"]) for r in counts)


def example_cells(spark: SparkSession) -> list[tuple[list[int], int]]:
    """The fixed examples' features, by the same expressions."""
    place = {g: i for i, g in enumerate(GENERATORS)}
    rows = spark.createDataFrame([(place[g], b, s, y) for g, b, s, y in EXAMPLES], "g int, b string, s string, y int")
    x = F.array(*[F.col("g"), *features(0, F.col("s"), F.col("b"), F.lit(""))[1:]])
    return [(list(r["x"]), r["y"]) for r in rows.select(x.alias("x"), "y").collect()]


def best_split(rows: list[int], x, residual, weight) -> tuple[int, int] | None:
    """The feature and the largest value on the left that explain most of the residual."""
    best, choice = 1e-9, None
    total, mass = sum(weight[i] * residual[i] for i in rows), sum(weight[i] for i in rows)
    for f in range(len(FEATURES)):
        sums: dict[int, list[float]] = {}
        for i in rows:
            s = sums.setdefault(x[i][f], [0.0, 0.0])
            s[0] += weight[i] * residual[i]
            s[1] += weight[i]
        left, left_mass = 0.0, 0.0
        for value in sorted(sums)[:-1]:
            left, left_mass = left + sums[value][0], left_mass + sums[value][1]
            gain = left * left / left_mass + (total - left) ** 2 / (mass - left_mass) - total * total / mass
            if gain > best:
                best, choice = gain, (f, value)
    return choice


def grow(rows: list[int], x, y, p, weight, depth: int):
    """A tree as nested (feature, value, left, right); a leaf is the step of its log-odds."""
    residual = {i: y[i] - p[i] for i in rows}
    choice = best_split(rows, x, residual, weight) if depth else None
    if choice is None:
        step = sum(weight[i] * residual[i] for i in rows) / (sum(weight[i] * p[i] * (1 - p[i]) for i in rows) + 1.0)
        return RATE * max(-4.0, min(4.0, step))
    f, value = choice
    left = [i for i in rows if x[i][f] <= value]
    right = [i for i in rows if x[i][f] > value]
    return f, value, grow(left, x, y, p, weight, depth - 1), grow(right, x, y, p, weight, depth - 1)


def output(tree, x: list[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


class Trees:
    """Boosted trees over feature cells and a threshold for each generator."""

    def __init__(self, corpus: list[tuple[list[int], int, int, int]], examples: list[tuple[list[int], int]]):
        cells = [(x, y, math.log2(1 + n)) for x, y, held, n in corpus if not held] + [(x, y, SEED_WEIGHT) for x, y in examples]
        x, y, weight = [c[0] for c in cells], [c[1] for c in cells], [c[2] for c in cells]
        self.trees, score, rows = [], [0.0] * len(x), list(range(len(x)))
        for _ in range(ROUNDS):
            p = [1 / (1 + math.exp(-s)) for s in score]
            if max((abs(a - b) for a, b in zip(y, p)), default=0) < LEAST:
                break
            tree = grow(rows, x, y, p, weight, 3)
            self.trees.append(tree)
            score = [s + output(tree, row) for s, row in zip(score, x)]
        self.thresholds = {}
        for place, g in enumerate(GENERATORS):
            own = [(self.score(x), y, float(n)) for x, y, h, n in corpus if h and x[0] == place]
            if not any(y for _, y, _ in own):
                own += [(self.score(x), y, 1.0) for x, y in examples if x[0] == place]
            self.thresholds[g] = lowest_cut(own)

    def score(self, x: list[int]) -> float:
        return sum(output(t, x) for t in self.trees)

    def column(self, x: Column) -> Column:
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(F.get(x, tree[0]) <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + of(tree)
        return total


def lowest_cut(scored: list[tuple[float, int, float]]) -> float:
    """Half way below the lowest score, itself above even odds, from which on the share of right candidates is PRECISION at least."""
    cut, right, all_ = math.inf, 0.0, 0.0
    levels = sorted({s for s, _, _ in scored}, reverse=True)
    for s, below in zip(levels, [*levels[1:], 0.0]):
        right += sum(n * y for t, y, n in scored if t == s)
        all_ += sum(n for t, _, n in scored if t == s)
        if s > 0 and right >= PRECISION * all_:
            cut = min((s + max(below, 0.0)) / 2, s - 1e-6)           # sums may be added in another order
    return cut


# -- results -----------------------------------------------------------------------------------------------------

SPANS = "array<struct<kind:int,start:int,end:int>>"


def span_of(generator: str):
    kind = KINDS.index(KIND.get(generator, generator))
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def rightly(generator: str):
    return lambda m: holds(generator, m["span"])


def passing(trees: Trees, place: int, generator: str):
    """Whether a candidate's score reaches the generator's threshold; its features are formed once."""
    x = lambda m: F.array(F.array(*features(place, m["span"], m["before"], m["after"])))
    return lambda m: F.element_at(F.transform(x(m), trees.column), 1) >= trees.thresholds[generator]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id alone, unless given) with ``base`` and ``spans``: arrays of (kind, start, end) by
    kind, then start. Kinds are places in KINDS; places are code points, the end exclusive."""
    trees = Trees(corpus_cells(docs, doc_id, text), example_cells(docs.sparkSession))
    keep = keep or [doc_id]
    found = candidates(docs, text, [quoted(c).alias(f"c{i}") for i, c in enumerate(keep)])
    none = F.array().cast(SPANS)
    right = [F.coalesce(F.transform(F.filter(f"__c_{g}", rightly(g)), span_of(g)), none) for g in BASE]
    wanted = [F.coalesce(F.transform(F.filter(f"__c_{g}", passing(trees, i, g)), span_of(g)), none)
              for i, g in enumerate(GENERATORS) if g in LOOSE and trees.thresholds[g] < math.inf]
    kept = [c for c in found.columns if not c.startswith("__")]
    based = found.select(*kept, F.concat(*right).alias("base"), F.concat(none, *wanted).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    return (based.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.array_distinct(F.concat("base", apart)))).otherwise(F.col("base")))
            .drop("more").toDF(*keep, "base", "spans"))


def listed(spans: str) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return found.select(*[quoted(c) for c in found.columns if c not in ("base", "spans")],
                        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
                        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with each span, or run of overlapping spans, replaced by its first kind in brackets; a text without spans stays as it is."""
    columns = list(docs.columns)
    names = [f"c{i}" for i in range(len(columns))]          # an input column may have the name of a result
    found = find(docs, doc_id, text, keep=columns).toDF(*names, "base", "spans")
    body = F.col(names[columns.index(text)])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    tag = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1)
    first = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(
            F.concat(acc["out"], F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), tag(s)))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"))
    whole = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body)))
    changed = F.when(F.size("spans") > 0, F.aggregate(ordered, first, step, whole)).otherwise(body)
    return found.withColumn("redacted", changed).select(*["redacted" if c == text else n for c, n in zip(columns, names)]).toDF(*columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(documents(spark, sf_dir)))
