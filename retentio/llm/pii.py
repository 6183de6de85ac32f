"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Four strict patterns with their checks give the base spans, which always stay.
Loose generators (addresses with a written-out at sign, clusters of digits in
any grouping) propose further, overlapping spans. Boosted trees score every
proposal from its format and its surroundings. They learn from every document,
and from examples that are made anew for every fit, in a fixed number, so that
a table without base spans has thresholds too. No label is read off the
features: a proposal that meets a base span is a positive; each base span is written anew twice, in a form the strict
pattern misses (MASKED, a positive) and in one that is no personal data
(SPOILED, a negative); of the examples it is known what was written (EXAMPLES).
Proposals of the table that meet no base span are never labelled: they are
what the trees are asked about. Per kind, the threshold is the least score at
which held-out proposals reach the wanted precision. Four numbers with dots
have no masked form, so that kind adds nothing.

The trees are fitted by MLlib and applied as SQL expressions inside each row,
so scoring moves no data. All patterns are written with possessive
quantifiers, which match in linear time and without recursion on texts of any
length. Offsets count code points, ends are exclusive.

Defined results: null or empty text has no spans; rows are independent; an
empty table has no rows (the trees still learn from the examples); among selected proposals that overlap the leftmost, then longest stays;
extra columns are kept, columns of the same names replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, PRECISION, SEED = 12, 3, 0.995, 5
#: training rows of one task
ROWS_PER_TASK = 50_000

_LOCAL = "A-Za-z0-9._%+-"
#: strict patterns: same matches as the plain forms, but linear in the text
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without this cannot match
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    "address": r"(?<![^\s@])[^\s@(\[]++(?:@|\x20?[(\[]at[)\]]\x20?)[^\s@]++",
    "digits": r"(?<![0-9])(?<![0-9][().\x20/-])[+(]?[0-9](?:[().\x20/-]{0,2}+[0-9]){6,}+",
}
_SPAN = "array<struct<kind:int,s:int,e:int,m:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(text: str, pattern: str, kind: str) -> str:
    """SQL: leftmost non-overlapping matches with their places, from the pieces between matches."""
    p = _quoted(pattern)
    step = (f"aggregate(sequence(0, size(q.m) - 1), named_struct('at', 0, 'out', cast(array() AS {_SPAN})), "
            "(a, i) -> named_struct('at', a.at + length(q.p[i]) + length(q.m[i]), 'out', concat(a.out, array(named_struct("
            f"'kind', {kind}, 's', a.at + length(q.p[i]), 'e', a.at + length(q.p[i]) + length(q.m[i]), 'm', q.m[i])))), a -> a.out)")
    # a lambda over one struct stands for a common subexpression
    return (f"flatten(transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'p', split({text}, {p}, -1))), "
            f"q -> CASE WHEN size(q.m) = 0 THEN cast(array() AS {_SPAN}) ELSE {step} END))")


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = (f"aggregate(sequence(1, length({_DIGITS})), 0, (t, i) -> t + cast(CASE WHEN i % 2 = 1 THEN cast(substr({_DIGITS}, -i, 1) AS int) "
         f"ELSE (2 * cast(substr({_DIGITS}, -i, 1) AS int)) div 10 + (2 * cast(substr({_DIGITS}, -i, 1) AS int)) % 10 END AS int)) % 10 = 0")
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), part -> cast(part AS double) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds _base: base spans of all kinds, by kind, then start."""
    out = docs
    for k, kind in enumerate(KINDS):
        need = f"contains({text}, '{NEEDS[kind]}')" if NEEDS[kind] else f"{text} RLIKE '[0-9]'"
        out = out.withColumn(f"_b{k}", F.expr(
            f"CASE WHEN {need} THEN filter({_found(text, BASE[kind], str(k))}, x -> {CHECKS[kind]}) ELSE cast(array() AS {_SPAN}) END"))
    cols = [f"_b{k}" for k in range(len(KINDS))]
    return out.withColumn("_base", F.concat(*cols)).drop(*cols)


#: format and surroundings of a proposal x in its text
FEATURES = {
    "f_kind": "x.kind",
    "f_length": "x.e - x.s",
    "f_digits": f"length({_DIGITS})",
    "f_groups": "size(split(x.m, '[^0-9]+'))",
    "f_first_group": "length(regexp_extract(x.m, '^[^0-9]*([0-9]*)', 1))",
    "f_last_group": "length(regexp_extract(x.m, '([0-9]*)$', 1))",
    "f_dots": "length(x.m) - length(replace(x.m, '.', ''))",
    "f_dashes": "length(x.m) - length(replace(x.m, '-', ''))",
    "f_spaces": "length(x.m) - length(replace(x.m, ' ', ''))",
    "f_brackets": "length(x.m) - length(regexp_replace(x.m, '[()]', ''))",
    "f_letters": "length(regexp_replace(x.m, '[^A-Za-z]', ''))",
    "f_before": "CASE WHEN x.b = '' THEN 0 WHEN x.b RLIKE '[A-Za-z]$' THEN 1 WHEN x.b RLIKE '[0-9]$' THEN 2 WHEN x.b RLIKE '[ \\n]$' THEN 3 ELSE 4 END",
    "f_after": "CASE WHEN x.a = '' THEN 0 WHEN x.a RLIKE '^[A-Za-z]' THEN 1 WHEN x.a RLIKE '^[0-9]' THEN 2 WHEN x.a RLIKE '^[ \\n]' THEN 3 ELSE 4 END",
    "f_capital": "CASE WHEN x.b RLIKE '[A-Z][^ ]* ?$' THEN 1 ELSE 0 END",
    "f_quoted": "CASE WHEN x.b RLIKE '[\\'\"=]' THEN 1 ELSE 0 END",
    "f_luhn": f"CASE WHEN x.kind > 0 AND length({_DIGITS}) BETWEEN 13 AND 19 THEN cast({_LUHN} AS int) ELSE 0 END",
    "f_octets": f"CASE WHEN x.kind = 1 THEN cast({CHECKS['ip']} AS int) ELSE 0 END",
    "f_domain": "CASE WHEN x.kind = 0 AND x.m RLIKE '(@|at[)\\\\]] ?)([A-Za-z0-9-]++[.])++[A-Za-z]{2}' THEN 1 ELSE 0 END",
    "f_plus": "CASE WHEN x.m LIKE '+%' THEN 1 ELSE 0 END",
    "f_zeros": "CASE WHEN x.m LIKE '00%' THEN 1 ELSE 0 END",
    "f_date": "CASE WHEN x.m RLIKE '(^|[^0-9])(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}([^0-9]|$)' THEN 1 ELSE 0 END",
    "f_word": "CASE WHEN lower(x.b) RLIKE '(tel|phone|call|fax|mobile|cell|card|visa|amex)[^a-z0-9]*$' THEN 1 ELSE 0 END",
}

#: a base span x in a form that the strict pattern of its kind misses; an address of four numbers has none
MASKED = f"""CASE x.kind WHEN 0 THEN replace(x.m, '@', CASE WHEN x.s % 2 = 0 THEN ' (at) ' ELSE '[at]' END) WHEN 1 THEN x.m
WHEN 2 THEN regexp_replace({_DIGITS}, '([0-9]{{4}})(?=[0-9])', '$1.')
ELSE CASE WHEN contains(x.m, '(') THEN regexp_replace(x.m, '^[+][0-9]+[ .-]*', '') ELSE concat('00', substr(x.m, 2)) END END"""
#: a base span x made into no personal data: no domain, a number over 255, a wrong check digit, a plain number or a date
SPOILED = f"""CASE x.kind WHEN 0 THEN regexp_replace(x.m, '@.*$', CASE WHEN x.s div 2 % 2 = 0 THEN '@here' ELSE ' (at) home' END) WHEN 1 THEN regexp_replace(x.m, '^[0-9]+', '999')
WHEN 2 THEN concat(CASE WHEN x.s % 2 = 0 THEN substr(x.m, 1, length(x.m) - 1) ELSE regexp_replace(substr({_DIGITS}, 1, length({_DIGITS}) - 1), '([0-9]{{4}})', '$1.') END,
    (cast(right(x.m, 1) AS int) + 5) % 10)
ELSE CASE x.s % 3 WHEN 0 THEN {_DIGITS} WHEN 1 THEN regexp_replace({_DIGITS}, '([0-9])(?=([0-9]{{3}})+$)', '$1 ')
     ELSE concat('20', substr({_DIGITS}, 1, 2), '-0', substr({_DIGITS}, 3, 1), '-1', substr({_DIGITS}, 4, 1), ' ', substr({_DIGITS}, 5, 4)) END END"""


#: examples that a fit makes, a fixed number
N_EXAMPLES = 9_000
_SUM = "(aggregate(sequence(1, 15), 0, (t, i) -> t + cast(CASE WHEN i % 2 = 0 THEN cast(substr(n, -i - 1, 1) AS int) ELSE (2 * cast(substr(n, -i - 1, 1) AS int)) div 10 + (2 * cast(substr(n, -i - 1, 1) AS int)) % 10 END AS int)) % 10)"
#: kind, whether it is personal data, and the text of an example; d: random digits, n: 16 of them that pass the check
EXAMPLES = [
    (0, True, "concat(name, '.', substr(h, 1, 4), ' (at) ', word, '.example.org')"), (0, True, "concat(name, '[at]', substr(h, 3, 5), '.net')"),
    (0, True, "concat(substr(h, 1, 6), ' [at] ', word, '.', name, '.com')"), (0, False, "concat(name, ' (at) ', word)"), (0, False, "concat(word, '[at]', name)"),
    (0, False, "concat(name, '@', substr(d, 1, 2))"), (0, False, "concat(word, '@', name)"),
    (2, True, "regexp_replace(n, '([0-9]{4})(?=[0-9])', '$1.')"), (2, True, "regexp_replace(n, '([0-9]{4})(?=[0-9])', '$1/')"), (2, True, "regexp_replace(n, '([0-9]{4})(?=[0-9])', '$1 - ')"),
    (2, False, "concat(left(n, 15), (cast(right(n, 1) AS int) + 1 + cast(left(d, 1) AS int) % 9) % 10)"),
    (2, False, "regexp_replace(concat(left(n, 15), (cast(right(n, 1) AS int) + 1 + cast(left(d, 1) AS int) % 9) % 10), '([0-9]{4})(?=[0-9])', '$1.')"),
    (2, False, "concat(substr(h, 1, 3), 'e', n, 'b', substr(h, 4, 5))"), (2, False, "concat('\"', substr(h, 1, 7), 'f', d, 'a', substr(h, 5, 8), '\"')"),
    (3, True, "concat('(0', substr(d, 1, 2), ') ', substr(d, 3, 4), ' ', substr(d, 7, 4))"), (3, True, "concat('00', 1 + cast(left(d, 1) AS int) % 9, substr(d, 1, 1), ' ', substr(d, 3, 3), ' ', substr(d, 6, 6))"),
    (3, True, "concat('(', 2 + cast(left(d, 1) AS int) % 8, substr(d, 2, 2), ') ', substr(d, 4, 3), '-', substr(d, 7, 4))"),
    (3, False, "substr(d, 1, 8 + cast(left(h, 1) RLIKE '[0-7]' AS int))"), (3, False, "concat('20', substr(d, 1, 2), '-0', 1 + cast(left(d, 1) AS int) % 9, '-1', substr(d, 4, 1), ' ', substr(d, 5, 4))"),
    (3, False, "concat(1 + cast(left(d, 1) AS int) % 9, ' ', substr(d, 2, 3), ' ', substr(d, 5, 3))"), (3, False, "concat(substr(h, 1, 4), 'c', substr(d, 1, 9), 'd', substr(h, 2, 9))"),
    (3, False, "concat('\"', substr(h, 1, 8), 'a', substr(d, 1, 8), substr(h, 6, 4), '\"')"), (3, False, "concat('0', substr(d, 1, 2), '.', substr(d, 3, 2), '.', substr(d, 5, 5))"),
]


def _rewritten(text: str, form: str) -> str:
    """SQL: the text with each base span in another form, and the places of these; of overlapping spans the first is rewritten."""
    forms = f"array_sort(transform(_base, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind, 'm', {form})))"
    at = "length(a.out) + x.s - a.at"
    return (f"aggregate({forms}, named_struct('at', 0, 'out', '', 'spans', cast(array() AS {_SPAN})), (a, x) -> CASE WHEN x.s < a.at THEN a "
            f"ELSE named_struct('at', x.e, 'out', concat(a.out, substring({text}, a.at + 1, x.s - a.at), x.m), 'spans', concat(a.spans, "
            f"array(named_struct('kind', x.kind, 's', {at}, 'e', {at} + length(x.m), 'm', x.m)))) END, "
            f"a -> named_struct('body', concat(a.out, substring({text}, a.at + 1, length({text}) - a.at)), 'spans', a.spans))")


def with_proposals(docs: DataFrame, text: str) -> DataFrame:
    """Adds _cand: proposals with features and ``hit`` (meets a base span of its kind); needs _base."""
    empty = f"cast(array() AS {_SPAN})"
    address = f"CASE WHEN contains({text}, '@') OR contains({text}, 'at)') OR contains({text}, 'at]') THEN {_found(text, LOOSE['address'], '0')} ELSE {empty} END"
    digits = f"CASE WHEN {text} RLIKE '[0-9]' THEN {_found(text, LOOSE['digits'], '3')} ELSE {empty} END"
    kind = f"CASE WHEN x.kind = 0 THEN 0 WHEN x.m RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN 1 WHEN length({_DIGITS}) >= 13 AND NOT x.m RLIKE '^([+]|00)' THEN 2 ELSE 3 END"
    around = (f"transform(concat(_address, _digits), x -> named_struct('kind', {kind}, 's', x.s, 'e', x.e, 'm', x.m, "
              f"'b', substring({text}, greatest(x.s - 11, 1), x.s - greatest(x.s - 12, 0)), 'a', substring({text}, x.e + 1, 2)))")
    scored = ("transform(_around, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, "
              "'hit', exists(_base, y -> y.kind = x.kind AND y.s < x.e AND x.s < y.e), "
              "'free', NOT exists(_base, y -> y.s < x.e AND x.s < y.e), "
              + ", ".join(f"'{n}', cast({e} AS double)" for n, e in FEATURES.items()) + "))")
    return (docs.withColumn("_address", F.expr(address)).withColumn("_digits", F.expr(digits)).withColumn("_around", F.expr(around))
            .withColumn("_cand", F.expr(scored)).drop("_address", "_digits", "_around"))


def _as_sql(node) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(node.prediction())!r}D"
    split = node.split()
    name = list(FEATURES)[split.featureIndex()]
    return f"(CASE WHEN x.{name} <= {float(split.threshold())!r}D THEN {_as_sql(node.leftChild())} ELSE {_as_sql(node.rightChild())} END)"


class Model:
    """The summed trees as a SQL expression of a proposal x, and the threshold of each kind (None: adds nothing)."""

    def __init__(self, margin: str = "0D", thresholds: dict[int, float] | None = None):
        self.margin, self.thresholds = margin, thresholds or {}


def with_variants(docs: DataFrame, text: str) -> DataFrame:
    """id, form, text and _base of the documents as they are and, where they have base spans, with these masked and spoiled; needs _base."""
    forms = (f"CASE WHEN size(_base) = 0 THEN array(named_struct('form', 'as is', 'body', {text}, 'spans', _base)) ELSE transform(array("
             f"named_struct('form', 'as is', 'x', named_struct('body', {text}, 'spans', _base)), named_struct('form', 'masked', 'x', {_rewritten(text, MASKED)}), "
             f"named_struct('form', 'spoiled', 'x', {_rewritten(text, SPOILED)})), v -> named_struct('form', v.form, 'body', v.x.body, 'spans', v.x.spans)) END")
    return docs.select("id", F.explode(F.expr(forms)).alias("v")).select("id", "v.form", F.col("v.body").alias(text), F.col("v.spans").alias("_base"))


def examples(spark: SparkSession, n: int = N_EXAMPLES, seed: int = SEED) -> DataFrame:
    """id, body, label, s, e: texts with one example each, its class and its place."""
    pick = lambda names, at: f"element_at(array({', '.join(repr(x) for x in names)}), 1 + cast(conv(substr(h, {at}, 2), 16, 10) AS int) % {len(names)})"
    words = ["the", "of", "see", "here", "und", "les", "para", "call", "number", "code", "order", "contact"]
    rows = (spark.range(n).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
            .withColumn("d", F.expr("concat(lpad(conv(substr(h, 20, 15), 16, 10), 19, '0'), lpad(conv(substr(h, 36, 12), 16, 10), 15, '0'))"))
            .withColumn("d", F.expr("reverse(substr(d, 2))")).withColumn("n", F.expr("concat(substr(d, 1, 15), '0')"))
            .withColumn("n", F.expr(f"concat(left(n, 15), (10 - {_SUM}) % 10)"))
            .withColumn("word", F.expr(pick(words, 50))).withColumn("name", F.expr(pick(["anna", "jose", "li", "omar", "eva", "support"], 52))))
    which = f"id % {len(EXAMPLES)}"
    item = "CASE " + " ".join(f"WHEN {which} = {k} THEN {form}" for k, (_, _, form) in enumerate(EXAMPLES)) + " END"
    good = f"{which} IN ({', '.join(str(k) for k, (_, yes, _) in enumerate(EXAMPLES) if yes)})"
    rows = rows.withColumn("item", F.expr(item)).withColumn("before", F.expr("concat(upper(left(name, 1)), substr(name, 2), ' ', word, CASE WHEN h RLIKE '[0-7]$' THEN ': ' ELSE ' ' END)"))
    return rows.select("id", F.expr("concat(before, item, CASE WHEN h RLIKE '[0-9]$' THEN ', ' ELSE ' ' END, word, '.')").alias("body"),
                       F.expr(f"cast({good} AS double)").alias("label"), F.expr("length(before)").alias("s"), F.expr("length(before) + length(item)").alias("e"))


def fit(docs: DataFrame, precision: float = PRECISION, doc_id: str = "doc_id", text: str = "text") -> Model:
    body = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("body"))
    told = with_proposals(with_variants(with_base(body, "body"), "body"), "body").select(F.xxhash64("id").alias("h"), "form", F.explode("_cand").alias("x"))
    label = F.expr("""CASE form WHEN 'as is' THEN CASE WHEN x.hit THEN 1D END
        WHEN 'masked' THEN CASE WHEN x.hit AND x.kind <> 1 THEN 1D END ELSE CASE WHEN NOT x.free THEN 0D END END""")
    made = with_proposals(with_base(examples(docs.sparkSession), "body"), "body").select(
        F.xxhash64("id").alias("h"), "label", F.explode(F.expr("filter(_cand, x -> x.s < e AND s < x.e)")).alias("x"))
    rows = told.withColumn("label", label).where("label IS NOT NULL").select("h", "label", "x").unionByName(made)
    rows = cut_lineage(rows.select((F.pmod("h", F.lit(3)) == 0).alias("judge"), "label", "x.kind", *[f"x.{n}" for n in FEATURES]))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    learnt = vectors.where("not judge").select("features", "label")
    tasks = max(1, math.ceil(learnt.count() / ROWS_PER_TASK))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, featuresCol="features", labelCol="label").fit(
        learnt.repartition(tasks))
    margin = " + ".join(f"{float(w)!r}D * {_as_sql(t._java_obj.rootNode())}" for w, t in zip(trees.treeWeights, trees.trees))
    judged = rows.where("judge").withColumn("x", F.struct("kind", *FEATURES)).select(
        "kind", "label", F.floor(F.expr(margin) * 20).alias("step"))
    # at most a few hundred steps a kind: the margin is bounded by the tree weights
    steps = judged.groupBy("kind", "step").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    thresholds = {}
    for kind in range(len(KINDS)):
        n, ones = 0, 0.0
        for r in sorted((r for r in steps if r["kind"] == kind and r["step"] >= 0), key=lambda r: -r["step"]):
            n, ones = n + r["n"], ones + r["ones"]
            if (ones + 1) / (n + 2) >= precision:
                thresholds[kind] = r["step"] / 20
    return Model(margin, thresholds)


def with_spans(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """Adds _base and _spans (array of kind, s, e by kind, then start): base spans and selected proposals."""
    out = with_base(docs, text)
    plain = "transform(_base, y -> named_struct('kind', y.kind, 's', y.s, 'e', y.e))"
    if not model.thresholds:
        return out.withColumn("_spans", F.expr(plain))
    out = with_proposals(out, text)
    cut = "CASE x.kind " + " ".join(f"WHEN {k} THEN {t!r}D" for k, t in model.thresholds.items()) + " END"
    chosen = f"filter(_cand, x -> x.free AND coalesce({model.margin} >= {cut}, false))"
    # leftmost, then longest; then none that overlaps the one before
    lined = f"array_sort(transform({chosen}, x -> named_struct('s', x.s, 'ne', -x.e, 'kind', x.kind)))"
    apart = (f"aggregate({lined}, named_struct('at', 0, 'out', cast(array() AS array<struct<kind:int,s:int,e:int>>)), "
             "(a, x) -> CASE WHEN x.s >= a.at THEN named_struct('at', -x.ne, 'out', concat(a.out, array(named_struct('kind', x.kind, 's', x.s, 'e', -x.ne)))) ELSE a END, a -> a.out)")
    return out.withColumn("_more", F.expr(apart)).withColumn("_spans", F.expr(f"array_sort(concat({plain}, _more))")).drop("_cand", "_more")


def _listed(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans."""
    rows = with_spans(docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body")), model, "body")
    counts = [F.expr(f"cast(size(filter(_base, x -> x.kind = {k})) AS long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"), _listed("_spans").alias("spans"))


def redacted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind's mark, as [EMAIL]; overlapping spans become one mark."""
    rows = with_spans(docs.withColumn("_body", text_or_empty(text)), model, "_body")
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    lined = "array_sort(transform(_spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"
    built = (f"aggregate({lined}, named_struct('at', 0, 'out', ''), (a, x) -> CASE WHEN x.s < a.at THEN named_struct('at', greatest(a.at, x.e), 'out', a.out) "
             f"ELSE named_struct('at', x.e, 'out', concat(a.out, substring(_body, a.at + 1, x.s - a.at), {names}[x.kind])) END, "
             "a -> concat(a.out, substring(_body, a.at + 1, length(_body) - a.at)))")
    new = F.expr(f"CASE WHEN size(_spans) = 0 THEN {text} ELSE {built} END")
    return rows.withColumn(text, new).drop("_body", "_base", "_spans")
