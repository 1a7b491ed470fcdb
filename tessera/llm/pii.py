"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans are everything of roughly the shape of a kind. Labelers vote on each (yes, no or silent): its base
form, a validator (check digits, ranges), a gazetteer (names, calling codes, issuers, domains), words of context before
it, and words that speak against it. Spark counts the patterns of votes over all candidates of all documents, a table of
fixed size; expectation-maximisation over it estimates each labeler's reliability, and the posteriors train a logistic
span classifier over kind, votes and length. The classifier becomes a SQL expression that decides the spans beyond the
base ones; the base forms (email, ip, card, phone) always stay.

All matching, voting, counting and scoring is done by regular expressions and higher-order functions in the JVM; the
driver's arithmetic sees the table of patterns alone. Offsets are code points, the end exclusive.

Cases: a null or empty text has no spans; repeated rows get equal spans; texts without any candidate leave the prior
classifier, which adds nothing; an empty table gives an empty result; redacted() keeps all other columns.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Kinds in the order of the output; the first four are base kinds.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "name"]
BASE = 4
#: A span beyond the base ones is kept when the classifier gives it this probability.
KEEP_AT = 0.8
CONTEXT = 40
#: What is believed of each labeler (base form, validator, gazetteer, context, against) beforehand: its reliability, the number of votes
#: that this belief weighs, and the bounds of the estimate. Check digits and ranges seldom err; a gazetteer alone says little.
BELIEFS = [(0.8, 10, 0.5, 0.95), (0.97, 200, 0.95, 0.99), (0.7, 10, 0.5, 0.8), (0.8, 10, 0.5, 0.95), (0.9, 50, 0.8, 0.98)]

# The base patterns. Runs are possessive and begin at their left end (for email: or where the last match ended, \G), which
# changes no match and keeps long runs linear; characters are tested before what stands behind them, as most fail there.
BASE_PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
]

# Gazetteers and context words (fixed values).
GIVEN = "Alice|Andrea|Anna|Antonio|Carlos|Carmen|Charles|Claire|Daniel|David|Elena|Elizabeth|Emma|Hans|Isabel|James|Jean|Jennifer|Johann|John|Jose|José|Juan|Julia|Karl|Laura|Linda|Louise|Lucia|Maria|María|Marie|Mary|Michael|Michel|Patricia|Paul|Peter|Pierre|Richard|Robert|Sarah|Sofia|Susan|Thomas|Ursula|William|Wolfgang"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra"
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|it|nl|ch|at"
CALLING = "1|7|2[0-9]{1,2}|3[0-9]{1,2}|4[0-9]{1,2}|5[0-9]{1,2}|6[0-9]{1,2}|8[0-9]{1,2}|9[0-9]{1,2}"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
IBAN_COUNTRIES = "AT|BE|CH|DE|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
CONTEXT_WORDS = [
    r"e-?mail|mailto|contact|correo|courriel|kontakt",
    r"\bip\b|host|server|serveur|servidor",
    r"card|visa|credit|kredit|karte|tarjeta|carte",
    r"phone|\btel\b|\bcall\b|mobile|\bfax\b|telefon|teléfono|téléphone",
    r"iban|account|konto|cuenta|compte|\bbank",
    r"\bssn\b|social security|insurance number",
    r"\b(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|mme|señor|señora|name|author|signed)\b",
]
AGAINST = r"version|release|\bv\.?\s*$|isbn|issn|order|invoice|serial|section|chapter|figure|\bno\.?\s*$|https?:\S*$"

# Candidates beyond the base patterns, one alternative for each kind in the order of EXTRA_KINDS.
EXTRA_KINDS = ["email", "phone", "iban", "ssn", "name"]
EXTRA_PATTERNS = [
    r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,24}\b",
    r"(?:\((?<![0-9+(]\()0?[0-9]{2,4}\) ?|0(?<![0-9+(]0)[0-9]{1,4}[ ./-])[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,3}(?![0-9])",
    r"\b(?=[A-Z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    rf"\b(?=\p{{Lu}}\p{{Ll}})(?:(?:{TITLES})\.? (?:\p{{Lu}}\p{{Ll}}+ )?|(?:{GIVEN}) )\p{{Lu}}\p{{Ll}}+\b",
]
# What a text must hold for its pattern to be worth a search: no text without it can match.
NEEDS = [["@"], ["."], [], ["+"]]
EXTRA_NEEDS = {"email": ["(at)", "[at]"]}

_SPANS = "array<struct<s:int,e:int,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = _digits(m)
    n = F.length(d)

    def weigh(i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weigh(i)) % 10 == 0


def octets(m: Column) -> Column:
    """Whether all dotted parts of m are at most 255, whatever their leading zeros."""
    plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).cast("int") <= 255))


def _digit_count(m: Column, least: int, most: int) -> Column:
    return F.length(_digits(m)).between(least, most)


VALID = [
    lambda m: F.lit(True),
    octets,
    lambda m: F.when(_digit_count(m, 16, 19), luhn(m)).otherwise(F.lit(False)),
    lambda m: _digit_count(m, 8, 15),
]
#: Failing matches of these shapes stay candidates, for the labelers to judge.
NEAR = [lambda m: F.lit(True), lambda m: F.lit(True), lambda m: _digit_count(m, 14, 19), lambda m: _digit_count(m, 7, 16)]


def _iban(m: Column) -> Column:
    """Whether an IBAN's remainder modulo 97 is 1."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


#: The validators; email addresses and names have none, so that labeler is silent there.
CHECKS = {"email": None, "ip": octets, "card": luhn, "phone": VALID[3], "iban": _iban, "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), "name": None}


#: Strict forms of the candidates beyond the base patterns: a spelled-out dot, a title before the name.
FORMS = {"email": lambda m: m.rlike(r"[\[(]dot[\])]"), "name": lambda m: m.rlike(rf"^(?:{TITLES})\b")}


def _searched(rows: DataFrame, name: str, pattern: str, keep, needs: list[str]) -> DataFrame:
    """Add column `name`: the spans of pattern in `text` that keep() takes, in order.

    What lies between the matches gives their places; only kept spans are appended, so that texts full of numbers stay cheap.
    """
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(reduce(or_, (F.contains("text", F.lit(n)) for n in needs)), found)
    rows = rows.withColumn("_found", found)
    rows = rows.withColumn("_gaps", F.when(F.size("_found") > 0, F.transform(F.split("text", pattern, -1), F.length)))
    none = F.array().cast(_SPANS)

    def step(acc: Column, i: Column) -> Column:
        m = F.get("_found", i)
        s = acc["pos"] + F.get("_gaps", i)
        e = s + F.length(m)
        return F.struct(e.alias("pos"), F.when(keep(m), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), m.alias("m"))).cast(_SPANS))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size("_found") - 1), F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return rows.withColumn(name, F.when(F.size("_found") > 0, spans).otherwise(none)).drop("_found", "_gaps")


def _votes(kind: int, span: Column, form: Column | None, valid: Column | None) -> Column:
    """The pattern of a candidate: kind, five votes (0 no, 1 silent, 2 yes) and a bucket of its length."""
    m = span["m"]
    before = F.lower(F.substring(F.col("text"), F.greatest(span["s"] - CONTEXT + 1, F.lit(1)), F.least(span["s"], F.lit(CONTEXT))))
    digits = _digits(m)
    gazetteer = [
        m.rlike(rf"(?i)[.\]) ](?:{DOMAINS})$"),
        ~m.rlike(r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."),
        digits.rlike(f"^(?:{ISSUERS})"),
        digits.rlike(f"^0*(?:{CALLING})"),
        m.rlike(f"^(?:{IBAN_COUNTRIES})"),
        ~m.rlike("^(?:000|666|9)"),
        m.rlike(rf"\b(?:{GIVEN})\b"),
    ][kind]
    vote = lambda c, yes, no: F.when(c, yes).otherwise(no)
    against = before.rlike(AGAINST)
    if KINDS[kind] not in ("email", "name"):
        # a part of a longer word or key
        against = against | before.rlike("[a-z]$") | F.substring(F.col("text"), span["e"] + 1, F.lit(1)).rlike("[A-Za-z]")
    length = F.when(F.length(m) < 12, 0).when(F.length(m) < 20, 1).otherwise(2)
    return F.concat_ws("", F.lit(str(kind)), F.lit("1") if form is None else vote(form, "2", "1"), F.lit("1") if valid is None else vote(valid, "2", "0"), vote(gazetteer, "2", "1"), vote(before.rlike(CONTEXT_WORDS[kind]), "2", "1"), vote(against, "0", "1"), length.cast("string"))


def _on_match(check):
    """check() over the matched text of a span."""
    return lambda x: check(x["m"])


def _whole(pattern: str):
    return lambda m: m.rlike(f"^(?:{pattern})$")


def _candidate(kind: int, form, check):
    """From a span to a candidate with its votes; form: the base rule or None, check: the validator or None."""
    return lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), _votes(kind, x, form and form(x["m"]), check and check(x["m"])).alias("p"))


def _kind(kind: int):
    """From a span to (k, s, e)."""
    return lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def found(docs: DataFrame) -> DataFrame:
    """Add base0..base3 (spans of the base kinds) and more (candidates: k kind, s, e, p pattern of votes). A null text counts as empty."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for k, pattern in enumerate(BASE_PATTERNS):
        rows = _searched(rows, f"near{k}", pattern, NEAR[k], NEEDS[k])
    plain = [p for name, p in zip(EXTRA_KINDS, EXTRA_PATTERNS, strict=True) if name not in EXTRA_NEEDS]
    rows = _searched(rows, "extra", "|".join(plain), lambda m: F.lit(True), [])
    for name, needs in EXTRA_NEEDS.items():
        rows = _searched(rows, f"extra_{name}", EXTRA_PATTERNS[EXTRA_KINDS.index(name)], lambda m: F.lit(True), needs)
    for k in range(BASE):
        rows = rows.withColumn(f"base{k}", F.filter(f"near{k}", _on_match(VALID[k])))
    parts = [F.transform(f"near{k}", _candidate(k, VALID[k], CHECKS[KINDS[k]])) for k in range(BASE)]
    for name, pattern in zip(EXTRA_KINDS, EXTRA_PATTERNS, strict=True):
        own = F.col(f"extra_{name}") if name in EXTRA_NEEDS else F.filter("extra", _on_match(_whole(pattern)))
        parts.append(F.transform(own, _candidate(KINDS.index(name), FORMS.get(name), CHECKS[name])))
    return rows.withColumn("more", F.concat(*parts)).drop("extra", *(f"extra_{name}" for name in EXTRA_NEEDS), *(f"near{k}" for k in range(BASE)))


def reliabilities(patterns: dict[str, float], rounds: int = 60) -> tuple[dict[str, float], list[float]]:
    """Expectation-maximisation over counted patterns: the posterior of each pattern, and each labeler's reliability."""
    accuracy, prior = [belief for belief, *_ in BELIEFS], {p[0]: 0.5 for p in patterns}
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for p in patterns:
            yes, no = math.log(prior[p[0]]), math.log(1 - prior[p[0]])
            for a, v in zip(accuracy, p[1:6], strict=True):
                if v != "1":
                    yes, no = yes + math.log(a if v == "2" else 1 - a), no + math.log(1 - a if v == "2" else a)
            posterior[p] = 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
        for k in prior:
            n = sum(c for p, c in patterns.items() if p[0] == k)
            # at most even: what a candidate needs beyond its shape is evidence of its own
            prior[k] = min(0.5, (sum(c * posterior[p] for p, c in patterns.items() if p[0] == k) + 2) / (n + 4))
        for j, (belief, weight, least, most) in enumerate(BELIEFS):
            right = sum(c * (posterior[p] if p[1 + j] == "2" else 1 - posterior[p]) for p, c in patterns.items() if p[1 + j] != "1")
            n = sum(c for p, c in patterns.items() if p[1 + j] != "1")
            accuracy[j] = max(least, min(most, (right + belief * weight) / (n + weight)))
    return posterior, accuracy


def fit(patterns: dict[str, float], steps: int = 300, rate: float = 0.5) -> dict[tuple[int, str], float]:
    """A logistic classifier over the places of a pattern, trained on the posteriors; weights by (place, character)."""
    posterior, _ = reliabilities(patterns)
    total = sum(patterns.values())
    weights: dict[tuple[int, str], float] = {}
    for p in patterns:
        for place in enumerate(p):
            weights.setdefault(place, 0.0)
    memory = dict.fromkeys(weights, 1e-6)
    for _ in range(steps):
        slope = {w: 1e-4 * v for w, v in weights.items()}
        for p, c in patterns.items():
            z = sum(weights[x] for x in enumerate(p))
            miss = (1 / (1 + math.exp(max(-60.0, min(60.0, -z)))) - posterior[p]) * c / total
            for x in enumerate(p):
                slope[x] += miss
        for w, g in slope.items():
            memory[w] += g * g
            weights[w] -= rate * g / math.sqrt(memory[w])
    return weights


def train(docs: DataFrame) -> dict[tuple[int, str], float]:
    """The span classifier, from the votes on every candidate of docs. The table that is collected has one row a pattern, of which there are 1008."""
    # explode() would put a filter on the array's size below the searches and so run them twice; explode_outer() does not
    counted = found(docs.select("text")).select(F.explode_outer("more.p").alias("p")).filter("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    # every pattern that can occur weighs a little, so that the classifier is defined for those that the corpus lacks
    patterns = {"".join(p): 0.1 for p in product(map(str, range(len(KINDS))), "12", "012", "12", "12", "01", "012")}
    for r in counted:
        patterns[r["p"]] += r["n"]
    return fit(patterns)


def _spans(rows: DataFrame, weights: dict[tuple[int, str], float]) -> DataFrame:
    """Add spans: all kept spans as (k, s, e), sorted."""
    base = F.concat(*(F.transform(f"base{k}", _kind(k)) for k in range(BASE)))
    at = max((p for p, _ in weights), default=-1) + 1

    def likely(p: Column) -> Column:
        z = F.lit(0.0)
        for place in range(at):
            own = [(c, w) for (i, c), w in weights.items() if i == place]
            choice = F.lit(-4.0)
            for c, w in own:
                choice = F.when(F.substring(p, place + 1, 1) == c, F.lit(w)).otherwise(choice)
            z = z + choice
        return z >= math.log(KEEP_AT / (1 - KEEP_AT)) if at else F.lit(False)

    rows = rows.withColumn("_base", base)
    fresh = F.filter("more", lambda x: likely(x["p"]) & ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return rows.withColumn("spans", F.array_sort(F.array_distinct(F.concat("_base", F.transform(fresh, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))))).drop("_base")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def report(docs: DataFrame, weights: dict[tuple[int, str], float]) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs."""
    rows = _spans(found(docs.select("doc_id", "text")), weights)
    base = F.concat(*(F.transform(f"base{k}", _kind(k)) for k in range(BASE)))
    counts = [F.size(f"base{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, weights: dict[tuple[int, str], float]) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (spans that overlap: by the first's); a null text stays null."""
    # the row travels as one value, so that its columns may have any names
    rows = _spans(found(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")), weights)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        pos = acc["pos"]
        shown = F.concat(acc["out"], F.substring(text, pos + 1, x["s"] - pos), F.get(names, x["k"]))
        return F.struct(F.greatest(pos, x["e"]).alias("pos"), F.when(x["s"] >= pos, shown).otherwise(acc["out"]).alias("out"))

    by_place = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    made = F.aggregate(by_place, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    new = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.when(F.size("spans") > 0, made).otherwise(text))
    return rows.select(*((new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, train(docs))
