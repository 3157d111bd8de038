"""Personal data: regex, gazetteer and context labelers vote on spans; EM weighs them and trains the span classifier.

Everything here is DataFrame and SQL functions; the driver only holds the labelers' reliabilities and feature weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, with_columns, written

# The quantifiers are possessive and the searches anchored to where a run begins, so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Candidates beyond the base kinds, which labelers may know for a person's: runs of digits, bank accounts, e-mail addresses
#: in words, names after a title or an introduction, and street addresses.
NUMBER = r"[0-9](?:[ .()/-]{0,2}[0-9]){6,}+"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
SPELLED = r"(?i)\b[a-z0-9][a-z0-9._%+-]*+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[a-z0-9-]++)+"
NAME = r"(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Herr|Frau|Sra|Señora?|Madame|Monsieur)\.? |\b[Mm]y name is |\bje m'appelle |\bich heiße |\bme llamo )\p{Lu}[\p{L}'’-]*+(?: \p{Lu}[\p{L}'’-]*+){0,3}"
ADDRESS = (
    r"\b[0-9]{1,5}[a-z]? (?:\p{Lu}[\p{L}'-]*+ ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square)\b|\b\p{Lu}\p{L}*(?:straße|strasse|gasse|weg|platz|allee) [0-9]{1,4}\b|"
    r"\b[0-9]{1,4},? (?:rue|avenue|boulevard|place) (?:de |du |des |de la )?\p{Lu}[\p{L}'-]*+|\b(?:Calle|Avenida|Plaza|Paseo) (?:de |del |de la )?\p{Lu}[\p{L}'-]*+,? [0-9]{1,4}\b"
)

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("number", "iban", "spelled", "name", "address")
KINDS = (*BASE_KINDS, *MORE_KINDS)
BEFORE = 32
CUES = r"(?i)\b(phone|tel|telephone|mobile|fax|call|mail|email|e-mail|contact|card|visa|mastercard|account|iban|ssn|passport|name|signed|dear|address|lives? at|write to|reach me|adresse|wohnhaft|dirección|domicilio|habite|téléphone|tarjeta|teléfono|karte|konto|telefon|carte|compte|cuenta|correo|nombre|nom)\W{0,3}(number|no|nr|n°|is|was)?\W{0,3}$"
NOT_CUES = r"(?i)(\b(total|price|isbn|version|page|order|sum|sku|build)\W{0,4}|[$€£#=/_])$"
#: Country calling codes of one to three digits by their first digits, and first digits of payment cards.
CALLING = r"^\+?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARDS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
TLDS = r"\.(com|org|net|edu|gov|io|info|[a-z]{2})$"

LABELERS = ("by_regex", "by_gazetteer", "by_context", "by_shape", "by_neighbour")
EM_ROUNDS = 30
#: The classifier's probability that a span beyond the base ones must reach.
ACCEPT = 0.95
#: Matches that are folded at once; longer lists go in runs, so that a text of many matches takes time in proportion.
RUN = 64
#: Columns of this prefix are the operator's own while it works.
OWN = "_pii_"


def let(value: Column, body) -> Column:
    """body of a value that is computed once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def in_runs(items: Column, start: Column, step, out) -> Column:
    """Folds items in runs of RUN: step(state, item) makes states with a field `out`, an array that a run begins anew."""
    fold = lambda acc, run: let(F.aggregate(run, acc["state"], step), lambda s: F.struct(F.concat(acc["all"], F.array(s["out"])).alias("all"), s.withField("out", out).alias("state")))
    first = F.struct(F.slice(F.array(out), 1, 0).alias("all"), start.alias("state"))

    def of(given: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(given) - 1) / RUN).cast("int")), lambda i: F.slice(given, i * RUN + 1, RUN))
        return F.flatten(F.aggregate(runs, first, fold, lambda acc: acc["all"]))

    return let(items, of)


def find(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches, in code points: matches and what lies between them have the lengths."""
    step = lambda acc, x: F.struct(
        F.when(x["match"].isNull(), acc["out"])
        .otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + F.char_length(x["gap"])).alias("start"), (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["match"])).alias("end"), x["match"].alias("match")))))
        .alias("out"),
        (acc["at"] + F.char_length(x["gap"]) + F.coalesce(F.char_length(x["match"]), F.lit(0))).alias("at"),
    )
    fold = lambda found: in_runs(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match")), F.struct(_none().alias("out"), F.lit(0).alias("at")), step, _none())
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, fold(found)).otherwise(_none()))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, 1).cast("int")
    one = lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), one) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _mod97(match: Column) -> Column:
    """Whether an account number's digits and letters, the first four moved to the end, leave 1 modulo 97."""
    bare = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97)) == 1


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _label(text: Column, kind: str, span: Column) -> Column:
    """The span with the labelers' votes (-1, 0 or 1) and the classifier's features."""
    match = span["match"]
    before = F.substring(text, F.greatest(span["start"] - BEFORE + 1, F.lit(1)), F.least(span["start"], F.lit(BEFORE)))
    after = F.substring(text, span["end"] + 1, 1)
    n = F.length(_digits(match))
    none, yes = F.lit(False), F.lit(True)
    valid = F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)
    tld = F.regexp_replace(F.lower(match), r" ?(\(dot\)|\[dot\]| dot ) ?", ".").rlike(TLDS)
    by_regex = {
        "number": _vote(none, (n >= 13) & ~valid), "iban": _vote(_mod97(match), yes) if kind == "iban" else None,
        "spelled": _vote(tld, yes), "name": _vote(match.rlike(" "), none), "address": F.lit(1),
    }.get(kind, F.lit(1))
    gazetteer = {
        "email": _vote(match.rlike(TLDS), none), "phone": _vote(match.rlike(CALLING), yes), "card": _vote(match.rlike(CARDS), yes), "spelled": _vote(tld, none),
        "number": _vote(valid & match.rlike(CARDS), (n >= 13) & ~match.rlike(CARDS)),
        "iban": _vote(match.rlike("^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"), none),
    }.get(kind, F.lit(0))
    context = _vote(before.rlike(CUES), before.rlike(NOT_CUES))
    shape = {
        "number": _vote(n.between(9, 12) | valid, (n < 8) | (n >= 13)), "iban": _vote(F.length(F.regexp_replace(match, " ", "")).between(15, 34), yes),
        "card": _vote(n.between(13, 19), yes), "phone": _vote(n.between(9, 15), yes), "name": _vote(F.char_length(match).between(4, 40), yes),
    }.get(kind, F.lit(1))
    neighbour = _vote(~(F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}_/]") | after.rlike(r"[\p{L}\p{N}_/]")), yes)
    strict = valid if kind in ("card", "number") else by_regex > 0
    features = F.concat_ws("|", F.lit(kind), context.cast("string"), neighbour.cast("string"), F.least(n, F.lit(20)).cast("string"), strict.cast("string"))
    return F.struct(
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
        by_regex.alias("by_regex"), gazetteer.alias("by_gazetteer"), context.alias("by_context"), shape.alias("by_shape"), neighbour.alias("by_neighbour"), features.alias("features"),
    )


def _test(kind: str):
    return lambda x: _valid(kind, x["match"])


def _labeler(text: Column, kind: str):
    return lambda x: _label(text, kind, x)


def _free(spans: Column, taken: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(taken, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def labeled_spans(docs: DataFrame) -> DataFrame:
    """docs' rows with base and more, under the operator's own names: arrays of spans with votes and features; more holds
    what no base span, and no candidate of an earlier kind, touches."""
    text = F.col("text")
    has_digit, has_at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    searches = {
        "email": (EMAIL, has_at), "ip": (IP, has_digit & F.contains(text, F.lit("."))), "card": (CARD, has_digit), "phone": (PHONE, F.contains(text, F.lit("+"))),
        "iban": (IBAN, has_digit & text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")), "spelled": (SPELLED, F.contains(F.lower(text), F.lit("dot"))), "number": (NUMBER, text.rlike("[0-9](?:[ .()/-]{0,2}[0-9]){6}")),
        "name": (NAME, text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Herr|Frau|Sra|Señora?|Madame|Monsieur)\b|(?i:my name is|je m'appelle|ich heiße|me llamo)")),
        "address": (ADDRESS, has_digit & text.rlike("Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|stra(?:ß|ss)e|gasse|weg|platz|allee|rue|avenue|boulevard|place|Calle|Avenida|Plaza|Paseo")),
    }
    out = docs
    for kind, (pattern, test) in searches.items():
        found = F.when(test, find(text, pattern)).otherwise(_none())
        out = out.withColumn(OWN + kind, F.filter(found, _test(kind)) if kind in BASE_KINDS else found)
    base = F.concat(*(F.transform(OWN + kind, _labeler(text, kind)) for kind in BASE_KINDS))
    out = out.withColumn(OWN + "base", base).withColumn(OWN + "more", F.slice(F.col(OWN + "base"), 1, 0))
    for kind in ("iban", "spelled", "address", "name", "number"):
        new = F.transform(_free(_free(F.col(OWN + kind), F.col(OWN + "base")), F.col(OWN + "more")), _labeler(text, kind))
        out = out.withColumn(OWN + "more", F.when(F.size(OWN + kind) > 0, F.concat(OWN + "more", new)).otherwise(F.col(OWN + "more")))
    return out.drop(*(OWN + kind for kind in searches))


Given = dict[tuple[str, int], tuple[float, float]]


def fit_reliabilities(votes: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> tuple[float, Given]:
    """EM over patterns of votes, one for each labeler, and their counts: the share of personal data, and each vote's
    probability given personal data and given none. There are 3^5 patterns at most, so the driver does it."""
    prior = 0.5
    given = {(l, v): (0.6, 0.2) if v == 1 else (0.1, 0.5) if v == -1 else (0.3, 0.3) for l in LABELERS for v in (-1, 0, 1)}
    for _ in range(rounds if votes else 0):
        got, yes, no = {x: [1.0, 1.0] for x in given}, 0.0, 0.0
        for pattern, n in votes.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(given[x][0] / given[x][1]) for x in zip(LABELERS, pattern))
            p = 1 / (1 + math.exp(-odds))
            yes, no = yes + n * p, no + n * (1 - p)
            for x in zip(LABELERS, pattern):
                got[x][0] += n * p
                got[x][1] += n * (1 - p)
        prior = (yes + 1) / (yes + no + 2)
        given = {x: (y / (yes + 3), z / (no + 3)) for x, (y, z) in got.items()}
    return prior, given


def posterior(prior: float, given: Given, of=F.col) -> Column:
    odds = F.lit(math.log(prior / (1 - prior)))
    for l in LABELERS:
        weight = F.lit(0.0)
        for v in (-1, 0, 1):
            yes, no = given[l, v]
            weight = F.when(of(l) == v, math.log(yes / no)).otherwise(weight)
        odds = odds + weight
    return 1 / (1 + F.exp(-odds))


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Finds personal data in the whole texts of docs (doc_id, text); all other columns of docs are kept as they are.

    Base spans (email, ip, card by Luhn, phone) are leftmost and don't overlap within a kind; all of them stay.
    Candidates that touch no base span are runs of digits, bank accounts, e-mail addresses in words, names after a title and
    street addresses. Labelers (strict forms and check digits, gazetteers of domain endings,
    calling codes, card and country prefixes, context words, shape, neighbouring characters) vote on all spans, EM estimates how
    reliable each is, and its posteriors train a naive-Bayes classifier on the spans' features. The classifier decides:
    a candidate that it gives at least the probability `accept` becomes a span. Adds base and spans: arrays of (kind, start, end),
    code points, end exclusive, by kind and start. A null text counts as empty; repeated rows get equal spans; an empty table gives an
    empty one. The text goes; columns of docs named base or spans give way to the new ones.
    """
    own = [c for c in docs.columns if c not in ("text", "base", "spans")]
    docs = docs.select(*own, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    narrow = written(labeled_spans(docs).drop("text"), "pii-spans")
    spans = narrow.select(F.explode(F.concat(OWN + "base", OWN + "more")).alias("s")).select("s.*")
    patterns = written(spans.groupBy(*LABELERS, "features").agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    votes = patterns.groupBy(*LABELERS).agg(F.sum("n").alias("n")).collect()  # 3^5 rows at most
    prior, given = fit_reliabilities({tuple(r[l] for l in LABELERS): r["n"] for r in votes})
    # the classifier: log odds of each feature value, from soft counts; a feature string has five parts of few values each
    p = posterior(prior, given)
    parts = F.posexplode(F.split("features", r"\|"))
    soft = patterns.select("n", p.alias("p"), parts.alias("at", "value")).groupBy("at", "value").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    totals = patterns.agg(F.sum(F.col("n") * p).alias("yes"), F.sum(F.col("n") * (1 - p)).alias("no")).first()
    yes, no = (totals["yes"] or 0.0) + 1, (totals["no"] or 0.0) + 1
    weights = {(r["at"], r["value"]): math.log((r["yes"] + 0.5) / yes) - math.log((r["no"] + 0.5) / no) for r in soft.collect()}  # under 60 rows
    table_of = F.create_map(*(x for (at, value), w in weights.items() for x in (F.lit(f"{at}|{value}"), F.lit(w)))) if weights else F.expr("map('', 0D)")
    score = lambda s: F.aggregate(
        F.transform(F.split(s["features"], r"\|"), lambda v, i: F.coalesce(F.try_element_at(table_of, F.concat(i.cast("string"), F.lit("|"), v)), F.lit(0.0))), F.lit(math.log(yes / no)), lambda a, b: a + b
    )
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    bar = math.log(accept / (1 - accept))
    order = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    accepted = F.transform(F.array_sort(F.transform(F.filter(OWN + "more", lambda s: score(s) >= bar), order)), slim)
    base = F.transform(OWN + "base", slim)
    return narrow.select(*own, F.concat(base, F.when(F.size(OWN + "more") > 0, accepted).otherwise(F.slice(base, 1, 0))).alias("spans"), base.alias("base"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that touch, the union by the first one's kind."""
    none = F.expr("cast(array() as array<string>)")
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], -s["less"]).alias("at"),
    )

    def masked(given: Column) -> Column:
        ordered = F.array_sort(F.transform(given, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
        pieces = in_runs(ordered, F.struct(none.alias("out"), F.lit(0).alias("at")), step, none)
        rest = F.substring(text, F.array_max(F.transform(given, lambda s: s["end"])) + 1, F.char_length(text))
        return F.when(F.size(given) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))

    return let(spans, masked)


def op2_personal_data(spark, sf_dir):
    found = find_personal_data(with_columns(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"}))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
