"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidate spans come from regular expressions: the base kinds (email, ip, card, phone), which are
always kept, and added kinds (local phone numbers, national ids, names, secrets, service keys, IBANs).
Six labelers vote +1, -1 or 0 on every candidate: format, gazetteer, cue words before it, misleading
words before it, structure of its digits, and its borders. Spark counts the distinct (kind, votes)
patterns; expectation-maximisation over the pattern counts estimates each labeler's reliability and
each kind's share of true spans.

The classifier is trained on the posteriors and sees more than the votes: the candidate's shape, length,
first and last characters, the words before it and the characters around it, hashed into ``FEATURES``
places, so it decides where labelers abstain. It is naive Bayes: Spark sums the posteriors by place, in
whole millionths, so the sums do not depend on order. At most 10 x 3**6 patterns and ``FEATURES`` sums
reach the driver. Added candidates that overlap a base span or that the classifier refuses are dropped.

All matching and scoring is built-in JVM functions. Texts are read once: a match is carried as its gap
to the one before, its value and its neighbourhood. Positions are running sums over a document's
matches, and overlaps come from running extremes, so the work is n log n in the matches of one text.
Quantifiers are possessive wherever a match could not use what they give back: that keeps long texts
linear and needs no stack. Positions are code points, ends exclusive. Null text is empty. Rows are told
apart by a row number, so repeated rows agree.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import Scratch, read, session

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
"""A card is a maximal chain of digits with single separators, so 13 to 19 digits are asked for at once."""

FIRST_NAMES = (
    "Alice", "Andrew", "Antoine", "Barbara", "Camille", "Carlos", "Carmen", "Charles", "Charlotte", "Claire", "Daniel", "David", "Elena", "Elizabeth", "Emily",
    "Franziska", "Friedrich", "George", "Hans", "Heinrich", "Isabel", "James", "Javier", "Jennifer", "John", "Juan", "Jürgen", "Karen", "Klaus", "Laura",
    "Linda", "Lucía", "Luis", "Margaret", "Maria", "Marie", "Mary", "Michael", "Miguel", "Nicolas", "Patricia", "Paul", "Pierre", "Robert", "Sabine",
    "Sarah", "Stefan", "Susan", "Thomas", "Ursula", "William", "Wolfgang",
)
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Madame|Monsieur"

ADDED = {
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}})(?:(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}++|(?:{'|'.join(FIRST_NAMES)})\x20\p{{Lu}}\p{{Ll}}++)",
}
SECRET = r"(?i)(?<![A-Za-z0-9])(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|client[_-]?secret|auth)(?![A-Za-z])[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_./+=~-]{8,}+"
ADDED |= {
    "secret": SECRET,
    "key": r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){3,7}(?:\x20?+[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = (*BASE, *ADDED)
NEEDS = {"email": "@", "phone": "+", "key": r"A[KS]IA|gh[pousr]_|sk-|xox|eyJ", "iban": "[A-Z]{2}[0-9]{2}", "national_id": "[0-9]-[0-9]{2}-[0-9]"}
"""What a text must have at least for a kind; the cheaper search comes first."""
CONTEXT, FEATURES = 40, 1024
CUES = r"(?i)\b(?:tel|phone|call|fax|mobile|mail|e-mail|contact|write|reach|address|ip|host|card|visa|credit|ssn|social|name|named|signed|dear|by|from|telefon|correo|courriel|kontakt)\b[^\n]{0,20}$"
MISLEADING = r"(?i)\b(?:version|release|build|isbn|issn|order|invoice|sku|part|item|chapter|section|rev)\b[^\n]{0,8}$"
LABELERS = ("format", "gazetteer", "cue", "misleading", "structure", "borders")


def located(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<kind,gap,value,before,after>>: the code points since
    the match before, and up to ``CONTEXT`` characters on either side up to the neighbouring matches."""
    pattern = (BASE | ADDED)[kind]
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def row(x: Column) -> Column:
        near = [F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(x["n"], F.lit(CONTEXT)).alias("after")]
        return F.struct(F.lit(KINDS.index(kind)).cast("byte").alias("kind"), F.length(x["p"]).alias("gap"), x["h"].alias("value"), *near)

    zipped = F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    both = F.zip_with(zipped, F.slice(pieces, F.lit(2), F.size(pieces)), lambda x, n: F.struct(x["p"].alias("p"), x["h"].alias("h"), n.alias("n")))
    found = F.transform(F.filter(both, lambda x: x["h"].isNotNull()), row)
    may = F.rlike(text, F.lit(pattern))
    if kind in NEEDS:
        may = F.when(F.rlike(text, F.lit(re.escape(NEEDS[kind]) if kind in BASE else NEEDS[kind])), may).otherwise(False)
    return F.when(may, found).otherwise(F.array().cast("array<struct<kind:byte,gap:int,value:string,before:string,after:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = digits(value)

    def part(i: Column) -> Column:
        x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def octets(value: Column) -> Column:
    def small(p: Column) -> Column:
        n = F.regexp_replace(p, "^0+", "")
        return F.when(F.length(n) > 3, False).otherwise(F.coalesce(F.expr("0") + F.try_to_number(n, F.lit("999")), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def iban_sound(value: Column) -> Column:
    """The check digits of an IBAN: its letters as numbers from 10, the first four characters last, mod 97."""
    v = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    numbers = F.transform(F.split(turned, ""), lambda c: F.when(F.rlike(c, F.lit("[A-Z]")), F.ascii(c) - 55).when(c != "", F.ascii(c) - 48))
    return F.aggregate(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0), lambda a, n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97) == 1


def by_kind(options: dict[str, Column], default: Column) -> Column:
    """The option of the row's kind."""
    out = default
    for k, c in options.items():
        out = F.when(F.col("kind") == KINDS.index(k), c).otherwise(out)
    return out


def sound() -> Column:
    """Whether a candidate passes its kind's check, where it has one."""
    value = F.col("value")
    return by_kind({"ip": octets(value), "card": luhn(value), "phone": F.length(digits(value)).between(9, 15), "iban": iban_sound(value)}, F.lit(True))


def votes() -> Column:
    """The labelers' votes on one candidate, in the order of LABELERS."""
    yes, no, pass_ = F.lit(1), F.lit(-1), F.lit(0)
    value, before, after = F.col("value"), F.col("before"), F.col("after")

    def said(pattern: str, then: Column = yes, otherwise: Column = pass_) -> Column:
        return F.when(F.rlike(value, F.lit(pattern)), then).otherwise(otherwise)

    strict = {
        "email": r"^[A-Za-z][A-Za-z0-9._%+-]*@.*\.[A-Za-z]{2,}$", "ip": r"^(?!0)[0-9]{1,3}\..*[0-9]$", "card": r"^[0-9]{4}([ -]?[0-9]{4}){3}$", "phone": r"^\+[0-9]{1,3}[ (.-]",
        "phone_local": r"^\([0-9]{3}\) [0-9]{3}-|^[0-9]{3}-[0-9]{3}-", "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)", "name": rf"^(?:{TITLES})",
        "secret": r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]", "key": ".", "iban": "^[A-Z]{2}[0-9]{2} ",
    }
    listed = {
        "email": said(r"(?i)@(?:.*\.)?(?:com|org|net|edu|gov|de|fr|es|uk|io)$|\.(?:com|org|net|edu|gov|de|fr|es|uk|io)$"), "ip": said(r"^(?:0|127|255)\.", no), "card": said("^[3-6]", yes, no),
        "name": F.when(F.regexp_extract(value, r"^(\p{L}+)", 1).isin(*FIRST_NAMES), yes).otherwise(pass_),
        "secret": said(r"(?i)(?:example|changeme|placeholder|your[_-]|xxxx|\*\*\*)", no), "key": said("(?i)example", no),
        "iban": said("^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)", yes, no),
    }
    structure = {
        "card": yes, "ip": yes, "phone": F.when(F.length(digits(value)).between(10, 13), yes).otherwise(pass_), "phone_local": said(r"^\(?[01]", no, yes),
        "national_id": said(r"^(?:000|666|9)|-00-|-0000$", no, yes), "secret": said(r"[A-Za-z0-9_./+=~-]{16,}$"), "key": yes, "iban": yes,
    }
    clear = F.rlike(before, F.lit(r"(?:^|[\s,;:(<\[\"'=])$")) & F.rlike(after, F.lit(r"^(?:$|[\s,;:.)>\]\"'!?])"))
    return F.array(
        F.when(F.rlike(value, by_kind({k: F.lit(p) for k, p in strict.items()}, F.lit("$^"))), yes).otherwise(pass_), by_kind(listed, pass_), F.when(F.rlike(before, F.lit(CUES)), yes).otherwise(pass_),
        F.when(F.rlike(before, F.lit(MISLEADING)), no).otherwise(pass_), by_kind(structure, pass_), F.when(clear, yes).otherwise(no),
    )


def features() -> Column:
    """Places of the candidate's features, each hashed with its kind."""
    value, before = F.col("value"), F.col("before")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Lu}++", "A"), r"\p{Ll}++", "a"), "[0-9]", "9"), "9{5,}", "9+")
    words = F.slice(F.regexp_extract_all(F.lower(before), F.lit(r"\p{L}+"), F.lit(0)), -2, 2)
    last = F.regexp_extract(F.lower(before), r"(\p{L}+)\P{L}*$", 1)
    said = F.transform(F.col("votes"), lambda v, i: F.concat(F.lit("v"), i.cast("string"), v.cast("string")))
    plain = [("s", F.substring(shape, 1, 24)), ("n", F.least(F.length(value), F.lit(40)).cast("string")), ("w", last), ("l", F.right(before, F.lit(1))), ("r", F.substring("after", 1, 1)), ("a", F.lower(F.substring(value, 1, 4))), ("z", F.lower(F.right(value, F.lit(3))))]
    named = F.concat(F.array(*[F.concat(F.lit(n), c) for n, c in plain]), said, F.when(F.size(words) == 2, F.array(F.concat(F.lit("u"), words[0]))).otherwise(F.array().cast("array<string>")))
    return F.transform(named, lambda x: F.pmod(F.xxhash64(F.col("kind"), x), F.lit(FEATURES)).cast("int"))


def candidates(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (_row, doc_id, n candidates), and their candidates (_row, kind, start, end, base, free, votes,
    places): ``free`` if no base span overlaps an added one."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = scratch.put(rows.select("_row", "doc_id", F.concat(*[located(text, k) for k in KINDS]).alias("found")), "matches")
    each = table.where(F.size("found") > 0).select("_row", F.posexplode("found").alias("at", "m")).select("_row", "at", "m.*")
    so_far = W.partitionBy("_row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(so_far)).withColumn("start", F.col("end") - F.length("value")).where(sound())
    base = F.col("kind") < len(BASE)
    ahead = W.partitionBy("_row").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("_row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("_last", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(behind))
    clear = F.coalesce(F.col("_last") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))
    each = each.withColumn("free", base | clear).where("free").withColumn("votes", votes()).withColumn("places", features())
    return table, scratch.put(each.select("_row", "kind", "start", "end", "votes", "places"), "candidates")


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], dict[str, float], list[float]]:
    """EM over (kind, votes, count): labelers' reliabilities, kinds' shares, posteriors."""
    kinds = sorted({p[0] for p in patterns})
    right, share = [0.8] * len(LABELERS), dict.fromkeys(kinds, 0.5)
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (kind, vote, _) in enumerate(patterns):
            x = math.log(share[kind] / (1 - share[kind]))
            x += sum(v * math.log(r / (1 - r)) for v, r in zip(vote, right, strict=True))
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
        for k in kinds:
            own = [(p, c) for p, (kind, _, c) in zip(post, patterns, strict=True) if kind == k]
            share[k] = (sum(p * c for p, c in own) + 1) / (sum(c for _, c in own) + 2)
        for j in range(len(LABELERS)):
            said = [(p if vote[j] > 0 else 1 - p, c) for p, (_, vote, c) in zip(post, patterns, strict=True) if vote[j]]
            right[j] = min(0.99, max(0.51, (sum(p * c for p, c in said) + 8) / (sum(c for _, c in said) + 10)))
    return right, share, post


def fit(sums: list[tuple[int, int, int]], total: tuple[int, int], smooth: float = 1e6) -> list[float]:
    """Naive Bayes: the log odds that each place adds to the prior, from (place, millionths of true spans, of
    others). ``smooth`` millionths at the prior's share are added, so rare places add little."""
    yes, no = total[0] + 1, total[1] + 1
    q, out = yes / (yes + no), [0.0] * FEATURES
    for place, a, b in sums:
        out[place] = math.log((a + smooth * q) / (b + smooth * (1 - q))) - math.log(yes / no)
    return out


def learned(found: DataFrame, patterns: list[tuple[str, tuple[int, ...], int]], post: list[float]) -> tuple[list[float], float]:
    """The classifier's weights by place and its prior, trained on the posteriors of all candidates."""
    spark = session(found)
    rows = [(KINDS.index(k), list(v), round(1e6 * p)) for (k, v, _), p in zip(patterns, post, strict=True)]
    table = spark.createDataFrame(rows, "kind byte, votes array<int>, yes long")
    told = found.join(F.broadcast(table), ["kind", "votes"]).withColumn("no", F.lit(1_000_000) - F.col("yes"))
    total = told.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    sums = told.select(F.explode("places").alias("place"), "yes", "no").groupBy("place").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    whole = (total.yes or 0, total.no or 0)
    return fit([(r.place, r.yes, r.no) for r in sums], whole), math.log((whole[0] + 1) / (whole[1] + 1))


def accepted(weights: list[float], prior: float) -> Column:
    """Whether the classifier takes a candidate: the prior and what its places add are positive together."""
    held = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")
    return F.aggregate("places", F.lit(prior), lambda a, i: a + F.get(held, i)) > 0


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) per row: base spans, and all spans that stay, with kind (its number in KINDS),
    start and end, in the order of kinds and starts."""
    scratch = Scratch(session(docs), "pii")
    rows, found = candidates(docs, scratch)
    counted = found.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((KINDS[r.kind], tuple(r.votes), r.n) for r in counted)
    _, _, post = estimate(patterns)
    weights, prior = learned(found, patterns, post)
    stays = found.where((F.col("kind") < len(BASE)) | accepted(weights, prior))
    spans = stays.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<kind:byte,start:bigint,end:bigint>>")
    out = rows.select("_row", "doc_id").join(spans, "_row", "left").withColumn("spans", F.coalesce("spans", none))
    return out.select("doc_id", F.filter("spans", lambda s: s["kind"] < len(BASE)).alias("base"), "spans")


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: ``n_spans``, all spans that stay, and ``personal``, whether there are any."""
    found = find_personal_data(read(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    total = F.size("spans").cast("long")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), total.alias("n_spans"), (total > 0).alias("personal"))
