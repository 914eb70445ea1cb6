"""Personal data and secrets by weak supervision, with DataFrame functions only.

Four patterns give the base spans (email, ip, card, phone), each checked as its kind demands; base spans always stay. Looser patterns
propose more spans (secrets, spelled-out emails, local phone numbers, national ids, account numbers, names). Labelers vote on every
proposal for or against, or abstain: the strict form of its kind, gazetteers of given names, family names and beginnings of keys, cue words
before it, cues against, what stands next to it; they disagree where a form is right and its surroundings are wrong. Proposals with the
same kind, votes and features are one pattern; the counts of patterns, of which there are at most a few thousand whatever the corpus,
train the model: expectation-maximisation estimates each labeler's reliability and each pattern's chance to be personal data, and a naive
Bayes classifier over kind, votes, length and neighbours is fitted to those chances. Proposals it takes are added where they overlap no
base span.

Positions are in code points, end exclusive. What stands before a proposal is read from the end of the proposal before it on. Places of
matches are summed in blocks of BLOCK, so that a text with very many stays cheap. Null texts count as empty. Rows that repeat are searched
as often. Spans of one kind do not overlap; base spans of different kinds may. An empty table gives no rows. Other columns pass through
redact() untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import only, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "spelled_email", "local_phone", "national_id", "account", "name")
#: A run of characters cannot match from within where it did not match from its start, unless another match ended there (\G). What follows
#: a repetition is never one of its characters, so possessive ones match alike, and Java's regex repeats them without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Given and family names that are frequent by public census lists, and beginnings of public key formats.
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Christopher Nancy Daniel Lisa Matthew Margaret Anthony Sandra Mark Ashley Donald Emily Steven Donna Paul Michelle Andrew Carol Joshua Amanda "
    "Hans Peter Klaus Anna Ursula Wolfgang Monika Jean Pierre Marie Jacques Nathalie Isabelle José Antonio Manuel Carmen María Francisco Laura"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Bernard Dubois Durand Moreau Laurent García Fernández López Sánchez Pérez"
).split()
KEYS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "npm_", "hf_")
ADDRESS = "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|M|Sr|Sra)"
_RUN = r"[A-Za-z0-9+/_-]"
LOOSE = {
    "secret": rf"(?<!{_RUN}){_RUN}{{20,}}+={{0,2}}",
    "spelled_email": r"(?i)(?<![\w.+-])[a-z0-9][a-z0-9._+-]{0,63}\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]{1,63}\s?[\[(]\s?dot\s?[\])]\s?[a-z]{2,12}\b",
    "local_phone": r"(?<![0-9+.)-])(?<!\+[0-9]{1,3}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?:{ADDRESS}\.?\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?|(?:{'|'.join(GIVEN)})\x20\p{{Lu}}\p{{Ll}}+)(?!\p{{L}})",
}
#: What a secret's run must hold: letters and digits, 16 of them in a row, and at most one slash: no words joined by hyphens, no paths.
HOLDS, HOLDS_NOT = ("[A-Za-z0-9]{16}", "[0-9]", "[A-Za-z]"), "/[^/]*+/"
GATES = {
    "secret": rf"(?<!{_RUN}){_RUN}{{20}}", "spelled_email": r"(?i)[\[(]\s?at\s?[\])]", "local_phone": "[0-9]{3}[.\\x20-][0-9]{4}", "national_id": "[0-9]-[0-9]{2}-[0-9]", "account": "[A-Z]{2}[0-9]{2}",
    "name": rf"(?<!\p{{L}})(?:{ADDRESS}\.?|{'|'.join(GIVEN)})\x20\p{{Lu}}",
}
#: The strict form of each added kind.
FORMS = {
    "secret": rf"^(?:[0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}}|(?:{'|'.join(map(re.escape, KEYS))}).*)$", "spelled_email": r"(?i)(?:com|org|net|edu|de|fr|es|uk)$", "local_phone": r"^\([2-9]|^[2-9][0-9]{2}[.-]",
    "national_id": "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "account": r"^(?:DE[0-9\x20]{20,25}|FR|ES|GB|IT|NL|AT|CH)", "name": r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
}
GAZETTEER = rf"(?:^|(?<!\p{{L}}))(?:{'|'.join((*GIVEN, *FAMILY))})(?!\p{{L}})|^(?:{'|'.join(map(re.escape, KEYS))})|555"
CUES = r"(?i)(?:e-?mail|mail|contact|kontakt|tel|phone|call|fax|mobile|ssn|social|iban|account|konto|compte|cuenta|name|dear|by|von|from|token|secret|key|password|passwd|pwd|auth|credentials?)[\"']?\s{0,2}[=:]{0,2}\W{0,3}$"
AGAINST = r"(?i)(?:order|invoice|isbn|version|ref|no|nr|#|id|page|chapter|commit|sha1?|md5|hash|https?:[^\s]*|/)\W{0,3}$"
LABELERS = ("form", "gazetteer", "cue", "against", "apart")
NEAR, BLOCK = 24, 64
START = {"form": 0.8, "gazetteer": 0.7, "cue": 0.75, "against": 0.75, "apart": 0.6}
THRESHOLD = 0.5
#: Proposals' worth of weight with which the classifier's values are drawn to their share among all.
DRAWN = 4.0
SPAN = "struct<kind:int,start:int,end:int,value:string,before:string,after:string>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: Spark puts an expression wherever its name stands, within loops too."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str, gate: Column, kind: int) -> Column:
    """The matches of a pattern with their places and what stands before and after them: gaps and matches alternate, so places are running
    sums of their lengths, over blocks and then within each."""
    found = F.transform(F.array(text), lambda t: F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("gaps")))[0]

    def placed(block: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<struct<start:int,i:int>>").alias("out"))
        return F.aggregate(block, begin, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["i"].alias("i")))).alias("out")), lambda acc: acc["out"])

    def starts(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def listed(f: Column) -> Column:
        def span(x: Column) -> Column:
            value = F.get(f["m"], x["i"])
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), value.alias("value"), F.right(F.get(f["gaps"], x["i"]), F.lit(NEAR)).alias("before"), F.left(F.get(f["gaps"], x["i"] + 1), F.lit(1)).alias("after"))

        pair = F.transform(f["m"], lambda m, i: F.struct(F.length(F.get(f["gaps"], i)).alias("gap"), F.length(m).alias("len"), i.alias("i")))
        parted = _bound(pair, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK))))
        at = _bound(parted, lambda blocks: F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts(blocks).alias("s")), lambda z: placed(z["b"], z["s"]))))
        return F.transform(at, span)

    spans = F.transform(F.array(found), lambda f: F.when(F.size(f["m"]) > 0, listed(f)).otherwise(F.array().cast(f"array<{SPAN}>")))[0]
    return F.when(gate, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(F.transform(doubled, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind as BASE lists them, then by start."""
    digit = text.rlike("[0-9]")

    def digits(value: Column) -> Column:
        return F.regexp_replace(value, "[^0-9]", "")

    email = _matches(text, EMAIL, F.contains(text, F.lit("@")), 0)
    ip = F.filter(_matches(text, IP, digit, 1), lambda s: s["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
    card = F.filter(_matches(text, CARD, digit, 2), lambda s: _luhn(digits(s["value"])))
    phone = F.filter(_matches(text, PHONE, F.contains(text, F.lit("+")), 3), lambda s: F.length(digits(s["value"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def proposals(text: Column, base: Column) -> Column:
    """Spans of the looser patterns that overlap no base span."""
    each = [_matches(text, LOOSE[k], text.rlike(GATES[k]), len(BASE) + i) for i, k in enumerate(ADDED)]
    each[0] = F.filter(each[0], lambda s: reduce(Column.__and__, (s["value"].rlike(p) for p in HOLDS), ~s["value"].rlike(HOLDS_NOT)))
    loose = F.concat(*each)
    return _bound(base, lambda held: F.filter(loose, lambda s: ~F.exists(held, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def _described(span: Column) -> Column:
    """The pattern of a proposal: kind, one vote (1, -1, 0) of each labeler, length class, kinds of the neighbouring characters."""
    before, after = span["before"], span["after"]
    kind = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)
    strict = F.coalesce(*[F.when(span["kind"] == len(BASE) + i, span["value"].rlike(FORMS[k])) for i, k in enumerate(ADDED)])
    votes = [
        F.when(strict, 1).when(F.length(span["value"]) > 80, -1).otherwise(0),
        F.when(span["value"].rlike(GAZETTEER), 1).otherwise(0),
        F.when(before.rlike(CUES), 1).otherwise(0),
        F.when(before.rlike(AGAINST), -1).otherwise(0),
        F.when((kind(after) == 2) | before.rlike(r"[\p{L}\p{N}/=&?]$"), -1).otherwise(1),
    ]
    return F.struct(span["kind"].alias("kind"), *[v.alias(n) for v, n in zip(votes, LABELERS, strict=True)], F.least(F.lit(3), F.floor(F.length(span["value"]) / 12)).cast("int").alias("length"), kind(F.right(before, F.lit(1))).alias("left"), kind(after).alias("right"))


FIELDS = ("kind", *LABELERS, "length", "left", "right")


def learn(patterns: dict[tuple[int, ...], int], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """The classifier's chance for each pattern (FIELDS), from how often each occurs."""
    if not patterns:
        return {}
    right, prior = dict(START), 0.3
    chance: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for name, vote in zip(LABELERS, p[1 : 1 + len(LABELERS)], strict=True):
                odds += vote * math.log(right[name] / (1 - right[name]))
            chance[p] = 1 / (1 + math.exp(-odds))
        total = sum(patterns.values())
        prior = min(0.95, max(0.05, (sum(chance[p] * n for p, n in patterns.items()) + 1.5) / (total + 5)))
        for i, name in enumerate(LABELERS):
            cast = [(chance[p] if p[1 + i] > 0 else 1 - chance[p], n) for p, n in patterns.items() if p[1 + i]]
            right[name] = min(0.97, max(0.52, (sum(c * n for c, n in cast) + 10 * START[name]) / (sum(n for _, n in cast) + 10)))
    # the span classifier: each field's values weighed by the chances just found, drawn to the value's share among all proposals
    yes = sum(chance[p] * n for p, n in patterns.items())
    no = total - yes
    weight: dict[tuple[int, int], list[float]] = {}
    for p, n in patterns.items():
        for at, value in enumerate(p):
            w = weight.setdefault((at, value), [0.0, 0.0])
            w[0] += chance[p] * n
            w[1] += (1 - chance[p]) * n

    def odds(at: int, value: int) -> float:
        a, b = weight[at, value]
        share = DRAWN * (a + b) / total
        return math.log((a + share) / (yes + DRAWN)) - math.log((b + share) / (no + DRAWN))

    start = math.log((yes + 1) / (no + 1))
    return {p: 1 / (1 + math.exp(-max(-30, min(30, start + sum(odds(at, v) for at, v in enumerate(p)))))) for p in patterns}


def found(docs: DataFrame) -> DataFrame:
    """docs with base and spans (base and added), arrays of (kind, start, end, value)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.withColumn("base", base_spans(text)).withColumn("more", proposals(text, F.col("base")))
    described = F.transform("more", _described)
    counts = seen.where(F.size("more") > 0).select(F.explode(described).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    taken = [p for p, c in learn({tuple(r["p"]): r["n"] for r in counts}).items() if c >= THRESHOLD]
    if not taken:
        return seen.withColumn("spans", F.col("base")).drop("more")
    good = F.array(*[F.lit(".".join(map(str, p))) for p in sorted(taken)])
    kept = F.filter("more", lambda s: F.array_contains(good, F.transform(F.array(_described(s)), lambda d: F.concat_ws(".", *[d[f].cast("string") for f in FIELDS]))[0]))
    return seen.withColumn("spans", F.when(F.size("more") > 0, F.concat("base", kept)).otherwise(F.col("base"))).drop("more")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*BASE, *ADDED)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs, every span of the text replaced by its kind in angle brackets; overlapping spans by the first's."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in (*BASE, *ADDED)])
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    seen = found(inner)
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.element_at(names, s["kind"] + 1)).alias("out")))

    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    done = seen.select("row", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("clean"))
    return done.select(*[F.col("clean").alias(c) if c == "text" else (F.coalesce(F.length("clean"), F.col("row.n_chars").cast("int")).cast("bigint").alias(c) if c == "n_chars" else F.col(f"row.`{c}`")) for c in docs.columns])


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = found(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(BASE)]
    whole = [F.size("spans").cast("bigint").alias("n_spans")]
    return seen.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *whole)
