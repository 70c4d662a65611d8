"""Personal data by weak supervision, in native functions alone.

Regular expressions propose candidate spans. Five labelers vote on each (1 personal, 0 not, null: no opinion): a strict
form of the kind's pattern, a gazetteer of known values, a check of its make-up (checksum, variety of characters), cue
words in the context on both sides, and the span's edges. Expectation-maximisation over the table of vote patterns,
whose size the labelers bound, estimates each labeler's reliability for each kind. The posteriors then train the final
span classifier, a naive Bayes model over bounded features of the span and its neighbours, votes not among them. Spans
of the base kinds (email, ip, card, phone) always stay; the classifier decides on all others.

Each text is scanned once for each kind whose trigger it has: matches are marked and the text is split at the marks, so
places are running sums of lengths in code points. A text's own mark characters are replaced before, one for one.

Defined cases: a null text counts as an empty one. Null and repeated ids are rows like others. Extra columns are
ignored. Without candidates all counts are 0 and span lists empty; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let, settle, text_or_empty


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    trigger: str
    strict: str
    cues: str
    against: str = r"(?i)(?:version|release|section|chapter|figure)\W*$"
    #: What a candidate is worth before any vote: most patterns are specific, one is not.
    lean: float = 0.75


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_NAMED = r"password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key"
#: Fixed values that the gazetteer labeler knows: given names, public suffixes, calling codes, countries with IBANs,
#: numbers printed as examples, and words that stand for a secret.
GIVEN_NAMES = (
    "Adam Alice Andrea Anna Antonio Barbara Carlos Carmen Charles Christopher Claire Daniel David Elena Elizabeth Emma Francisco Greta Hans Isabel James Jan Jean "
    "Jennifer Jessica John Jose Joseph Juan Julia Karen Karl Katarzyna Laura Linda Lucia Manuel Marco Maria Marie Mark Mary Matthew Michael Nancy Patricia Paul "
    "Peter Pierre Piotr Richard Robert Sarah Sofia Stephen Susan Thomas Ursula William"
).split()
SUFFIXES = (
    "ai app at au be biz br ca ch cn co com cz de dev dk edu es eu fi fr gov gr hu ie in info int io it jp kr mil mx net nl no nz online org pl pt ro ru se sg "
    "shop site sk tr tw ua uk us xyz za"
).split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 65 81 82 86 90 91 351 352 353 354 356 358 359 370 371 372 380 385 386 420 421".split()
IBAN_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO RS SE SI SK SM TR UA".split()
EXAMPLES = "4111111111111111 5555555555554444 378282246310005 6011111111111117 078-05-1120 219-09-9999".split()
PLACEHOLDERS = "changeme|example|placeholder|password|secret|test|dummy|xxxx|your|none|null|0000|1234"

#: Candidate patterns. Possessive quantifiers and look-behind keep each scan linear; they change no match.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$", r"(?i)(?:mail|contact|write|from|to|at)\W*$"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"^(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$", r"(?i)(?:ip|host|server|address|from)\W*$"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", r"^[3-6][0-9]{3}[\x20-]?[0-9]{4,6}[\x20-]?[0-9]{4,5}[\x20-]?[0-9]{0,4}$", r"(?i)(?:card|visa|account|pay|number)\W*$"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"^\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}$", r"(?i)(?:phone|tel|call|mobile|fax|at)\W*$"),
)
MORE = (
    Kind("secret", rf"(?<=(?i:{_NAMED})[\x20]{{0,2}}[=:][\x20]{{0,2}}[\"']{{0,1}})[A-Za-z0-9+/_=-]{{12,}}+", rf"(?i)(?:{_NAMED})[\x20]{{0,2}}[=:]", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]{16,}$", rf"(?i)(?:{_NAMED})\W*$"),
    Kind("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", r"AKIA|ASIA", r"^A[KS]IA(?=.*[0-9])[0-9A-Z]{16}$", r"(?i)(?:key|id|aws)\W*$"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"(?i)(?:ssn|social|security)\W*(?:number\W*)?$"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,38}$", r"(?i)(?:iban|account|bank|konto)\W*$"),
    Kind("name", r"(?<![\p{L}])(?!(?:Mr|Mrs|Ms|Dr|Dear|From|By|To|The)\x20)\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}++(?![\p{L}])", r"\p{Ll}\x20\p{Lu}\p{Ll}", r"^\p{Lu}\p{Ll}{1,14}\x20\p{Lu}\p{Ll}{2,14}$", r"(?i)\b(?:mr|mrs|ms|dr|dear|name|by|from)\W*$", lean=0.1),
)
KINDS = BASE + MORE
CONTEXT = 40
#: Marks a match; a private character, so no pattern has it.
MARK, STAND_IN = "\uE000", "\uFFFD"


def _parts(text: Column, kind: Kind) -> Column:
    """Numbered (gap, left, hit, right) of each match, in order; null without the trigger. Gap: characters before it."""

    def cut(parts: Column) -> Column:
        def one(i: Column) -> Column:
            gap, hit, after = (F.get(parts, 2 * i + k) for k in (0, 1, 2))
            span = (F.lit(kind.name).alias("kind"), F.length(gap).alias("gap"), F.substring(gap, -CONTEXT, CONTEXT).alias("left"), hit.alias("hit"))
            return F.struct(i.cast("int").alias("n"), F.struct(*span, F.substring(after, 1, CONTEXT).alias("right")).alias("x"))

        hits = ((F.size(parts) - 1) / 2).cast("int")
        return F.when(hits > 0, F.transform(F.sequence(F.lit(0), hits - 1), one))

    marked = F.split(F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(text.rlike(kind.trigger), let(marked, cut))


def _valid() -> Column:
    digits = F.length(F.regexp_replace("hit", "[^0-9]", ""))
    luhn = F.call_function("luhn_check", F.regexp_replace("hit", "[^0-9]", ""))
    return (
        F.when(F.col("kind") == "ip", F.col("hit").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(F.col("kind") == "card", digits.between(14, 19) & luhn)
        .when(F.col("kind") == "phone", digits.between(10, 15))
        .otherwise(True)
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Settled candidate spans (uid, id, kind, start, end, hit, left, right); a row without kind for each document."""
    text = F.translate(text_or_empty(text_col), MARK, STAND_IN)
    none = F.array(F.lit(None).cast("struct<n:int,x:struct<kind:string,gap:int,left:string,hit:string,right:string>>"))
    found = F.concat(none, *[F.coalesce(_parts(text, k), F.slice(none, 1, 0)) for k in KINDS])
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), found.alias("found"))
    rows = settle(rows.select("uid", "id", F.explode("found").alias("f")).select("uid", "id", "f.n", "f.x.*"), "matches")
    so_far = Window.partitionBy("uid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.filter("kind is not null").withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(so_far)).withColumn("start", F.col("end") - F.length("hit"))
    placed = placed.filter(_valid()).select("uid", "id", "kind", "start", "end", "hit", "left", "right")
    return settle(placed.unionByName(rows.filter("kind is null").select("uid", "id"), allowMissingColumns=True), "spans")


def votes() -> dict[str, Column]:
    """The labelers: each votes 1, 0 or null on a candidate span."""
    hit, left, right, kind = F.col("hit"), F.col("left"), F.col("right"), F.col("kind")

    def by_kind(of) -> Column:
        out = F.lit(None).cast("int")
        for k in KINDS:
            out = F.when(kind == k.name, of(k)).otherwise(out)
        return out

    suffix = F.lower(F.regexp_extract(hit, r"\.([A-Za-z]+)$", 1))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    known = lambda c: F.when(c, 1).otherwise(0)
    against = lambda c: F.when(c, 0)
    gazetteer = (
        F.when(kind == "email", known(suffix.isin(*SUFFIXES)))
        .when(kind == "ip", known(~hit.rlike(r"^0*(?:0|10|127|255|169\.254|192\.168|198\.51\.100|203\.0\.113)\.")))
        .when(kind == "card", known(hit.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)") & ~digits.isin(*EXAMPLES)))
        .when(kind == "phone", known(hit.rlike(rf"^\+(?:{'|'.join(CALLING)})")))
        .when(kind == "secret", against(hit.rlike(rf"(?i){PLACEHOLDERS}")))
        .when(kind == "key", against(hit.contains("EXAMPLE")))
        .when(kind == "ssn", against(hit.isin(*EXAMPLES)))
        .when(kind == "iban", known(F.substring(hit, 1, 2).isin(*IBAN_COUNTRIES)))
        .when(kind == "name", known(F.split(hit, " ")[0].isin(*GIVEN_NAMES)))
    )
    variety = F.size(F.array_distinct(F.split(hit, "")))
    check = (
        F.when(kind == "email", known(hit.rlike(r"^[^@]{1,64}@[^@]{3,253}$") & ~hit.contains("..")))
        .when(kind == "phone", known(F.length(digits).between(10, 13)))
        .when(kind.isin("secret", "key"), known((variety >= 8) & hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")))
        .when(kind == "ssn", known(F.size(F.array_distinct(F.split(digits, ""))) > 2))
        .when(kind == "iban", known(_mod_97(hit) == 1))
        .when(kind == "card", known(variety > 3))
    )

    def context(k: Kind) -> Column:
        """Cues before or behind; a pair of capitalised words without one is no name, other kinds need none."""
        behind = r"(?i)^\W*" + k.cues.removeprefix("(?i)").removesuffix(r"\W*$") + r"\b"
        found = F.when(left.rlike(k.cues) | right.rlike(behind), 1).when(left.rlike(k.against), 0)
        return found.otherwise(0) if k.name == "name" else found

    joined = left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]")
    return {
        "pattern": by_kind(lambda k: known(hit.rlike(k.strict))),
        "gazetteer": gazetteer,
        "check": check,
        "context": by_kind(context),
        "edges": F.when(joined, 0).otherwise(1),
    }


def _mod_97(account: Column) -> Column:
    """The remainder of an IBAN's check: its first four characters go last, and A-Z count 10 to 35."""
    plain = F.upper(F.regexp_replace(account, "[^A-Za-z0-9]", ""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter < 10, (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step)


def reliabilities(patterns: list[tuple[tuple, int]], turns: int = 30, lean: float = 0.75) -> tuple[float, list[tuple[float, float]], dict[tuple, float]]:
    """Expectation-maximisation over (votes, count): the share of true spans, each labeler's chances to vote 1 on a true
    and on a false span, and each vote pattern's posterior.

    Starts from ``lean`` and the votes' deviations from each labeler's mean, so one that always says the same says nothing.
    """
    width = len(patterns[0][0])
    mean = []
    for j in range(width):
        cast = [(v[j], n) for v, n in patterns if v[j] is not None]
        mean.append(sum(x * n for x, n in cast) / max(sum(n for _, n in cast), 1))
    post = {}
    for v, _ in patterns:
        off = [x - m for x, m in zip(v, mean) if x is not None]
        post[v] = min(0.95, max(0.05, lean + sum(off) / max(len(off), 1)))
    for _ in range(turns):
        true, false = sum(n * post[v] for v, n in patterns), sum(n * (1 - post[v]) for v, n in patterns)
        prior, rates = (true + 1) / (true + false + 2), []
        for j in range(width):
            seen = [(v[j], n, post[v]) for v, n in patterns if v[j] is not None]
            yes = (sum(n * p for x, n, p in seen if x) + 4) / (sum(n * p for _, n, p in seen) + 5)
            wrong = (sum(n * (1 - p) for x, n, p in seen if x) + 1) / (sum(n * (1 - p) for _, n, p in seen) + 5)
            rates.append((yes, wrong))
        for v, _ in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for x, (yes, wrong) in zip(v, rates):
                if x is not None:
                    a, b = a + math.log(yes if x else 1 - yes), b + math.log(wrong if x else 1 - wrong)
            post[v] = 1 / (1 + math.exp(min(50, b - a)))
    return prior, rates, post


def _features() -> Column:
    """Bounded features of a span: its length, make-up and neighbours. The labelers' votes are none of them."""
    hit, n = F.col("hit"), F.length("hit")
    bucket = lambda c: F.least(F.floor(c), F.lit(9)).cast("string")
    shape = F.concat_ws("", *[F.when(hit.rlike(p), n_).otherwise("-") for n_, p in (("d", "[0-9]"), ("u", "[A-Z]"), ("l", "[a-z]"), ("s", r"[^A-Za-z0-9]"))])
    digits = bucket(10 * (n - F.length(F.regexp_replace(hit, "[0-9]", ""))) / n)
    marks = bucket(F.length(F.regexp_replace(hit, r"[\p{L}\p{N}]", "")))
    word = F.lower(F.regexp_extract("left", r"([\p{L}\p{N}_]+)\W*$", 1))
    side = lambda c: F.when(c == "", "none").when(c.rlike(r"^\s"), "space").when(c.rlike(r"^[\p{L}\p{N}_]"), "word").otherwise("mark")
    found = {
        "size": bucket(F.log2(n + 1)), "shape": shape, "digits": digits, "marks": marks, "word": F.pmod(F.xxhash64(word), F.lit(256)).cast("string"),
        "before": side(F.substring("left", -1, 1)), "after": side(F.substring("right", 1, 1)),
    }
    return F.transform(F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in found.items()]), lambda f: F.concat(F.col("kind"), F.lit(":"), f))


def classify(spans: DataFrame) -> tuple[DataFrame, dict]:
    """Candidate spans with ``probability`` of being personal data, and the labelers' estimated reliabilities."""
    names = list(votes())
    voted = spans.select("*", *[v.cast("int").alias(f"vote_{n}") for n, v in votes().items()])
    columns = [f"vote_{n}" for n in names]
    table = defaultdict(list)
    for r in voted.groupBy("kind", *columns).count().collect():  # at most kinds * 3 ** labelers rows
        table[r["kind"]].append((tuple(r[c] for c in columns), r["count"]))
    if not table:
        return voted.withColumn("probability", F.lit(0.0)), {}
    lean = {k.name: k.lean for k in KINDS}
    learned = {kind: reliabilities(sorted(rows, key=str), lean=lean[kind]) for kind, rows in sorted(table.items())}
    posts = [(":".join([kind, *["?" if x is None else str(x) for x in v]]), float(p)) for kind, (_, _, post) in learned.items() for v, p in post.items()]
    posterior = F.create_map(*[F.lit(x) for pair in posts for x in pair])
    key = F.concat_ws(":", "kind", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns])
    soft = voted.withColumn("features", _features()).withColumn("posterior", F.element_at(posterior, key))
    rows = soft.select("posterior", F.explode("features").alias("f")).groupBy("f").agg(F.sum("posterior").alias("p"), F.count("*").alias("n")).collect()
    total, kinds = defaultdict(lambda: [0.0, 0.0]), {}
    for r in rows:
        if ":size=" in r["f"]:
            kind = r["f"].split(":", 1)[0]
            total[kind][0] += r["p"]
            total[kind][1] += r["n"] - r["p"]
    for kind, (true, false) in total.items():
        kinds[kind] = math.log((true + 1) / (false + 1))
    weight = {}
    for r in rows:
        true, false = total[r["f"].split(":", 1)[0]]
        weight[r["f"]] = math.log((r["p"] + 1) / (true + 2)) - math.log((r["n"] - r["p"] + 1) / (false + 2))
    odds = F.lit(0.0)
    for kind, prior in sorted(kinds.items()):  # a map of its own for each kind, as Spark looks through a map one by one
        of = F.create_map(*[F.lit(x) for f, w in sorted(weight.items()) if f.startswith(f"{kind}:") for x in (f, w)])
        odds = F.when(F.col("kind") == kind, _summed(of, prior)).otherwise(odds)
    scored = soft.withColumn("probability", 1 / (1 + F.exp(-odds))).select(*voted.columns, "probability")
    return scored, {k: {"prior": v[0], **dict(zip(names, v[1]))} for k, v in learned.items()}


def _summed(of: Column, prior: float) -> Column:
    """The prior's and all features' log-odds."""
    return F.aggregate("features", F.lit(prior), lambda a, f: a + F.coalesce(F.element_at(of, f), F.lit(0.0)))


def find(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (uid, id, spans, extra). Both are arrays of (start, place, kind, end) in order of start, then
    kind as listed in ``KINDS``: those of base kinds, and all."""
    spans = candidates(docs, id_col, text_col)
    scored, _ = classify(spans.filter("kind is not null"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k.name, i)])
    base = F.col("kind").isin(*[k.name for k in BASE])
    kept = scored.filter(base | (F.col("probability") >= least)).select("uid", "id", F.struct("start", F.element_at(order, F.col("kind")).alias("place"), "kind", "end").alias("span"))
    whole = kept.unionByName(spans.filter("kind is null").select("uid", "id"), allowMissingColumns=True)
    found = whole.groupBy("uid").agg(F.first("id").alias("id"), F.sort_array(F.collect_list("span")).alias("spans"))
    return found.withColumn("base", F.filter("spans", lambda s: s["place"] < len(BASE)))


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
