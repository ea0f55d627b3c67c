"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from regular expressions: the base patterns, and looser ones (mail addresses in disguise,
national phone numbers, the head of a phone match that ran on too far, long tokens). Five labelers vote on each
candidate: shape (regex), lists of known endings, prefixes and reserved values (gazetteer), the words before it
(context), the variety of its characters, and a check that can only speak against it. One aggregation counts the
vote patterns of the whole corpus; expectation-maximisation over these few patterns, started and steadied by
prior reliabilities, estimates how far every labeler can be trusted. A span classifier (logistic regression
over votes, length and surroundings, drawn to the labelers' log-odds) is then trained on the candidates that
the estimate is sure of, and compiled back into an expression.

Base spans that pass their checks are always kept, and are known positives to the estimate. Every other
candidate, of any kind, is the classifier's to accept or reject.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

#: Kinds in the order in which spans with one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret")

# The patterns find exactly the leftmost non-overlapping greedy matches, in linear time: a match can only
# begin where a run of its characters begins (or where the match before it ended), and runs are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_@-])",
}
#: Candidates that are no base matches. None can overlap a base match of its kind.
LOOSER = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?=[(02-9])(?<![0-9+.(-])(?<![0-9][\x20)])(?<!\+[0-9]{1,3}[\x20.-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4}|\([2-9][0-9]{2}\)|[2-9][0-9]{2})[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9.-])(?!\x20[0-9])",
}
#: The head of a base phone match that has too many digits.
_PHONE_HEAD = r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?=[\x20.-])"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CONTEXT = 24

# Gazetteers and context words: fixed values.
_ENDINGS = r"(?i)(?:\.|[\])]\x20?)(?:com|net|org|edu|gov|int|info|biz|io|co|uk|de|fr|es|it|nl|eu|us|ca|au|in|jp|cn|ru|br)$"
_CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
_CONTEXTS = {
    "email": r"(?i)(?:mail|contact|write|reach|@|:)\W*(?:to|at|me|us)?\W*$",
    "ip": r"(?i)(?:\bip|host|addr|address|server|from)\W*$",
    "card": r"(?i)(?:card|visa|pay|number|no\.?)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|reach)\W*(?:me|us|at|on)?\W*$",
    "secret": r"(?i)(?:token|secret|key|password|passwd|pwd|bearer|auth)[\"']?\s*[=:]?\s*[\"']?$",
}
_CONTRARY = {
    "email": r"(?!)",
    "ip": r"(?i)(?:version|release|section|chapter|v)\W*$",
    "card": r"(?i)(?:id|isbn|serial|order|invoice|item)\W*$",
    "phone": r"(?i)(?:id|isbn|serial|order|invoice|item|page|year)\W*$",
    "secret": r"(?i)(?:commit|sha-?[0-9]*|md5|hash|checksum|digest|revision|etag|uuid|id|//|/)[\"']?\s*[=:]?\s*[\"']?$|[^=:\"'\s]$",
}
#: Labelers in the order of their votes.
LABELERS = ("shape", "gazetteer", "context", "variety", "check")
# Prior chances of the votes (-1, 0, 1) on personal and other spans, what they weigh in rows, and the prior share
# of personal spans: fixed values.
_PRIOR_YES = {"shape": (0.1, 0.3, 0.6), "gazetteer": (0.1, 0.5, 0.4), "context": (0.05, 0.25, 0.7), "variety": (0.1, 0.3, 0.6), "check": (0.02, 0.98, 0.0)}
_PRIOR_NO = {"shape": (0.4, 0.3, 0.3), "gazetteer": (0.3, 0.5, 0.2), "context": (0.25, 0.7, 0.05), "variety": (0.3, 0.3, 0.4), "check": (0.6, 0.4, 0.0)}
_PRIOR_ROWS, _PRIOR_SHARE = 10.0, 0.3
#: Candidates that the estimate is this sure of train the classifier.
SURE = 0.8

#: Elements of an array that are joined at once.
_BLOCK = 128


def _each_block(x: Column, body) -> Column:
    """``body`` of the array's blocks of ``_BLOCK`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: body(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))


def running(x: Column, join, zero: int) -> Column:
    """For every element what ``join`` makes of all elements before it (sums or maxima). An array can only be
    grown by copying it, so this is done in blocks and then over the blocks' totals: the copying stays below the
    other work up to some millions of elements."""

    def flat(y: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(y, start, lambda a, v: F.struct(join(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def blockwise(y: Column) -> Column:
        totals = _each_block(y, lambda b: F.aggregate(b, F.lit(zero), join))
        return F.flatten(F.zip_with(_each_block(y, flat), flat(totals), lambda own, before: F.transform(own, lambda v: join(before, v))))

    return let(x, lambda y: F.when(F.size(y) <= _BLOCK, flat(y)).otherwise(blockwise(y)))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


_ROW = "array<struct<k:int,m:string,n:int,gap:int,before:string>>"


def _pieces(text: Column, k: int, pattern: str, hint: Column | None = None) -> Column:
    """One pattern's matches, each with the length of the gap before it and the characters before it (as far as
    the match before it). A last row without a match takes the place back to the text's beginning."""

    def rows(pair: Column) -> Column:
        m = pair["m"]
        gapped = F.zip_with(m, F.slice(pair["gaps"], F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), b.alias("gap")))
        before = F.concat(F.array(F.lit("")), F.slice(m, F.lit(1), F.size(m) - 1))
        tail = lambda c: F.right(c, F.lit(_CONTEXT))
        each = F.zip_with(gapped, before, lambda x, b: F.struct(F.lit(k).alias("k"), x["m"].alias("m"), F.length(x["m"]).alias("n"), F.length(x["gap"]).alias("gap"), tail(F.concat(tail(b), tail(x["gap"]))).alias("before")))
        back = F.struct(F.lit(k).alias("k"), F.lit(None).cast("string").alias("m"), (-F.length(text)).alias("n"), F.length(F.element_at(pair["gaps"], -1)).alias("gap"), F.lit("").alias("before"))
        return F.concat(each, F.array(back))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    there = text.rlike(pattern)
    return F.when(there if hint is None else hint & there, let(pair, rows)).otherwise(F.array().cast(_ROW))


def spans(text: Column) -> Column:
    """``array<struct<k, start, end, match, before>>``: the matches of all patterns in code points. The lengths
    of the pieces between matches give the places; no part of the text is looked for from its beginning."""
    has = lambda sign: F.instr(text, sign) > 0
    hints = {0: has("@"), 1: has("."), 3: has("+")}
    looser = {"email": has("at)") | has("at]") | has("AT)") | has("AT]"), "phone": None}
    every = [_pieces(text, k, PATTERNS[kind], hints.get(k)) for k, kind in enumerate(KINDS)]
    every += [_pieces(text, len(KINDS) + KINDS.index(kind), LOOSER[kind], looser[kind]) for kind in LOOSER]

    def located(r: Column) -> Column:
        places = running(F.transform(r, lambda x: x["gap"] + x["n"]), _add, 0)
        found = F.zip_with(r, places, lambda x, at: F.struct(x["k"].alias("k"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["m"].alias("match"), x["before"].alias("before")))
        return F.filter(found, lambda x: x["match"].isNotNull())

    none = F.array().cast("array<struct<k:int,start:int,end:int,match:string,before:string>>")
    return let(F.concat(*every), lambda r: F.when(F.size(r) > 0, located(r)).otherwise(none))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def weigh(r: Column) -> Column:
        doubled = lambda i: F.substr(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        total = F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
        return total % 10 == 0

    return F.when(F.length(number) > 0, let(F.reverse(number), weigh)).otherwise(F.lit(False))


def passes(kind: str, match: Column) -> Column:
    """The base check of a kind; kinds that are not base have none to pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def labels(kind: str, match: Column, before: Column, base: Column) -> list[Column]:
    """Votes (1 personal, -1 not, 0 none) of the labelers on a candidate. Only the check knows the base check's
    answer, and it never speaks for a span."""
    number, never = digits(match), F.lit(False)
    size = F.length(F.regexp_replace(F.array_join(F.array_distinct(F.split(F.lower(F.left(match, F.lit(64))), "")), ""), r"[^0-9a-z]", ""))
    context = _vote(before.rlike(_CONTEXTS[kind]), before.rlike(_CONTRARY[kind]))
    check = F.when(base, 0).otherwise(-1)
    if kind == "email":
        alphabetic = match.rlike(r"[.\])]\x20?[A-Za-z]{2,}$")
        return [_vote(alphabetic, ~alphabetic), _vote(match.rlike(_ENDINGS), never), context, _vote(size >= 6, size < 4), F.lit(0)]
    if kind == "ip":
        return [_vote(match.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), match.rlike(r"(?:^|\.)0[0-9]|[0-9]{4}")), _vote(never, match.rlike(r"^(?:0\.|127\.|255\.)")), context, _vote(size >= 3, size < 2), check]
    if kind == "card":
        grouped = match.rlike(r"^(?:[0-9]{13,16}|[0-9]{19}|[0-9]{4}(?:([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|([\x20-])[0-9]{6}\2[0-9]{5}))$")
        return [_vote(grouped, match.rlike("[\\x20-]") & ~grouped), _vote(number.rlike(_CARD_PREFIX), ~number.rlike(_CARD_PREFIX)), context, _vote(size >= 5, size < 4), check]
    if kind == "phone":
        uneven = match.rlike(r"[\x20.-]{2}") | (F.length(F.regexp_replace(match, r"[^(]", "")) != F.length(F.regexp_replace(match, r"[^)]", "")))
        return [_vote(~uneven & match.rlike(r"[0-9][)\x20./-]{1,2}[0-9]{3}"), uneven), _vote(match.rlike(r"^\+[1-9]|^\(?0[1-9]"), match.rlike(r"^\+?0[0-]")), context, _vote(size >= 4, size < 3), F.when(F.length(number).between(7, 15), 0).otherwise(-1)]
    hexadecimal = match.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
    mixed = match.rlike(r"^[^0-9]*+[0-9][^A-Za-z]*+[A-Za-z][^0-9]*+[0-9]")  # linear in a run of any length
    return [_vote(hexadecimal | (mixed & (F.length(match) >= 32)), ~mixed), _vote(match.rlike(r"^(?:sk|pk|ghp|xox[a-z]|AKIA|eyJ)"), match.rlike(r"[-_/]{2}")), context, _vote(size >= 12, size < 8), F.lit(0)]


def features(match: Column, before: Column) -> list[Column]:
    """What the span classifier sees besides the votes: length, the character before, and the mix of characters."""
    last = F.right(before, F.lit(1))
    glued = F.when(last.rlike(r"[\p{L}\p{N}]"), "word").when(last.rlike(r"[=:\"']"), "sign").otherwise("other")
    head = F.left(match, F.lit(64))
    mixture = F.concat(*(F.when(head.rlike(p), n).otherwise("") for p, n in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), (r"[^A-Za-z0-9]", "-"))))
    return [F.least((F.length(match) / 8).cast("int"), F.lit(8)).cast("string"), glued, mixture]


def candidates(text: Column) -> Column:
    """All candidate spans: ``start, kind, end, base, votes, looks``."""

    def judged(x: Column, k: int) -> Column:
        kind, is_base = KINDS[k % len(KINDS)], k < len(KINDS)
        base = passes(kind, x["match"]) if is_base else F.lit(False)
        # a phone match that fails by running on is judged by its head
        head = F.regexp_extract(x["match"], _PHONE_HEAD, 0) if kind == "phone" and is_base else F.lit("")
        match = let(base, lambda b: F.struct(b.alias("base"), F.when(~b & (head != ""), head).otherwise(x["match"]).alias("match")))
        return let(match, lambda m: F.struct(x["start"].alias("start"), F.lit(k % len(KINDS)).alias("kind"), (x["start"] + F.length(m["match"])).alias("end"), m["base"].alias("base"), F.array(*labels(kind, m["match"], x["before"], m["base"])).alias("votes"), F.array(*features(m["match"], x["before"])).alias("looks")))

    places = [*range(len(KINDS)), *(len(KINDS) + KINDS.index(kind) for kind in LOOSER)]
    return F.transform(spans(text), lambda x: F.coalesce(*(F.when(x["k"] == k, judged(x, k)) for k in places)))


@dataclass
class Model:
    """Labeler reliabilities (by EM), and the classifier's weights by kind, part and value."""

    reliabilities: dict[tuple[int, int, int], tuple[float, float]] = field(default_factory=dict)
    prior: dict[int, float] = field(default_factory=dict)
    weights: dict[tuple[int, str, str], float] = field(default_factory=dict)
    threshold: float = 0.5

    def score(self, kind: int, votes: tuple[int, ...], looks: tuple[str, ...]) -> float:
        """Log-odds of one candidate, as the expression computes them."""
        return sum(self.weights.get((kind, *part), 0.0) for part in _parts(votes, looks))

    def accepts(self, span: Column) -> Column:
        """Base spans, and all others whose log-odds under the classifier exceed the threshold's."""

        def weight(part: str, value: Column) -> Column:
            found = [((k, v), w) for (k, p, v), w in sorted(self.weights.items()) if p == part]
            if not found:
                return F.lit(0.0)
            table = F.create_map(*(F.lit(x) for (k, v), w in found for x in (f"{k}:{v}", float(w))))
            return F.coalesce(F.try_element_at(table, F.concat_ws(":", span["kind"].cast("string"), value)), F.lit(0.0))

        score = weight("prior", F.lit(""))
        for j in range(len(LABELERS)):
            score = score + weight(f"v{j}", span["votes"][j].cast("string"))
        for j in range(3):
            score = score + weight(f"f{j}", span["looks"][j])
        return span["base"] | (score > math.log(self.threshold / (1 - self.threshold)))


def _spoken(votes: tuple[int, ...]) -> list[tuple[int, int]]:
    """The labelers' votes by place. A check that does not object says nothing."""
    return [(j, x) for j, x in enumerate(votes) if x or LABELERS[j] != "check"]


def _parts(votes: tuple[int, ...], looks: tuple[str, ...]) -> list[tuple[str, str]]:
    return [("prior", ""), *((f"v{j}", str(x)) for j, x in _spoken(votes)), *((f"f{j}", x) for j, x in enumerate(looks))]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(min(x, 30.0), -30.0)))


def _expect(patterns: list[tuple[int, tuple[int, ...], int]], known: list[tuple[int, tuple[int, ...], int]] = (), rounds: int = 30) -> tuple[dict, dict, dict]:
    """EM for labelers that vote 1, -1 or not at all, independent given the truth; by kind. Reliabilities start
    from the prior ones, which keep weighing as some rows do. ``known`` are the patterns of spans that count as
    personal whatever the labelers say."""
    chance = {(k, j, v): (_PRIOR_YES[n][v + 1] or 1e-6, _PRIOR_NO[n][v + 1] or 1e-6) for k in range(len(KINDS)) for j, n in enumerate(LABELERS) for v in (-1, 0, 1)}
    prior = {k: _PRIOR_SHARE for k in range(len(KINDS))}
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for k, v, _ in patterns:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(chance[k, j, x][0] / chance[k, j, x][1]) for j, x in _spoken(v))
            post[k, v] = _sigmoid(odds)
        for kind in {k for k, _, _ in (*patterns, *known)}:
            own = [(v, n, post[kind, v]) for k, v, n in patterns if k == kind] + [(v, n, 1.0) for k, v, n in known if k == kind]
            yes, total = sum(n * p for _, n, p in own), sum(n for _, n, _ in own)
            prior[kind] = (yes + _PRIOR_ROWS * _PRIOR_SHARE) / (total + _PRIOR_ROWS)
            for j, name in enumerate(LABELERS):
                for vote in (-1, 0, 1):
                    a = sum(n * p for v, n, p in own if v[j] == vote)
                    b = sum(n * (1 - p) for v, n, p in own if v[j] == vote)
                    chance[kind, j, vote] = ((a + _PRIOR_ROWS * _PRIOR_YES[name][vote + 1] + 1e-6) / (yes + _PRIOR_ROWS), (b + _PRIOR_ROWS * _PRIOR_NO[name][vote + 1] + 1e-6) / (total - yes + _PRIOR_ROWS))
    return chance, prior, post


def _train(rows: list[tuple[int, bool, tuple[int, ...], tuple[str, ...], int]], chance: dict, prior: dict, post: dict, rounds: int = 60) -> dict[tuple[int, str, str], float]:
    """Logistic regression on the candidates that the labelers are sure of. Its weights are drawn to the
    labelers' log-odds (and to 0 for what labelers do not see), so that values never met keep theirs. A kind
    without sure candidates of both sorts has nothing to learn a difference from and goes by the labelers."""
    centre = {(k, f"v{j}", str(v)): math.log(a / b) for (k, j, v), (a, b) in chance.items() if v or LABELERS[j] != "check"}
    centre |= {(k, "prior", ""): math.log(p / (1 - p)) for k, p in prior.items()}
    of = lambda k, base, v: 1.0 if base else post[k, v]
    sure = [(k, [(k, *x) for x in _parts(v, looks)], float(n), float(of(k, base, v) > 0.5)) for k, base, v, looks, n in rows if abs(of(k, base, v) - 0.5) >= SURE - 0.5]
    both = {k for k, _, _, y in sure if y} & {k for k, _, _, y in sure if not y}
    sure = [x for x in sure if x[0] in both]
    weights = dict(centre)
    for _ in range(rounds):
        slope: dict[tuple[int, str, str], float] = {}
        curve: dict[tuple[int, str, str], float] = {}
        for _, parts, n, y in sure:
            p = _sigmoid(sum(weights.get(x, 0.0) for x in parts))
            for x in parts:
                slope[x] = slope.get(x, 0.0) + n * (y - p)
                curve[x] = curve.get(x, 0.0) + n * p * (1 - p) * len(parts)
        for x, s in slope.items():
            w = weights.get(x, 0.0)
            weights[x] = w + (s - (w - centre.get(x, 0.0))) / (curve[x] + 1.0)
    return {x: round(w, 6) for x, w in weights.items()}


def fit(documents: DataFrame) -> Model:
    """Estimate reliabilities and train the classifier on the vote patterns of all documents.

    What reaches the driver is one row per distinct (kind, votes, features): at most some thousands,
    however large the corpus.
    """
    found = documents.select(F.explode(candidates(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("s"))
    counted = found.groupBy("s.kind", "s.base", "s.votes", "s.looks").agg(F.count("*").alias("n"))
    rows = sorted((r["kind"], r["base"], tuple(r["votes"]), tuple(r["looks"]), r["n"]) for r in counted.collect())
    sums: dict[tuple[bool, int, tuple[int, ...]], int] = {}
    for k, base, v, _, n in rows:
        sums[base, k, v] = sums.get((base, k, v), 0) + n
    of = lambda wanted: [(k, v, n) for (base, k, v), n in sums.items() if base == wanted]
    chance, prior, post = _expect(of(False), of(True))
    return Model(chance, prior, _train(rows, chance, prior, post))


def _texts(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(documents: DataFrame, model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """Spans of personal data in whole texts.

    Returns the kept columns (``doc_id`` if not given) with ``n_email, n_ip, n_card, n_phone`` (base
    spans), ``base_sha256``, ``spans`` (all spans as ``kind:start:end`` in code points, end exclusive, by
    start and then kind) and ``found`` (the same as an array). A null or empty text has none. Repeated
    rows stay, an empty table gives an empty result, columns that are not kept play no part.
    """
    keep = ["doc_id"] if keep is None else keep
    model = model or fit(documents)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = F.array_sort(F.transform(F.filter(candidates(text), model.accepts), lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"])))
    rows = documents.select(*(F.col(f"`{c}`") for c in keep), ordered.alias("__found"))
    base = F.filter(F.col("__found"), lambda s: s["base"])
    n = lambda k: F.size(F.filter(F.col("__found"), lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return rows.select(
        *(F.col(f"`{c}`") for c in keep), *(n(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(_texts(base), 256).alias("base_sha256"), _texts(F.col("__found")).alias("spans"), F.col("__found").alias("found")
    )


#: Code points in a piece of a text that is redacted.
_PIECE = 1024


def _replaced(text: Column, found: Column) -> Column:
    """The text with the stretches that spans cover replaced. It is cut into pieces once, so that no part of it
    is looked for from its beginning."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def part(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, F.floor(b / _PIECE).cast("int") - first + 1), "")
        return F.substr(some, a - first * _PIECE + 1, b - a)

    def build(x: Column) -> Column:
        # a span that begins before those in front of it have ended belongs to their stretch
        firsts = F.filter(F.zip_with(x["found"], running(F.transform(x["found"], lambda s: s["end"]), _most, 0), lambda s, reach: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), reach.alias("reach"))), lambda s: s["start"] >= s["reach"])
        shown = F.transform(firsts, lambda s: F.concat(part(x["pieces"], s["reach"], s["start"]), names[s["kind"]]))
        end = F.array_max(F.transform(x["found"], lambda s: s["end"]))
        return F.concat(F.array_join(shown, ""), part(x["pieces"], end, F.length(text)))

    return let(F.struct(found.alias("found"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces")), build)


def redact(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets (overlapping spans by the
    first one's), and all columns kept as they are; a null text stays null."""
    model = model or fit(documents)
    text = F.col("text")
    ordered = F.array_sort(F.transform(F.filter(candidates(text), model.accepts), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return documents.withColumn("text", let(ordered, lambda found: F.when(F.size(found) > 0, _replaced(text, found)).otherwise(text)))
