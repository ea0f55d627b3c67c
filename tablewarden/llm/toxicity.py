"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers read a clause as a string of symbols: insult, threat, target, negation, report, an opening
quotation, and a gap of other words. Their composition runs once over a clause; its final states carry the
weights, one per clause kind: an insult, an insult at somebody, one that stands alone, the same of threats, a
negated and a reported one. A text's score comes from the weights of its clauses. The weights are fitted by
logistic regression, inside bounds that keep the grammar's order: whoever is told it weighs more than nobody
told, a word that stands alone at most half as much as one in a clause, negated and reported speech at most
half as much as plain speech, and a threat at somebody is enough by itself.

The insult class starts from a fixed word list and grows by stems learnt from labelled rows: a stem must
keep to toxic rows and stand in many different contexts there, so a family of copies teaches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .pretokens import character_sums, mix
from .shared import stored
from .words import ALPHANUMERIC, Words, text_chunks, words_of

# Word classes that the grammar starts from, in four languages.
INSULTS = "idiot idiots moron morons stupid scum loser losers trash clown worthless pathetic disgusting idiota imbécil estúpido imbécile crétin débile abruti dummkopf trottel abschaum versager".split()
THREATS = "kill hurt destroy murder stab shoot hang matar destruir tuer frapper töten umbringen".split()
TARGETS = "you your youre u ur he she they him her them tu vous toi ton usted ustedes tú du dich dir ihr sie".split()
NEGATIONS = "not no never isnt arent dont nicht kein keine nie ne pas jamais nunca jamás ningún".split()
REPORTS = "said says say called calls wrote writes reported quoted claimed sagte schrieb dit disait écrit dijo dice escribió".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, GAP = range(7)
#: Words between two classes after which a negation no longer reaches.
SCOPE = 3
_SHORTEST, _LONGEST = 3, 12
_CLAUSE_ENDS = np.zeros(256, dtype=bool)
_CLAUSE_ENDS[[ord(c) for c in ".!?;\n"]] = True


class Transducer:
    """A deterministic machine over clause symbols; what it says is the state it ends in."""

    def __init__(self, moves: dict[tuple[int, int], int]) -> None:
        self.moves = moves

    def step(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), state)


SEEN = lambda symbol: Transducer({(0, symbol): 1})
#: 0 open, 1 a negation in reach, 2 negated insult or threat, 3 one that is not negated.
NEGATED = Transducer({(0, NEGATION): 1, (1, GAP): 0, (1, INSULT): 2, (1, THREAT): 2, (0, INSULT): 3, (0, THREAT): 3, (2, INSULT): 3, (2, THREAT): 3})
#: 0 open, 1 speech is reported, 2 reported insult or threat, 3 inside a quotation, 4 quoted insult or threat.
REPORTED = Transducer({(0, REPORT): 1, (1, INSULT): 2, (1, THREAT): 2, (0, QUOTE): 3, (3, INSULT): 4, (3, THREAT): 4, (4, REPORT): 2, (3, REPORT): 1})


def compose(machines: list[Transducer]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product of the machines over reachable states: next state by state and symbol, and its parts."""
    start = tuple(0 for _ in machines)
    states, order, rows = {start: 0}, [start], []
    for state in order:
        row = []
        for symbol in range(7):
            to = tuple(m.step(s, symbol) for m, s in zip(machines, state, strict=True))
            if to not in states:
                states[to] = len(order)
                order.append(to)
            row.append(states[to])
        rows.append(row)
    return np.array(rows), order


DELTA, STATES = compose([SEEN(INSULT), SEEN(THREAT), SEEN(TARGET), NEGATED, REPORTED])

#: Clause kinds and their prior weights: fixed values.
PRIOR = {"insult": 4.0, "insult_at": 5.0, "insult_alone": 1.0, "threat": 1.0, "threat_at": 4.0, "threat_alone": 0.5, "negated": 0.5, "reported": 1.0}
#: The bias stays where a text without clauses is clean and one threat at somebody is not.
LEAST_BIAS, MOST_BIAS, LEAST_THREAT_AT = -3.5, math.log(0.1 / 0.9), 3.2
#: What a weight must exceed the one below it by.
_MARGIN = 0.5


def _kind(state: tuple[int, ...]) -> str | None:
    insult, threat, target, negated, reported = state
    if not insult and not threat:
        return None
    if negated == 2:
        return "negated"
    if reported == 2:
        return "reported"
    return ("insult" if insult else "threat") + ("_at" if target else "")


KINDS = list(PRIOR)
STATE_KIND = np.array([KINDS.index(k) if (k := _kind(s)) else -1 for s in STATES])
_ALONE = {KINDS.index(k): KINDS.index(k + "_alone") for k in ("insult", "threat")}


def bounded(weights: np.ndarray) -> np.ndarray:
    """The weights moved into the order that the grammar asks for."""
    w = dict(zip(KINDS, weights.tolist(), strict=True))
    w["insult"], w["threat"] = max(w["insult"], 2 * _MARGIN), max(w["threat"], 0.0)
    w["insult_at"] = max(w["insult_at"], w["insult"] + _MARGIN)
    w["threat_at"] = max(w["threat_at"], w["threat"] + _MARGIN, LEAST_THREAT_AT)
    for part, of in (("insult_alone", "insult"), ("threat_alone", "threat"), ("negated", "insult"), ("reported", "insult")):
        w[part] = min(max(w[part], 0.0), w[of] / 2)
    return np.array([w[k] for k in KINDS])


def _prefix_hashes(words: Words, total: np.ndarray, which: np.ndarray, size: int) -> np.ndarray:
    s = words.starts[which]
    return mix(total[s + size] - total[s] + np.uint64(size))


def _totals(words: Words) -> np.ndarray:
    return character_sums(words.bytes, words.starts)


def fingerprint(word: str) -> tuple[int, int]:
    """The word's fingerprint, as ``words_of`` gives it for whole words, and its length in bytes."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words_of(raw, np.array([0, len(raw)]), ALPHANUMERIC).hashes[0]), len(raw)


@dataclass
class Lexicon:
    """Classes of whole words, and insult stems, as fingerprints by length in bytes."""

    exact: dict[int, int]
    stems: dict[int, int]

    def __post_init__(self) -> None:
        keys = sorted(self.exact)
        self.keys, self.values = np.array(keys, np.uint64), np.array([self.exact[k] for k in keys], np.int64)
        self.stem_sizes = {n: np.array(sorted(k for k, m in self.stems.items() if m == n), np.uint64) for n in sorted(set(self.stems.values()))}
        self.there = np.zeros(1 << 16, dtype=bool)
        self.there[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def classes(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words (by place) that have a class, and which."""
        found = np.full(len(words.hashes), -1, np.int64)
        size = words.ends - words.starts
        maybe = np.flatnonzero(self.there[(words.hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words.hashes[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == words.hashes[maybe]
            found[maybe[hit]] = self.values[at[hit]]
        if self.stem_sizes and len(found):
            total = _totals(words)
            for n, keys in self.stem_sizes.items():
                which = np.flatnonzero(size >= n)
                h = _prefix_hashes(words, total, which, n)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found[which[keys[at] == h]] = INSULT
        at = np.flatnonzero(found >= 0)
        return at, found[at]


def base_lexicon(drop: set[int] = frozenset(), stems: dict[int, int] | None = None) -> Lexicon:
    groups = ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT))
    exact = {fingerprint(w)[0]: k for group, k in groups for w in group}
    return Lexicon({h: k for h, k in exact.items() if h not in drop}, stems or {})


def clause_counts(words: Words, raw: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """How many clauses of each kind every text has."""
    out = np.zeros((len(words.bounds) - 1, len(KINDS)), np.int64)
    at, symbol = lexicon.classes(words)
    if not len(at) or not (symbol <= THREAT).any():
        return out
    owners = np.repeat(np.arange(len(words.bounds) - 1), words.counts)
    clauses = np.cumsum(_CLAUSE_ENDS[raw])[words.starts] + owners * np.int64(len(raw) + 1)
    clause = clauses[at]
    live = np.isin(clause, np.unique(clause[symbol <= THREAT]))
    at, symbol, clause = at[live], symbol[live], clause[live]
    first = np.searchsorted(clauses, clause)
    size = np.searchsorted(clauses, clause, side="right") - first
    marks = np.cumsum(raw == 34)
    # an odd number of quotation marks before a word of its clause: it stands inside a quotation
    quoted = (marks[words.starts[at]] - marks[words.starts[first]] + (raw[np.maximum(words.starts[first] - 1, 0)] == 34)) % 2 == 1
    state, last, held, told, n = 0, -1, -1, 0, 0

    def close(owner: int) -> None:
        kind = int(STATE_KIND[state])
        if kind >= 0:
            out[owner, _ALONE.get(kind, kind) if told == n else kind] += 1

    owner = owners[at].tolist()
    for i, (w, s, c, q) in enumerate(zip(at.tolist(), symbol.tolist(), clause.tolist(), quoted.tolist(), strict=True)):
        if c != held:
            if held >= 0:
                close(owner[i - 1])
            state, held, told, n = 0, c, 0, int(size[i])
        elif w - last > SCOPE:
            state = DELTA[state, GAP]
        if q and s <= THREAT:
            state = DELTA[state, QUOTE]
        state, last, told = DELTA[state, s], w, told + (s <= THREAT)
    close(owner[-1])
    return out


def held_out() -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _stem_rows(wanted: np.ndarray | None):
    """Counts of prefixes in labelled texts: by document, with a 64-bit set of their contexts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(0), "")
            for _, _, raw, ends in text_chunks(text):
                words = words_of(raw, ends, ALPHANUMERIC)
                if not len(words.hashes):
                    continue
                total, size = _totals(words), words.ends - words.starts
                owner = np.repeat(np.arange(len(words.bounds) - 1), words.counts)
                near = mix(np.append(words.hashes[1:], np.uint64(0)) + np.append(np.uint64(0), words.hashes[:-1]) * np.uint64(31)) >> np.uint64(58)
                keys, docs, bits, sizes, parents = [], [], [], [], []
                for n in range(_SHORTEST, _LONGEST + 1):
                    which = np.flatnonzero(size >= n)
                    h = _prefix_hashes(words, total, which, n)
                    if wanted is not None:
                        there = np.isin(h, wanted)
                        which, h = which[there], h[there]
                    keys.append(h), docs.append(owner[which]), bits.append(np.uint64(1) << near[which]), sizes.append(np.full(len(h), n))
                    parents.append(_prefix_hashes(words, total, which, n - 1))
                keys, docs, bits, sizes, parents = (np.concatenate(x) for x in (keys, docs, bits, sizes, parents))
                if not len(keys):
                    continue
                order = np.lexsort((docs, keys))
                keys, docs, bits, sizes, parents = (x[order] for x in (keys, docs, bits, sizes, parents))
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                new_doc = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(new_doc, first)), pa.array(np.bitwise_or.reduceat(bits, first).view(np.int64)), pa.array(sizes[first]), pa.array(parents[first].view(np.int64))], names=["stem", "n", "bits", "size", "parent"]
                )

    return count


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = self.bias + np.log2(1 + counts) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_stems(texts: DataFrame, least_rows: int = 5, least_contexts: int = 8, most_clean: float = 0.02) -> tuple[dict[int, int], set[int]]:
    """Insult stems of labelled ``text, toxic`` rows, and fixed insults that the rows speak against."""
    schema = "stem long, n long, bits long, size long, parent long"
    merge = lambda df: df.groupBy("stem").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"), F.first("size").alias("size"), F.first("parent").alias("parent"))
    toxic = merge(texts.where("toxic = 1").select("text").mapInArrow(_stem_rows(None), schema)).where((F.col("n") >= least_rows) & (F.bit_count("bits") >= least_contexts))
    found = {r.stem: r for r in toxic.collect()}  # bounded by the sample of labelled rows
    fixed = {np.uint64(fingerprint(w)[0]) for w in INSULTS}
    wanted = np.unique(np.append(np.array(list(found), np.int64).view(np.uint64), np.array(sorted(fixed), np.uint64)))
    clean = {r.stem: r.n for r in merge(texts.where("toxic = 0").select("text").mapInArrow(_stem_rows(wanted), schema)).collect()}
    good = {s for s, r in found.items() if clean.get(s, 0) <= most_clean * r.n}
    children: dict[int, list[int]] = {}
    for s in good:
        children.setdefault(found[s].parent, []).append(s)
    stems: dict[int, int] = {}
    for s in good:
        if found[s].parent in good:
            continue
        # the longest stem that still covers nearly all rows of its root
        while longer := [c for c in children.get(s, []) if found[c].n >= 0.9 * found[s].n]:
            s = max(longer, key=lambda c: (found[c].n, c))
        stems[int(np.int64(s).view(np.uint64))] = found[s].size
    signed = lambda h: int(np.uint64(h).view(np.int64))
    drop = {int(h) for h in fixed if clean.get(signed(h), 0) > max(3, 0.5 * (found[signed(h)].n if signed(h) in found else 0))}
    return stems, drop


def _counted(lexicon: Lexicon):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(0), "")
            parts = [clause_counts(words_of(raw, ends, ALPHANUMERIC), raw, lexicon) for _, _, raw, ends in text_chunks(text)]
            rows = np.concatenate(parts) if parts else np.zeros((0, len(KINDS)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, r)) for r in rows.tolist()], pa.string()), batch.column(1)], names=["pattern", "toxic"])

    return count


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> Model:
    """Learn stems and weights from at most ``train_rows`` labelled rows (those with the smallest hash),
    never from held-out ones. Null labels and labels of unknown documents teach nothing; without labels
    the grammar's prior stands."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # the sample is a stated number of (id, label) pairs, so this broadcast cannot grow
    texts = stored(documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxicity-sample")
    stems, drop = learn_stems(texts)
    lexicon = base_lexicon(drop, stems)
    rows = texts.mapInArrow(_counted(lexicon), "pattern string, toxic int").groupBy("pattern").agg(F.count("*").alias("n"), F.sum("toxic").alias("yes")).collect()
    patterns = sorted((tuple(map(int, r.pattern.split(","))), r.n, r.yes) for r in rows)
    x = np.array([p for p, _, _ in patterns], float).reshape(-1, len(KINDS))
    n, yes = np.array([a for _, a, _ in patterns], float), np.array([b for _, _, b in patterns], float)
    prior = np.array([PRIOR[k] for k in KINDS])
    weights, bias = prior.copy(), -3.0
    x = np.log2(1 + x)
    for _ in range(400 if len(n) else 0):
        p = 1 / (1 + np.exp(-np.clip(bias + x @ weights, -30, 30)))
        error = yes - n * p
        curve = n * p * (1 - p)
        weights = bounded(weights + (x.T @ error - (weights - prior)) / ((x * x).T @ curve + len(KINDS) + 1))
        bias = min(max(bias + (error.sum() - 0.1 * (bias + 3)) / (curve.sum() * 2 + 1), LEAST_BIAS), MOST_BIAS)
    return Model(lexicon, weights, float(bias))


def score(documents: DataFrame, model: Model, keep: list[str] | None = None, cut: float = 0.3) -> DataFrame:
    """The kept columns (``doc_id`` if not given) with ``score`` (0 to 1) and ``predicted``.

    Null and empty texts have no clause and score by the bias alone. Repeated rows stay, an empty table
    gives an empty result, columns that are not kept play no part; labels, language, source and id are
    no inputs of a score.
    """
    keep = ["doc_id"] if keep is None else keep

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(0), "")
            parts = [clause_counts(words_of(raw, ends, ALPHANUMERIC), raw, model.lexicon) for _, _, raw, ends in text_chunks(text)]
            s = model.score(np.concatenate(parts) if parts else np.zeros((0, len(KINDS)), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s)], names=[*(f"c{i}" for i in range(len(keep))), "score"])

    rows = documents.select(F.col("text").cast("string").alias("__text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields[1:]), StructField("score", DoubleType())])
    out = rows.mapInArrow(judge, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def toxicity(documents: DataFrame, labels: DataFrame, cut: float = 0.3, train_rows: int = 20_000) -> DataFrame:
    """Fit on the labelled rows that are not held out and score every document."""
    model = fit(documents, labels, train_rows)
    return score(documents, model, cut=cut).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
